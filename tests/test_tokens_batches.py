"""Vocabulary, encoding, masking and batching on hand-made examples."""
import warnings

import pytest
from pyspark.sql import functions as F

from minpair.operators import batches as BT
from minpair.operators import tokens as TK


def test_masked_copies_golden(spark):
    enc = spark.createDataFrame([(1, [0, 7, 8, 2]), (2, [0, 2])], "sent_id long, token_ids array<long>")
    rows = sorted((r["mask_pos"], r["label"], r["token_ids"]) for r in TK.masked_copies(enc, ["sent_id"]).collect())
    assert rows == [(1, 7, [0, 4, 8, 2]), (2, 8, [0, 7, 4, 2])]
    assert TK.true_token_lengths(enc, ["sent_id"]).collect()[0]["n_tokens"] == 2
    g = {r["sent_id"]: r["kept"] for r in TK.length_guard(enc, 3).collect()}
    assert g == {1: False, 2: True}


def test_vocab_and_encode(spark):
    s = spark.createDataFrame([(1, "b a b"), (2, "c b"), (3, "")], "sent_id long, sentence string")
    vocab = TK.vocab_build(s, unit="word")
    ids = {r["token"]: r["token_id"] for r in vocab.table.collect()}
    assert ids["b"] == 5 and ids["a"] == 6 and ids["c"] == 7 and ids["<mask>"] == 4
    enc = {r["sent_id"]: r["token_ids"] for r in TK.encode(s, vocab, ["sent_id"]).collect()}
    assert enc == {1: [0, 5, 6, 5, 2], 2: [0, 7, 5, 2], 3: [0, 2]}
    other = spark.createDataFrame([(9, "a z")], "sent_id long, sentence string")
    assert TK.encode(other, vocab, ["sent_id"]).collect()[0]["token_ids"] == [0, 6, 3, 2]


def _batch(spark, arrays, batch=0):
    return spark.createDataFrame([(batch, i, a) for i, a in enumerate(arrays)], "b int, seq int, x array<long>")


def test_pad_to_longest(spark):
    df = BT.pad_batch(_batch(spark, [[31], [17, 23, 29], [11, 13]]), "b", "x", pad_val=-7)
    rows = df.orderBy("seq").collect()
    assert [r["padded"] for r in rows] == [[31, -7, -7], [17, 23, 29], [11, 13, -7]]
    assert [r["valid_length"] for r in rows] == [1, 3, 2]
    r8 = BT.pad_batch(_batch(spark, [[1, 2, 3], [1]]), "b", "x", pad_val=9, round_to=8).orderBy("seq").collect()
    assert [len(r["padded"]) for r in r8] == [8, 8]


def test_pad_default_warns_and_rejects_scalars(spark):
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        BT.pad_batch(_batch(spark, [[1], [1, 2]]), "b", "x")
        assert any("pad_val" in str(x.message) for x in w)
    scal = spark.createDataFrame([(0, 0, 1)], "b int, seq int, x int")
    with pytest.raises(TypeError):
        BT.pad_batch(scal, "b", "x", pad_val=0)


def test_pad_inner_axis(spark):
    df = spark.createDataFrame([(0, 0, [[41], [43]]), (0, 1, [[2, 3, 5], [7, 11, 13]]), (1, 2, [[17], [19]])],
                               "b int, seq int, x array<array<long>>")
    rows = BT.pad_inner_axis(df, "b", "x", pad_val=90).orderBy("seq").collect()
    assert rows[0]["padded"] == [[41, 90, 90], [43, 90, 90]] and rows[2]["padded"] == [[17], [19]]


def test_batch_fields_and_stack(spark):
    df = spark.createDataFrame([(0, 5, [60, 61], 3, "oak"), (0, 2, [70, 71, 72], 9, "elm")],
                               "b int, seq int, data array<long>, label int, txt string")
    out = BT.batch_fields(df, "b", "seq", {"data": "pad", "label": "stack", "txt": "list"}, pad_val=0).collect()[0]
    assert out["data"] == [[70, 71, 72], [60, 61, 0]]  # in seq order
    assert out["label"] == [9, 3] and out["txt"] == ["elm", "oak"]
    st = BT.stack(_batch(spark, [[10, 20], [30, 40], [50, 60]]), "b", "seq", "x").collect()[0]
    assert st["stacked"] == [[10, 20], [30, 40], [50, 60]] and st["shape_ok"]
    assert not BT.stack(_batch(spark, [[1], [1, 2]]), "b", "seq", "x").collect()[0]["shape_ok"]
    with pytest.raises(ValueError):
        BT.batch_fields(df, "b", "seq", {"nope": "pad"})
    with pytest.raises(ValueError):
        BT.batch_fields(df, "b", "seq", {"data": "squeeze"})


def test_attention_mask(spark):
    r = spark.range(1).select(BT.attention_mask(F.lit(2), 4).alias("m")).collect()[0]["m"]
    assert r == [True, True, False, False]


def test_pad_then_cut_is_identity(spark):
    arrays = [[1, 2, 3], [4], [5, 6]]
    df = BT.pad_batch(_batch(spark, arrays), "b", "x", pad_val=0)
    cut = df.select("seq", F.slice("padded", 1, F.col("valid_length")).alias("c")).orderBy("seq").collect()
    assert [r["c"] for r in cut] == arrays


def test_stack_dtype_cast(spark):
    st = BT.stack(_batch(spark, [[1, 2], [3, 4]]), "b", "seq", "x", dtype="double").collect()[0]
    assert st["stacked"] == [[1.0, 2.0], [3.0, 4.0]]


def test_batches_do_not_follow_the_session(spark):
    rows = [(i, (i * i) % 37 + 3) for i in range(400)] + [(400, None)]
    df = spark.createDataFrame(rows, "id int, n int")
    hist = BT.length_histogram(df, "n")
    plan = {r.bucket: r for r in BT.bucket_plan(hist, num_buckets=4, batch_size=10, shard_rows=50).collect()}
    known = [n for _, n in rows if n is not None]
    width = -(-(max(known) - min(known) + 1) // 4)
    for b, r in plan.items():
        inside = [n for n in known if min((n - min(known)) // width, 3) == b]
        want = len(inside) + (b == 3)  # the null length falls into the last bucket
        assert (r.n_rows, r.shards) == (want, -(-want // 50))
        assert (r.shortest, r.longest, r.upper_length) == (min(inside), max(inside), min(known) + (b + 1) * width - 1)
    assert sum(r.n_rows for r in plan.values()) == len(rows)

    def batches():
        out = BT.bucketed_batches(df, "n", ["id"], num_buckets=4, batch_size=10, shard_rows=50).collect()
        return sorted((r.id, r.bucket, r.shard, r.batch_in_shard) for r in out)

    prev, first = spark.conf.get("spark.sql.shuffle.partitions"), batches()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert batches() == first and len(first) == len(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", prev)


def test_batches_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id int, n int")
    assert BT.bucketed_batches(df, "n", ["id"]).count() == 0
    assert BT.bucket_plan(BT.length_histogram(df, "n")).count() == 0
