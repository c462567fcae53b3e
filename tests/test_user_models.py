"""User models: packed forward passes, one model per worker, the evaluation plan, fill-mask; split-wise scans."""
import math

import numpy as np
import pytest

from minpair.functions.tokens import MASK_ID
from minpair.operators import accuracy as ACC
from minpair.operators import count_model as CM
from minpair.operators import scorer as SC
from minpair.operators import tokens as TK
from minpair.plans.evaluate import ScoredModel, UserModel, evaluate, results_long


class Counting(SC.ToyModel):
    """Counts forward passes and their cells; padding must not matter."""

    block_cells = 400

    def __init__(self):
        super().__init__("counting")
        self.passes = []

    def logits(self, model, ids, mask, rows, places):
        self.passes.append(ids.size)
        assert (ids[~mask] == 1).all()
        return super().logits(model, ids, mask, rows, places)


def slow(ids, masked):
    """One sentence, one position at a time."""
    v = np.arange(64) ** 2 * 7
    total, places = 0.0, range(1, len(ids) - 1) if masked else range(len(ids))
    for p in places:
        x = ids.copy()
        if masked:
            x[p] = MASK_ID
        z = ((x.sum() * 31 + p * 17 + v) % 101) / 10.0
        total += z[ids[p] % 64] - np.log(np.exp(z).sum())
    if masked:
        return total
    return -total / len(ids) if len(ids) else math.nan


@pytest.fixture(scope="module")
def sentences():
    rng = np.random.default_rng(3)
    return [rng.integers(5, 500, size=n).astype("int64") for n in (0, 1, 2, 3, 5, 40, 7, 7, 3, 21, 120, 4)]


def test_packed_scores_equal_one_by_one(sentences):
    toy = Counting()
    work = SC.SentenceScorer(toy, toy.prepare())
    assert np.allclose(work.mlm(sentences), [slow(s, True) for s in sentences])
    assert np.allclose(work.holistic(sentences), [slow(s, False) for s in sentences], equal_nan=True)
    assert work.mlm([]).shape == (0,) and work.holistic([]).shape == (0,)


def test_passes_follow_cells_not_sentences():
    toy = Counting()
    work = SC.SentenceScorer(toy, toy.prepare())
    short = [np.array([0, 7 + i, 2]) for i in range(1000)]  # a copy of three cells each
    work.mlm(short)
    assert len(toy.passes) == math.ceil(1000 / (400 // 3)) and max(toy.passes) <= 400
    toy.passes.clear()
    work.holistic(short)
    assert len(toy.passes) == math.ceil(1000 / (400 // 3))


def test_blocks_keep_the_budget():
    lengths = np.sort(np.random.default_rng(0).integers(1, 90, size=500))
    blocks = list(SC.pack(lengths, 256))
    assert [b[0] for b in blocks] == [0, *(b[1] for b in blocks[:-1])] and blocks[-1][1] == 500
    assert all((hi - lo) * lengths[hi - 1] <= 256 or hi - lo == 1 for lo, hi in blocks)


def test_a_worker_holds_one_model():
    class Held:
        closed = 0

        def close(self):
            Held.closed += 1

    class One:
        def __init__(self, key):
            self.key, self.loads = key, 0

        def prepare(self):
            self.loads += 1
            return Held()

    SC._HELD.clear()
    a, b = One("a"), One("b")
    for s in (a, a, b, b, a):
        SC.held_model(s)
        assert list(SC._HELD) == [s.key]
    assert (a.loads, b.loads, Held.closed) == (2, 1, 2)
    SC._HELD.clear()


def test_evaluate_mixes_count_and_user_models(spark):
    lines = spark.createDataFrame([("p1", 0, "the cat sat"), ("p1", 1, "cat the sat"), ("p1", 2, "a b c d"), ("p1", 3, "b a"),
                                   ("p2", 0, "the dog sat"), ("p2", 1, ""), ("alone", 0, "one line")],
                                  "paradigm string, line_no long, sentence string")
    vocab = TK.vocab_build(lines, unit="word")
    models = [ScoredModel("count", "c", 0, "x", CM.fit(lines, "sentence", "word")),
              ScoredModel("toy", "c", 0, "y", UserModel(SC.ToyModel(), vocab)),
              ScoredModel("other", "c", 0, "z", UserModel(SC.ToyModel("toy-too"), vocab))]
    got = {(r.model, r.scoring_method, r.paradigm): r.accuracy for r in results_long(models, lines).collect()}
    assert len(got) == 3 * 2 * 3
    ids = {r.token: r.token_id for r in vocab.table.collect()}
    score = {(r.paradigm, r.line_no): [slow(np.array([0, *(ids[w] for w in r.sentence.split()), 2]), m) for m in (True, False)]
             for r in lines.collect()}
    for name in ("toy", "other"):
        for k, method in enumerate(("mlm", "holistic")):
            for p, n in (("p1", 2), ("p2", 1)):
                wins = sum((1 if k == 0 else -1) * (score[p, 2 * i][k] - score[p, 2 * i + 1][k]) > 1e-6 for i in range(n))
                assert got[name, method, p] == 100.0 * wins / n
            assert got[name, method, "alone"] is None  # a paradigm without a pair
    wide = evaluate(models, lines, ["p1", "p2", "alone"]).collect()
    assert len(wide) == 6 and all(r["alone"] is None and r["overall"] is not None for r in wide)
    bounded = results_long([models[1]], lines, max_tokens=4)
    assert {r.accuracy for r in bounded.collect() if r.scoring_method == "mlm" and r.paradigm == "p2"} == {0.0}


def test_overall_is_of_unrounded_accuracies(spark):
    rows = [("p1", i, float(i % 2 == 0 and i < 2)) for i in range(6)] + [("p2", i, float(i % 2 == 0 and i < 4)) for i in range(6)]
    scores = spark.createDataFrame(rows, "paradigm string, line_no long, score double")
    acc = {r.paradigm: r.accuracy for r in ACC.pair_accuracy(scores, "mlm", decimals=None).collect()}
    assert acc == pytest.approx({"p1": 100.0 / 3, "p2": 200.0 / 3}, rel=1e-12)


def test_fill_mask_of_a_user_model(spark, sentences):
    df = spark.createDataFrame([(i, [int(x) for x in s]) for i, s in enumerate(sentences)], "sent_id long, token_ids array<long>")
    got = {}
    for r in SC.scorer_fill_mask(df, SC.ToyModel(), ["sent_id"], k=3).collect():
        got.setdefault((r.sent_id, r.pos), []).append((r.rank, r.label, r.logprob))
    assert len(got) == sum(map(len, sentences))
    v = np.arange(64) ** 2 * 7
    for (i, p), top in got.items():
        z = ((sentences[i].sum() * 31 + p * 17 + v) % 101) / 10.0
        want = sorted(range(64), key=lambda x: (-z[x], x))[:3]
        assert [x[:2] for x in sorted(top)] == [(n + 1, w) for n, w in enumerate(want)]


@pytest.mark.parametrize("sep", ["\n", "\r\n", "\r"])
@pytest.mark.parametrize("final", [True, False])
def test_split_scan_numbers_lines_as_the_whole_file(spark, tmp_path, sep, final):
    from minpair.sources.suites import scan_corpus, scan_lines
    rng = np.random.default_rng(1)
    want = {}
    for name, n in (("a", 400), ("b", 1), ("c", 0), ("d", 90)):
        lines = ["" if k % 7 == 3 else " x" * int(rng.integers(1, 9)) + f" {k}é " for k in range(n)]
        if lines and not final:
            lines[-1] = "end"
        (tmp_path / f"{name}.txt").write_bytes((sep.join(lines) + (sep if final and n else "")).encode())
        want |= {(name, i): s.strip() for i, s in enumerate(lines)}
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "257")  # borders fall inside lines and line ends
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        raw = scan_lines(spark, str(tmp_path))
        got = {(r.paradigm, r.line_no): r.sentence for r in scan_corpus(spark, str(tmp_path)).collect()}
        assert raw.count() == len(want)
    finally:
        spark.conf.set(key, old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want


def test_missing_cells_propagate_on_request(spark):
    from minpair.operators import summaries as SM
    rows = [("m", "c", r, "p", "mlm", p, None if (r, p) == (1, "b") else 50.0 + r) for r in range(3) for p in ("a", "b")]
    long = spark.createDataFrame(rows, "model string, corpora string, rep int, path string, scoring_method string, paradigm string, accuracy double")
    skip = {r.paradigm: (r.accuracy, r.n) for r in SM.paradigm_mean_moe(long, "mlm").collect()}
    assert skip == {"a": (51.0, 3), "b": (51.0, 2)}
    prop = {r.paradigm: r for r in SM.paradigm_mean_moe(long, "mlm", missing="propagate").collect()}
    assert prop["a"].accuracy == 51.0 and math.isnan(prop["b"].accuracy) and math.isnan(prop["b"].margin)
    one = SM.margin_of_error_paradigms(long, "mlm", missing="propagate").collect()
    assert math.isnan(one[0].accuracy)
