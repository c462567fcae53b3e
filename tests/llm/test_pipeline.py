"""The pipeline against a slow version of each stage's decisions."""
import numpy as np
import public_tokenizers

import corpus_pipeline as cp
from minpair.llm.common import read
from minpair.llm.queries import RANKS

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    import tiktoken
    from minpair.llm.op8_bpe import load_ranks
    from test_python import brute_classes

    docs = read(spark, DIR, "documents")
    q = cp.quality(spark, docs, DIR).cache()
    assert q.columns == docs.columns
    labels = {r.doc_id: r.quality for r in read(spark, DIR, "labels").collect()}
    kept = {r.doc_id for r in q.collect()}
    good = [i for i, v in labels.items() if v == 1]
    assert sum(i in kept for i in good) >= 0.95 * len(good)
    lines = cp.line_dedup(spark, q, DIR).cache()
    assert lines.columns == docs.columns and {r.doc_id for r in lines.collect()} == kept
    near = cp.near_dedup(spark, lines, DIR).cache()
    classes = brute_classes([(r.doc_id, r.text) for r in lines.collect()])
    assert {r.doc_id for r in near.collect()} == set(classes.values())
    mixed = cp.mixing(spark, near, DIR).cache()
    assert mixed.columns == docs.columns and 0 < mixed.count() <= near.count()
    out = {r.doc_id: r for r in cp.encode(spark, mixed, DIR).collect()}
    ranks = load_ranks(public_tokenizers.path(RANKS))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    import hashlib
    for r in mixed.collect():
        ids = np.array(enc.encode_ordinary(r.text or ""), dtype="<u4")
        assert out[r.doc_id].n_tokens == len(ids) and out[r.doc_id].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()


def test_edges(spark, make_docs, edge_rows):
    for rows in (edge_rows, []):
        docs = make_docs(rows)
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, DIR)
            docs.count()


def test_rows_of_one_id_leave_a_survivor(spark, make_docs):
    """Every text that goes has a class whose smallest id stays."""
    a, b, c = ("a b c d e f g h", "k l m n o p q r", "s t u v w x y z")
    rows = [(2, a), (5, a), (5, b), (3, c), (7, a), (7, b), (7, c)]
    docs = make_docs(rows)
    classes = {(r.doc_id, r.group_id, r.kept) for r in cp.op3_probminhash.near_dedup(docs).collect()}
    assert classes == {(2, 2, True), (3, 2, False), (5, 2, False), (7, 2, False)}
    assert [(r.doc_id, r.text) for r in cp.near_dedup(spark, docs, DIR).collect()] == [(2, a)]
