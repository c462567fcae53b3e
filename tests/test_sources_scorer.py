"""Suite scans on temporary files, results CSV, scorer plumbing."""
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from minpair.functions import arrays as A
from minpair.operators.scorer import LogitsScorer, check_temperature, run_scorer
from minpair.sources import sinks as SK
from minpair.sources import suites as SU


def _write(d, name, text):
    with open(os.path.join(d, name), "w") as f:
        f.write(text)


def test_strict_scan(spark, tmp_path):
    good = tmp_path / "good"
    good.mkdir()
    _write(good, "para_one.txt", "g1\nb1\ng2\nb2")
    rows = SU.scan_suite(spark, str(good)).orderBy("line_no").collect()
    assert [(r["paradigm"], r["line_no"], r["sentence"]) for r in rows][:2] == [("para_one", 0, "g1"), ("para_one", 1, "b1")]
    assert SU.paradigm_catalog(spark, str(good)).collect()[0]["paradigm"] == "para_one"
    bad = tmp_path / "bad"
    bad.mkdir()
    _write(bad, "x.txt", "g1\nb1\n")  # trailing newline -> odd count, empty last line
    with pytest.raises(Exception):
        SU.scan_suite(spark, str(bad)).collect()
    corpus = SU.scan_corpus(spark, str(bad)).orderBy("line_no").collect()
    assert [r["sentence"] for r in corpus] == ["g1", "b1"]


def test_results_csv_missing(spark, tmp_path):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("model", T.StringType())])
    assert SK.read_results_csv(spark, str(tmp_path / "none.csv"), schema).count() == 0
    with pytest.raises(FileNotFoundError):
        SK.read_results_csv(spark, str(tmp_path / "none.csv"), schema, missing_ok=False)


def test_scorer_matches_array_log_softmax(spark):
    rng = np.random.default_rng(0)
    rows = [(i, j, int(rng.integers(0, 6)), [float(x) for x in rng.normal(size=6)]) for i in range(5) for j in range(3)]
    df = spark.createDataFrame(rows, "sent_id long, pos int, label int, logits array<double>")
    a = {(r[0], r[1]): r[2] for r in run_scorer(df, LogitsScorer(), ["sent_id", "pos"]).collect()}
    b = {(r[0], r[1]): r[2] for r in df.select("sent_id", "pos", A.label_gather(A.log_softmax("logits"), "label")).collect()}
    assert all(math.isclose(a[k], b[k], rel_tol=1e-12) for k in a)
    ce = {(r[0], r[1]): r[2] for r in df.select("sent_id", "pos", A.token_cross_entropy("logits", "label")).collect()}
    assert all(math.isclose(ce[k], -b[k], rel_tol=1e-12) for k in a)
    top = df.select(A.topk_indices("logits", 2).alias("t"), A.argmax("logits").alias("m"), "logits").collect()
    for r in top:
        assert r["t"][0] == r["m"] == int(np.argmax(r["logits"]))
    with pytest.raises(ValueError):
        check_temperature(0.7)


def test_run_listing(spark, tmp_path):
    from minpair.sources import registry as RG
    for rel in ["param_001/a/saves/model.bin", "param_001/b/saves/model.bin", "param_002/x/y/saves/cfg.json",
                "param_002/notes.txt", "ck/RoBERTa-base-AO-CHILDES/checkpoint_last_3.pt"]:
        f = tmp_path / rel
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
    runs = RG.list_saved_runs(spark, str(tmp_path))
    got = sorted((r["param_name"], r["path"].split(str(tmp_path))[1]) for r in runs.collect())
    assert got == [("param_001", "/param_001/a/saves/"), ("param_001", "/param_001/b/saves/"),
                   ("param_002", "/param_002/x/y/saves/")]
    reps = {r["path"].split("/")[-3]: r["rep"] for r in RG.replication_numbers(runs).collect()}
    assert reps == {"a": 0, "b": 1, "y": 0}
    ck = RG.list_checkpoints(spark, str(tmp_path)).collect()[0]
    assert ck["dir_name"] == "RoBERTa-base-AO-CHILDES" and ck["file_name"] == "checkpoint_last_3.pt"


def test_scorer_ragged_rows(spark):
    rows = [(1, 0, 1, [0.5, 2.0]), (1, 1, 2, [1.0, -1.0, 3.0])]
    df = spark.createDataFrame(rows, "sent_id long, pos int, label int, logits array<double>")
    got = {r[1]: r[2] for r in run_scorer(df.coalesce(1), LogitsScorer(), ["sent_id", "pos"]).collect()}
    for _, p, lab, x in rows:
        x = np.asarray(x)
        assert math.isclose(got[p], x[lab] - np.log(np.exp(x).sum()), rel_tol=1e-12)


def test_universal_newlines(spark, tmp_path):
    from minpair.sources.suites import scan_corpus, scan_suite
    (tmp_path / "par.txt").write_bytes(b"a b\r\nc\rd\n e")
    got = [r["sentence"] for r in scan_corpus(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert got == ["a b", "c", "d", "e"]
    assert [r["sentence"] for r in scan_suite(spark, str(tmp_path)).orderBy("line_no").collect()] == ["a b", "c", "d", " e"]


def test_checkpoint_registry_rejects_unknown_corpora(spark):
    import pytest
    from minpair.sources import registry as RG
    files = spark.createDataFrame([("X-AO-CHILDES", "checkpoint_last_3.pt", "/a"), ("X-other", "checkpoint_last_1.pt", "/b")],
                                  "dir_name string, file_name string, path string")
    ok = RG.checkpoint_registry(files, strict=False).collect()
    assert [(r["corpora"], r["rep"], r["case_sensitive"]) for r in ok] == [("AO-CHILDES", 3, True)]
    assert RG.invalid_checkpoints(files).count() == 1
    with pytest.raises(Exception, match="unknown corpora"):
        RG.checkpoint_registry(files).collect()


def test_cluster_without_shared_folder_is_an_error():
    import pytest
    from minpair import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())
