"""Structured Streaming jobs on files landed in a temporary directory."""
from pyspark.sql import functions as F

from minpair.streaming import results as SR
from minpair.streaming import scores as SS


def _long(spark, rows):
    return spark.createDataFrame(rows, "model string, corpora string, rep int, path string, "
                                       "scoring_method string, paradigm string, accuracy double")


def test_results_stream_first_row_wins(spark, tmp_path):
    landing = str(tmp_path / "landing")
    old = _long(spark, [("m", "c", 0, "m/c/0", "mlm", "p", 50.0), ("m", "c", 1, "m/c/1", "mlm", "p", 60.0)])
    new = _long(spark, [("m", "c", 1, "m/c/1", "mlm", "p", 99.0), ("m", "c", 2, "m/c/2", "mlm", "p", 70.0)])
    old.coalesce(1).write.mode("append").parquet(landing)
    new.coalesce(1).write.mode("append").parquet(landing)
    q = SR.results_dedup_stream(spark, landing, old.schema, str(tmp_path / "sink"), str(tmp_path / "ck"),
                                max_files_per_trigger=1)
    SR.run_to_completion(q)
    got = {r["rep"]: r["accuracy"] for r in SR.read_sink(spark, str(tmp_path / "sink")).collect()}
    assert got == {0: 50.0, 1: 60.0, 2: 70.0}


def test_sentence_score_stream_sums_batches(spark, tmp_path):
    landing = str(tmp_path / "tok")
    rows = [(1, 0, -1.0), (1, 1, -2.0), (2, 0, -0.5), (1, 2, -0.25)]
    df = spark.createDataFrame(rows, "sent_id long, pos int, logprob double")
    for p in range(3):
        df.where(F.col("pos") == p).coalesce(1).write.mode("append").parquet(landing)
    q = SS.sentence_score_stream(spark, landing, df.schema, str(tmp_path / "sink"), str(tmp_path / "ck"),
                                 ["sent_id"], max_files_per_trigger=1)
    SR.run_to_completion(q)
    got = {r["sent_id"]: (r["score"], r["n_tokens"]) for r in SS.current_scores(spark, str(tmp_path / "sink"), ["sent_id"]).collect()}
    assert got == {1: (-3.25, 3), 2: (-0.5, 1)}


def test_results_stream_first_row_wins_inside_a_batch(spark, tmp_path):
    landing = str(tmp_path / "landing")
    for acc in (10.0, 90.0, 5.0):
        _long(spark, [("m", "c", 0, "m/c/0", "mlm", "p", acc)]).coalesce(1).write.mode("append").parquet(landing)
        import time
        time.sleep(0.05)
    q = SR.results_dedup_stream(spark, landing, spark.read.parquet(landing).schema, str(tmp_path / "sink"), str(tmp_path / "ck"))
    SR.run_to_completion(q)
    assert [r["accuracy"] for r in SR.read_sink(spark, str(tmp_path / "sink")).collect()] == [10.0]


def test_wait_with_a_limit_raises(spark):
    import pytest

    class Slow:
        stopped = False

        def awaitTermination(self, timeout=None):
            return False

        def stop(self):
            self.stopped = True

    q = Slow()
    with pytest.raises(TimeoutError):
        SR.run_to_completion(q, 1)
    assert q.stopped


def _land(spark, landing, *rows):
    _long(spark, [("m", "c", rep, f"m/c/{rep}", "mlm", "p", acc) for rep, acc in rows]).coalesce(1).write.mode("append").parquet(landing)


def _dedup(spark, tmp_path, sink="sink", checkpoint="ck", **options):
    landing = str(tmp_path / "landing")
    q = SR.results_dedup_stream(spark, landing, _long(spark, []).schema, str(tmp_path / sink), str(tmp_path / checkpoint), **options)
    SR.run_to_completion(q)
    rows = [(r["rep"], r["accuracy"]) for r in SR.read_sink(spark, str(tmp_path / sink)).collect()]
    return sorted(rows, key=lambda r: -1 if r[0] is None else r[0])


def test_results_stream_reads_its_state_not_its_sink(spark, tmp_path):
    _land(spark, str(tmp_path / "landing"), (0, 50.0), (1, 60.0))
    assert _dedup(spark, tmp_path) == [(0, 50.0), (1, 60.0)]
    _land(spark, str(tmp_path / "landing"), (1, 99.0), (2, 70.0), (None, 1.0), (None, 2.0))
    # same checkpoint, an empty sink: only the state can tell that rep 1 is known
    assert _dedup(spark, tmp_path, sink="other") == [(None, 1.0), (2, 70.0)]


def test_results_stream_with_a_new_checkpoint_keeps_earlier_rows(spark, tmp_path):
    _land(spark, str(tmp_path / "landing"), (0, 50.0), (1, float("nan")))
    first = _dedup(spark, tmp_path)
    assert [r for r, _ in first] == [0, 1]
    later = tmp_path / "later"
    _land(spark, str(later / "landing"), (0, 11.0), (1, 12.0), (2, 13.0))
    _land(spark, str(later / "landing"), (2, 14.0))
    q = SR.results_dedup_stream(spark, str(later / "landing"), _long(spark, []).schema, str(tmp_path / "sink"),
                                str(tmp_path / "ck2"), max_files_per_trigger=1)
    SR.run_to_completion(q)
    got = {r["rep"]: r["accuracy"] for r in SR.read_sink(spark, str(tmp_path / "sink")).collect()}
    assert got[0] == 50.0 and got[1] != got[1] and got[2] == 13.0 and len(got) == 3


def _complete(spark, tmp_path, rows, timeout_s=None, parts=None):
    landing = str(tmp_path / "tok")
    df = spark.createDataFrame(rows, "sent_id long, pos int, logprob double, n_expected int")
    for p in parts if parts is not None else sorted({r[1] for r in rows}):
        df.where(F.col("pos") == p).coalesce(1).write.mode("append").parquet(landing)
    q = SS.complete_score_stream(spark, landing, df.schema, str(tmp_path / "sink"), str(tmp_path / "ck"), ["sent_id"],
                                 timeout_s=timeout_s)
    SR.run_to_completion(q)
    return sorted(map(tuple, SR.read_sink(spark, str(tmp_path / "sink")).select("sent_id", "score", "n_tokens", "complete").collect()),
                  key=str)


def test_complete_scores_come_once_and_leave_no_state(spark, tmp_path):
    rows = [(1, 0, -1.0, 3), (1, 1, -2.0, 3), (2, 0, -0.5, 1), (1, 2, None, 3), (None, 1, -4.0, 1)]
    assert _complete(spark, tmp_path, rows) == [(1, -3.0, 3, True), (2, -0.5, 1, True), (None, -4.0, 1, True)]
    assert spark.read.format("statestore").load(str(tmp_path / "ck")).count() == 0


def test_incomplete_sentences_leave_by_timer(spark, tmp_path):
    import time
    rows = [(1, 0, -1.0, 3), (2, 0, float("nan"), 1), (3, 1, -0.25, 1), (4, 0, -2.0, None),
            (5, 0, float("nan"), 2), (5, 1, -1.0, 2)]
    got = _complete(spark, tmp_path, rows, timeout_s=0.2, parts=[0])
    assert [(r[0], r[3]) for r in got] == [(2, True)]
    time.sleep(0.5)
    got = {r[0]: r[1:] for r in _complete(spark, tmp_path, rows, timeout_s=0.2, parts=[1])}
    assert got[1] == (-1.0, 1, False) and got[4] == (-2.0, 1, False) and got[3] == (-0.25, 1, True)
    assert got[2] == (None, 1, True) and got[5] == (None, 2, True) and len(got) == 5
    assert spark.read.format("statestore").load(str(tmp_path / "ck")).count() == 0


def test_landed_files_follow_bytes_not_tasks(spark, tmp_path):
    """Sixteen tasks with all eight positions each land eight files, not 128: the stream has a few micro-batches."""
    from pathlib import Path

    from minpair.plans.catalog import _land_by_position
    toks = spark.range(0, 8000, 1, 16).selectExpr("id div 8 as sent_id", "cast(id % 8 as int) as pos", "-1.0D as logprob")
    _land_by_position(toks, f"{tmp_path}/landed")
    assert len(list(Path(f"{tmp_path}/landed").glob("pos=*/part-*.parquet"))) == 8
    assert spark.read.parquet(f"{tmp_path}/landed").count() == 8000
