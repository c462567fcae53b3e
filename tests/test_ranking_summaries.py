"""Distributed row numbers and grouped statistics against plain Python."""
import math
import random
import statistics

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from minpair.operators import summaries as SM
from minpair.operators.ranking import range_row_number
from minpair.sources.dims import T_CRITICAL_090


def test_range_row_number_matches_window_with_hot_group(spark):
    rnd = random.Random(7)
    rows = [("hot" if rnd.random() < 0.6 else f"g{rnd.randint(0, 20)}", i, rnd.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, id long, x double").repartition(5)
    mine = range_row_number(df, ["g"], ["x", "id"], name="rn", base=0, num_partitions=7)
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("x", "id")) - 1)
    assert sorted(map(tuple, mine.select("id", "rn").collect())) == sorted(map(tuple, ref.select("id", "rn").collect()))
    glob = range_row_number(df, [], [F.col("x").desc(), "id"], name="rk", base=1)
    ranks = {r["id"]: r["rk"] for r in glob.collect()}
    order = [r[1] for r in sorted(rows, key=lambda t: (-t[2], t[1]))]
    assert [ranks[i] for i in order] == list(range(1, 3001))


def _long(spark, rows):
    return spark.createDataFrame(rows, "model string, corpora string, rep int, path string, "
                                       "scoring_method string, paradigm string, accuracy double")


def test_margin_of_error_and_box_stats(spark):
    rnd = random.Random(3)
    paradigms = ["binding-principle_a", "irregular-verb", "ellipsis-n_bar", "case-subjective_pronoun"]
    rows = [("M", "C", rep, f"p{rep}", "holistic", p, round(rnd.uniform(40, 100), 2))
            for rep in range(4) for p in paradigms]
    long = _long(spark, rows)
    tmap = dict(T_CRITICAL_090)
    reps = [statistics.mean(r[6] for r in rows if r[2] == rep) for rep in range(4)]
    m = SM.margin_of_error_reps(long, "holistic").collect()[0]
    h = statistics.stdev(reps) / math.sqrt(4) * tmap[3]
    assert math.isclose(m["accuracy"], statistics.mean(reps)) and math.isclose(m["margin"], h) and m["n"] == 4
    pmeans = [statistics.mean(r[6] for r in rows if r[5] == p) for p in paradigms]
    b = SM.box_stats(long, "holistic").collect()[0]
    q1, med, q3 = np.percentile(pmeans, [25, 50, 75])
    assert math.isclose(b["q1"], q1) and math.isclose(b["median"], med) and math.isclose(b["q3"], q3)
    inside = [x for x in pmeans if q1 - 1.5 * (q3 - q1) <= x <= q3 + 1.5 * (q3 - q1)]
    assert math.isclose(b["whislo"], min(min(inside), q1)) and math.isclose(b["whishi"], max(max(inside), q3))


def test_single_rep_margin_is_null_and_propagate(spark):
    long = _long(spark, [("M", "C", 0, "p0", "holistic", "irregular-verb", 80.0),
                         ("M", "C", 0, "p0", "holistic", "ellipsis-n_bar", None)])
    assert SM.margin_of_error_reps(long, "holistic").collect()[0]["margin"] is None
    prop = SM.rep_means(long, "holistic", missing="propagate").collect()[0]["accuracy"]
    assert math.isnan(prop)
    assert SM.rep_means(long, "holistic").collect()[0]["accuracy"] == 80.0


def test_phenomenon_weighting(spark):
    # two subject-verb paradigms (4 in the suite) and one binding paradigm (1 in the suite)
    rows = [("M", "C", 0, "p", "mlm", "agreement_subject_verb-across_relative_clause", 60.0),
            ("M", "C", 0, "p", "mlm", "binding-principle_a", 90.0)]
    long = _long(spark, rows)
    by_par = SM.phenomenon_over_reps(long, weighting="paradigm").collect()[0]["overall"]
    by_ph = SM.phenomenon_over_reps(long, weighting="phenomenon").collect()[0]["overall"]
    assert by_par == round((60 * 4 + 90 * 1) / 5, 1) and by_ph == 75.0


def test_missing_keys_are_dropped_like_pandas(spark):
    long = _long(spark, [("M", None, 0, "p0", "holistic", "irregular-verb", 80.0),
                         ("M", "C", 0, "p1", "holistic", "irregular-verb", 60.0)])
    assert [r["group_name"] for r in SM.group_names(long).collect()] == ["M+C"]
    r = SM.margin_of_error_reps(long, "holistic").collect()
    assert len(r) == 1 and r[0]["accuracy"] == 60.0
    assert SM.phenomenon_over_reps(long.where("corpora is null or corpora = 'C'")).count() == 1


def test_range_row_number_null_groups(spark):
    rows = [(None if i % 5 == 0 else f"g{i % 3}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, id long").repartition(4)
    mine = range_row_number(df, ["g"], ["id"], name="rn", base=1, num_partitions=5)
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("id")))
    assert sorted(map(tuple, mine.select("id", "rn").collect())) == sorted(map(tuple, ref.select("id", "rn").collect()))


def test_margin_for_any_df_and_confidence(spark):
    """Against published t values, and no NULL beyond the old table's end."""
    from minpair.sources.dims import t_critical_expr, t_quantile
    for df, p, t in [(1, 0.975, 12.706205), (7, 0.995, 3.499483), (34, 0.95, 1.690924), (100, 0.975, 1.983972)]:
        assert abs(t_quantile(p, df) - t) < 1e-6
    got = {r[0]: r[1] for r in spark.range(1, 401).select("id", t_critical_expr(F.col("id")).alias("t")).collect()}
    for k, v in T_CRITICAL_090:
        assert got[k] == v
    assert abs(got[200] - 1.652508) < 2e-6 and abs(got[400] - 1.648672) < 2e-6
    rows = [("M", "C", rep, f"p{rep}", "holistic", "irregular-verb", 50.0 + rep) for rep in range(35)]
    assert SM.margin_of_error_reps(_long(spark, rows), "holistic").collect()[0]["margin"] is not None


def test_missing_cell_propagates_through_the_margin(spark):
    rows = [("M", "C", 0, "p0", "holistic", "irregular-verb", 60.0), ("M", "C", 1, "p1", "holistic", "irregular-verb", 70.0),
            ("M", "C", 2, "p2", "holistic", "irregular-verb", None)]
    m = SM.margin_of_error_reps(_long(spark, rows), "holistic", missing="propagate").collect()[0]
    assert math.isnan(m["accuracy"]) and math.isnan(m["margin"])
