"""Grouped statistics over results (F4-F14, I4, K10, rollup).

Each is one or two hash aggregations; groups are (model, corpora[, method]) or
(group, paradigm), all small. Missing cells follow ``missing``:
``'skip'`` (SQL/pandas: NULL ignored) or ``'propagate'`` (NumPy: any missing
value makes the statistic NaN).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minpair.functions.numeric import exact_avg, exact_weighted_mean
from minpair.functions.text import group_name, report_line, round_half_even
from minpair.operators.results import KEYS, phenomenon_join
from minpair.sources.dims import suite_paradigms, t_critical_expr

CONFIDENCE = 0.90
CHANCE = 50.0
MISSING = ("skip", "propagate")


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose grouping keys are all present (grouping like pandas, which
    drops rows with a missing key, rather than SQL, which groups NULLs)."""
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df.where(cond) if cond is not None else df


def _mean(c: str, missing: str) -> Column:
    if missing not in MISSING:
        raise ValueError(f"missing must be one of {MISSING}")
    m = exact_avg(c)
    if missing == "propagate":
        m = F.when(F.count(c) < F.count(F.lit(1)), F.lit(float("nan"))).otherwise(m)
    return m


def margin_of_error(values: str, confidence: float = 0.90, missing: str = "skip") -> list[Column]:
    """mean, n and sem * t(n - 1) of a column inside an aggregation; the margin
    is NULL when n < 2. A NaN among the values makes mean and margin NaN, and so
    does a missing one with ``missing='propagate'``."""
    n = F.count(values)
    sem = F.stddev_samp(values) / F.sqrt(n)
    h = F.when(n > 1, sem * t_critical_expr(n - 1, confidence))
    if missing == "propagate":
        h = F.when(n < F.count(F.lit(1)), F.lit(float("nan"))).otherwise(h)
    return [_mean(values, missing).alias("accuracy"), n.alias("n"), h.alias("margin")]


def phenomenon_accuracy(long: DataFrame, suite: str = "suite23", keys: list[str] = KEYS) -> DataFrame:
    """mean accuracy of a phenomenon's paradigms per result row, rounded
    to 1 decimal half-even."""
    j = phenomenon_join(long, suite)
    return j.groupBy(*keys, "phenomenon").agg(round_half_even(exact_avg("accuracy"), 1).alias("accuracy"))


def phenomenon_over_reps(long: DataFrame, suite: str = "suite23", how: str = "mean",
                         weighting: str = "paradigm") -> DataFrame:
    """per (model, corpora, method): each phenomenon's mean (or max)
    over replications, then the overall mean across phenomena, rounded to 1.

    ``weighting='paradigm'`` weights a phenomenon by its number of paradigm
    files in the suite (the published summary repeats a phenomenon once per
    paradigm); ``'phenomenon'`` weights them equally.
    """
    if how not in ("mean", "max"):
        raise ValueError("how must be 'mean' or 'max'")
    if weighting not in ("paradigm", "phenomenon"):
        raise ValueError("weighting must be 'paradigm' or 'phenomenon'")
    ph = _keyed(phenomenon_accuracy(long, suite), ["model", "corpora", "scoring_method"])
    agg = exact_avg("accuracy") if how == "mean" else F.max("accuracy")
    per = ph.groupBy("model", "corpora", "scoring_method", "phenomenon").agg(agg.alias("value"))
    counts: dict[str, int] = {}
    for _, p in suite_paradigms(suite):
        counts[p] = counts.get(p, 0) + 1
    if weighting == "paradigm":
        flat = []
        for k, v in counts.items():
            flat += [F.lit(k), F.lit(float(v))]
        w = F.try_element_at(F.create_map(*flat), F.col("phenomenon"))
    else:
        w = F.lit(1.0)
    overall = exact_weighted_mean("value", w)
    return (per.groupBy("model", "corpora", "scoring_method")
               .agg(round_half_even(overall, 1).alias("overall"))
               .orderBy(F.col("overall").asc_nulls_last(), "model", "corpora", "scoring_method"))


def replication_summary(wide: DataFrame) -> DataFrame:
    """min / max / mean / count of ``overall`` per (model, corpora, method),
    rounded to 1 (count is the non-null count)."""
    return _keyed(wide, ["model", "corpora", "scoring_method"]).groupBy("model", "corpora", "scoring_method").agg(
        round_half_even(F.min("overall"), 1).alias("min"),
        round_half_even(F.max("overall"), 1).alias("max"),
        round_half_even(exact_avg("overall"), 1).alias("mean"),
        F.count("overall").alias("count")).orderBy(F.col("mean").asc_nulls_last(), "model", "corpora",
                                                   "scoring_method")


def replication_rollup(wide: DataFrame) -> DataFrame:
    """Extra: subtotals of F7 over (model, corpora, method) with ROLLUP.

    Reports the sum and count of ``overall`` (exact on the 2-decimal grid of
    the stored values), from which each level's mean follows."""
    return wide.rollup("model", "corpora", "scoring_method").agg(
        F.round(F.sum("overall"), 4).alias("sum_overall"), F.count("overall").alias("count"),
        F.grouping_id().alias("level"))


def with_group(long: DataFrame) -> DataFrame:
    """K4/F14 column; rows without a group name (missing model or corpora)
    are dropped, as a grouping by group name would."""
    return _keyed(long.withColumn("group_name", group_name("model", "corpora")), ["group_name"])


def group_names(long: DataFrame) -> DataFrame:
    """distinct group names."""
    return with_group(long).select("group_name").distinct()


def rep_means(long: DataFrame, method: str, missing: str = "skip") -> DataFrame:
    """F8: per group and replication (rep, path), mean over paradigms."""
    f = with_group(long.where(F.col("scoring_method") == method))
    return f.groupBy("group_name", "rep", "path").agg(_mean("accuracy", missing).alias("accuracy"))


def margin_of_error_reps(long: DataFrame, method: str, missing: str = "skip") -> DataFrame:
    """per group, mean of replication means, n replications, margin."""
    r = rep_means(long, method, missing).withColumnRenamed("accuracy", "rep_accuracy")
    return r.groupBy("group_name").agg(*margin_of_error("rep_accuracy"))


def report_lines(long: DataFrame, method: str) -> DataFrame:
    """One formatted line per group (values rounded half-even first)."""
    m = margin_of_error_reps(long, method)
    return m.select("group_name", report_line("group_name", round_half_even("accuracy", 2), "n",
                                              round_half_even("margin", 2)).alias("line"))


def paradigm_mean_moe(long: DataFrame, method: str, missing: str = "skip") -> DataFrame:
    """per (group, paradigm): mean across replications, n, margin."""
    f = with_group(long.where(F.col("scoring_method") == method))
    return f.groupBy("group_name", "paradigm").agg(*margin_of_error("accuracy", missing=missing))


def paradigm_means(long: DataFrame, method: str, missing: str = "skip") -> DataFrame:
    f = with_group(long.where(F.col("scoring_method") == method))
    return f.groupBy("group_name", "paradigm").agg(_mean("accuracy", missing).alias("paradigm_accuracy"))


def margin_of_error_paradigms(long: DataFrame, method: str, missing: str = "skip") -> DataFrame:
    """per group, mean over paradigms of the replication-mean, and the
    margin of error across paradigms."""
    return paradigm_means(long, method, missing).groupBy("group_name").agg(*margin_of_error("paradigm_accuracy", missing=missing))


def box_stats(long: DataFrame, method: str) -> DataFrame:
    """box statistics of paradigm means per group.

    Quartiles by linear interpolation; whiskers are the most extreme values
    within 1.5 IQR of the box, never inside the box; ``chance`` = 50.
    """
    pm = paradigm_means(long, method)
    q = pm.groupBy("group_name").agg(
        F.percentile("paradigm_accuracy", [0.25, 0.5, 0.75]).alias("_q"),
        exact_avg("paradigm_accuracy").alias("mean"), F.count("paradigm_accuracy").alias("n"))
    q = q.select("group_name", "n", "mean", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"),
                 F.col("_q")[2].alias("q3"))
    j = pm.join(q, "group_name")
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    x = F.col("paradigm_accuracy")
    w = j.groupBy("group_name", "n", "mean", "q1", "median", "q3").agg(
        F.min(F.when(x >= lo_f, x)).alias("_lo"), F.max(F.when(x <= hi_f, x)).alias("_hi"))
    whislo = F.when(F.col("_lo").isNull() | (F.col("_lo") > F.col("q1")), F.col("q1")).otherwise(F.col("_lo"))
    whishi = F.when(F.col("_hi").isNull() | (F.col("_hi") < F.col("q3")), F.col("q3")).otherwise(F.col("_hi"))
    return w.select("group_name", "n", "mean", "q1", "median", "q3", whislo.alias("whislo"),
                    whishi.alias("whishi"), F.lit(CHANCE).alias("chance"))


def phenomenon_paradigms(long: DataFrame, suite: str = "suite23") -> DataFrame:
    """phenomenon -> its paradigms present in the results, sorted, joined by ', '."""
    j = phenomenon_join(long.select("paradigm").distinct(), suite)
    return j.groupBy("phenomenon").agg(
        F.array_join(F.sort_array(F.collect_list("paradigm")), ", ").alias("paradigms"),
        F.count(F.lit(1)).alias("n_paradigms"))


def best_replication(wide: DataFrame) -> DataFrame:
    """I4: per (model, corpora, method), the replication with the highest
    overall; ties go to the higher rep, then the later path."""
    best = F.max(F.struct("overall", "rep", "path"))
    return (_keyed(wide, ["model", "corpora", "scoring_method"]).groupBy("model", "corpora", "scoring_method").agg(best.alias("_b"))
                .select("model", "corpora", "scoring_method", F.col("_b.overall").alias("best_overall"),
                        F.col("_b.rep").alias("best_rep"), F.col("_b.path").alias("best_path")))
