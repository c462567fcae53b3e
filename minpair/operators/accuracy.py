"""Pair accuracy (F1-F3) and the evaluation grid.

Lines 2i (good) and 2i+1 (bad) of a paradigm form pair i. A pair is right when
the good side wins strictly: larger score for ``mlm``, smaller for
``holistic``, compared as they are (scores are summed order-independently). Ties, NaN and NULL scores are wrong. A trailing unpaired line is
ignored. A paradigm without pairs has NULL accuracy.

Plan: hash aggregate by (keys, paradigm, pair) then by (keys, paradigm). Both
aggregate map-side first; the second is tiny. No self-join lines up the sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minpair.functions.numeric import exact_avg

METHODS = ("mlm", "holistic")


def check_method(method: str) -> str:
    if method not in METHODS:
        raise ValueError(f"invalid scoring_method {method!r}; expected one of {METHODS}")
    return method


def _wins(good: Column, bad: Column, method) -> Column:
    clean = ~F.isnan(good) & ~F.isnan(bad)
    if isinstance(method, str):
        cmp = good > bad if check_method(method) == "mlm" else good < bad
    else:
        cmp = (F.when(method == "mlm", good > bad)
                .when(method == "holistic", good < bad)
                .otherwise(F.raise_error(F.concat(F.lit("invalid scoring_method "), method))))
    return F.coalesce(clean & cmp, F.lit(False))


def _sides(scores: DataFrame, keys: list[str] | None, line_col: str, score_col: str) -> DataFrame:
    """One row per pair, complete or not: keys + paradigm, pair_id, good, bad, whole."""
    keys = list(keys or [])
    side = F.col(line_col) % 2
    grouped = scores.groupBy(*keys, "paradigm", F.floor(F.col(line_col) / 2).alias("pair_id")).agg(
        F.max(F.when(side == 0, F.col(score_col))).alias("good"),
        F.max(F.when(side == 1, F.col(score_col))).alias("bad"),
        F.count(F.when(side == 0, F.lit(1))).alias("_n_good"),
        F.count(F.when(side == 1, F.lit(1))).alias("_n_bad"),
    )
    return grouped.withColumn("whole", (F.col("_n_good") > 0) & (F.col("_n_bad") > 0)).drop("_n_good", "_n_bad")


def pairs(scores: DataFrame, keys: list[str] | None = None, line_col: str = "line_no",
          score_col: str = "score") -> DataFrame:
    """One row per complete pair: keys + paradigm, pair_id, good, bad."""
    return _sides(scores, keys, line_col, score_col).where("whole").drop("whole")


def pair_accuracy(scores: DataFrame, method="mlm", keys: list[str] | None = None,
                  line_col: str = "line_no", score_col: str = "score",
                  decimals: int | None = 4) -> DataFrame:
    """keys + paradigm, n_pairs, n_correct, accuracy (percent).

    ``method`` is 'mlm', 'holistic', or the name of a column holding it per row
    (then it must be one of ``keys``). A paradigm without a complete pair has
    NULL accuracy.
    """
    keys = list(keys or [])
    if isinstance(method, str) and method in METHODS:
        m = method
    else:
        if method not in keys:
            raise ValueError(f"invalid scoring_method {method!r}")
        m = F.col(method)
    p = _sides(scores, keys, line_col, score_col)
    right = F.col("whole") & _wins(F.col("good"), F.col("bad"), m)
    out = p.groupBy(*keys, "paradigm").agg(
        F.count(F.when(F.col("whole"), F.lit(1))).alias("n_pairs"),
        F.count(F.when(right, F.lit(1))).alias("n_correct"),
    )
    acc = F.try_divide(F.col("n_correct").cast("double"), F.col("n_pairs").cast("double")) * 100.0
    if decimals is not None:
        acc = F.round(acc, decimals)
    return out.withColumn("accuracy", acc)


def overall_accuracy(long: DataFrame, keys: list[str], value: str = "accuracy",
                     decimals: int | None = 4) -> DataFrame:
    """unweighted mean of paradigm accuracies per key; NULL cells skipped."""
    mean = exact_avg(value)
    if decimals is not None:
        mean = F.round(mean, decimals)
    return long.groupBy(*keys).agg(mean.alias("overall"),
                                   F.count(value).alias("n_paradigms"))


def evaluation_grid(models: DataFrame, methods: list[str], paradigms: DataFrame) -> DataFrame:
    """Every (model, method, paradigm) combination.

    All three inputs are small dimensions of bounded size (registry, two
    methods, suite file list), expanded by array explosion rather than joins.
    """
    for m in methods:
        check_method(m)
    # The paradigm list is a fixed suite (tens of files): one bounded array,
    # evaluated once as a scalar subquery and expanded next to every model row.
    para = paradigms.select(F.sort_array(F.collect_list(F.struct(*paradigms.columns)))).scalar()
    return (models.select(*models.columns,
                          F.explode(F.array(*[F.lit(m) for m in methods])).alias("scoring_method"))
                  .select(*models.columns, "scoring_method", F.inline(para)))
