"""The results table: long form is canonical, wide form is a pivot of it.

long = (model, corpora, rep, path, scoring_method, paradigm, accuracy)
wide = 5 key columns + one column per paradigm + overall

Results tables have one row per (model, method, paradigm), tiny next to the
scored text; the phenomenon dimension has a fixed size and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minpair.functions.numeric import exact_avg
from minpair.functions.text import group_name
from minpair.sources.dims import phenomena

KEYS = ["model", "corpora", "rep", "path", "scoring_method"]


def phenomenon_join(long: DataFrame, suite: str = "suite23") -> DataFrame:
    """Add ``phenomenon`` by equi-join on the paradigm file name."""
    dim = phenomena(long.sparkSession, suite).select("paradigm", "phenomenon")
    return long.join(F.broadcast(dim), "paradigm", "inner")


def results_wide(long: DataFrame, paradigms: list[str], keys: list[str] = KEYS,
                 value: str = "accuracy", overall_decimals: int | None = None) -> DataFrame:
    """G1 + F3 + I1: one row per key, one column per paradigm, and ``overall``.

    A pivot with the explicit value list, written as conditional aggregates so
    the row mean (``overall``, NULL cells skipped) comes out of the same single
    hash aggregation. Sorted by overall ascending, missing last.
    """
    cells = [F.max(F.when(F.col("paradigm") == p, F.col(value))).alias(p) for p in paradigms]
    overall = exact_avg(F.when(F.col("paradigm").isin(paradigms), F.col(value)))
    if overall_decimals is not None:
        overall = F.rint(overall * F.lit(10.0 ** overall_decimals)) / F.lit(10.0 ** overall_decimals)
    wide = long.groupBy(*keys).agg(*cells, overall.alias("overall"))
    return wide.orderBy(F.col("overall").asc_nulls_last(), *keys)


def results_unpivot(wide: DataFrame, paradigms: list[str], keys: list[str] = KEYS,
                    value: str = "accuracy") -> DataFrame:
    """Wide -> long; missing cells stay as NULL rows."""
    return wide.unpivot(keys, paradigms, "paradigm", value)


def results_dedup(old: DataFrame, new: DataFrame, keys: list[str] = KEYS,
                  seq_col: str | None = None) -> DataFrame:
    """H2: concatenate old then new; the first row per key wins.

    One hash aggregation with ``min_by`` on (source, seq) instead of a sort
    window; ``seq_col`` orders rows inside each source (NULL = unordered).
    """
    vals = [c for c in old.columns if c not in keys]
    seq = F.col(seq_col) if seq_col else F.lit(0)
    tagged = (old.select(*keys, *vals, F.lit(0).alias("_src"), seq.alias("_seq"))
                 .unionByName(new.select(*keys, *vals, F.lit(1).alias("_src"), seq.alias("_seq"))))
    best = F.min_by(F.struct(*vals), F.struct("_src", "_seq"))
    return tagged.groupBy(*keys).agg(best.alias("_row")).select(*keys, *[F.col(f"_row.{v}").alias(v) for v in vals])


def results_union(frames: list[DataFrame]) -> DataFrame:
    """Outer union by column name; columns sorted by name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def method_index(prefix: str) -> F.Column:
    """``path`` for groups whose name starts with ``prefix``, else ``rep``."""
    g = group_name("model", "corpora")
    return F.when(F.startswith(g, F.lit(prefix)), F.col("path")).otherwise(F.col("rep").cast("string"))


def method_pivot(wide: DataFrame, prefix: str, value: str = "overall") -> DataFrame:
    """Per group and index, one column per scoring method.

    (group_name, idx, holistic, mlm). A repeated (index, method), which a
    strict pivot would reject, is listed by ``method_pivot_duplicates``.
    """
    base = wide.select(group_name("model", "corpora").alias("group_name"),
                       method_index(prefix).alias("idx"), "scoring_method", value)
    return (base.groupBy("group_name", "idx")
                .pivot("scoring_method", ["holistic", "mlm"])
                .agg(F.max(value))
                .orderBy("group_name", F.col("holistic").asc_nulls_last(), "idx"))


def method_pivot_duplicates(wide: DataFrame, prefix: str) -> DataFrame:
    base = wide.select(group_name("model", "corpora").alias("group_name"),
                       method_index(prefix).alias("idx"), "scoring_method")
    return (base.groupBy("group_name", "idx", "scoring_method").agg(F.count(F.lit(1)).alias("n_rows"))
                .where(F.col("n_rows") > 1))


def unscored(requested: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Requested combinations not yet in the results (exact key equality)."""
    return requested.join(existing.select(*keys).distinct(), keys, "left_anti")
