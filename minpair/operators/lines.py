"""Line-level operators on suite tables ``(paradigm, line_no, sentence)``.

B11 expected-count checks, D12 fixed batches, D14 word counts, D16 pair-order
swap, D17 swap invariants. Pairs are located by arithmetic on ``line_no``, so
none of these needs a window over a whole paradigm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minpair.operators.scoring import HOLISTIC_BATCH_SIZE


def line_count_violations(lines: DataFrame, expected: int) -> DataFrame:
    """Paradigms whose line count differs from ``expected`` or is odd.

    (paradigm, n_lines, expected_lines, odd).
    """
    per = lines.groupBy("paradigm").agg(F.count(F.lit(1)).alias("n_lines"))
    return (per.withColumn("expected_lines", F.lit(int(expected)).cast("long"))
               .withColumn("odd", F.col("n_lines") % 2 == 1)
               .where((F.col("n_lines") != F.col("expected_lines")) | F.col("odd")))


def fixed_batches(lines: DataFrame, size: int = HOLISTIC_BATCH_SIZE) -> DataFrame:
    """Consecutive batches of ``size`` lines per paradigm, by arithmetic."""
    return lines.withColumn("batch_id", F.floor(F.col("line_no") / size).cast("long"))


def word_counts(lines: DataFrame, text_col: str = "sentence") -> DataFrame:
    """Words per line (split on one space, like ``str.split(' ')``)."""
    return lines.withColumn("n_words", F.size(F.split(F.col(text_col), " ")).cast("int"))


def swap_pair_order(lines: DataFrame) -> DataFrame:
    """Exchange lines 2i and 2i+1; a last unpaired line is dropped.

    The only aggregate is one row per paradigm (its line count).
    """
    counts = lines.groupBy("paradigm").agg(F.count(F.lit(1)).alias("_n"))
    paired = lines.join(counts, "paradigm").where(
        F.col("line_no") < F.col("_n") - F.col("_n") % 2)
    return paired.select("paradigm", F.col("line_no").bitwiseXOR(F.lit(1)).alias("line_no"),
                         *[c for c in lines.columns if c not in ("paradigm", "line_no")])


def swap_invariants(before: DataFrame, after: DataFrame, text_col: str = "sentence") -> DataFrame:
    """Per paradigm, line and distinct-line counts on both sides, and
    the multiset differences both ways (0 and 0 when only the order changed)."""
    b = before.select("paradigm", text_col)
    a = after.select("paradigm", text_col)
    stats_b = b.groupBy("paradigm").agg(F.count(F.lit(1)).alias("n_before"),
                                        F.count_distinct(text_col).alias("distinct_before"))
    stats_a = a.groupBy("paradigm").agg(F.count(F.lit(1)).alias("n_after"),
                                        F.count_distinct(text_col).alias("distinct_after"))
    missing = b.exceptAll(a).groupBy("paradigm").agg(F.count(F.lit(1)).alias("n_missing"))
    extra = a.exceptAll(b).groupBy("paradigm").agg(F.count(F.lit(1)).alias("n_extra"))
    out = (stats_b.join(stats_a, "paradigm", "full")
                  .join(missing, "paradigm", "left").join(extra, "paradigm", "left"))
    return out.select("paradigm",
                      F.coalesce("n_before", F.lit(0)).alias("n_before"),
                      F.coalesce("n_after", F.lit(0)).alias("n_after"),
                      F.coalesce("distinct_before", F.lit(0)).alias("distinct_before"),
                      F.coalesce("distinct_after", F.lit(0)).alias("distinct_after"),
                      F.coalesce("n_missing", F.lit(0)).alias("n_missing"),
                      F.coalesce("n_extra", F.lit(0)).alias("n_extra"))
