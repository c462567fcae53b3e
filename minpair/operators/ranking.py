"""Row numbers within groups without a one-task-per-group window.

``row_number() over (partition by P order by O)`` sends every row of a group
to one task. With a hot group (a paradigm holding a third of all lines, or a
global vocabulary rank with no group at all) that task holds a third of the
data. Here the rows are range-partitioned on (P, O) instead, so a hot group
is spread over many contiguous, sorted partitions; each partition numbers its
rows locally and a small table of per-(partition, group) counts supplies the
offsets. The result equals the window function's for a total order O.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minpair.session import durable_checkpoint

_LOCAL_BITS = 33  # monotonically_increasing_id = (partition index << 33) + record number


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def range_row_number(df: DataFrame, partition_by: list[str], order_by: list,
                     name: str = "row_number", base: int = 1,
                     num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = row number of each row within ``partition_by`` by ``order_by``.

    ``base`` is the first number (1 like SQL, 0 for line numbers).
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in partition_by] + [_as_col(c) for c in order_by]
    ranged = (df.repartitionByRange(n, *keys)
                .sortWithinPartitions(*keys)
                .withColumn("_rk_id", F.monotonically_increasing_id()))
    # The ids depend on the physical layout; both consumers below must read the
    # same materialisation, also after a lost executor re-runs a stage.
    ranged = durable_checkpoint(ranged)
    ranged = (ranged.withColumn("_rk_pid", F.shiftright("_rk_id", _LOCAL_BITS))
                    .withColumn("_rk_local", F.col("_rk_id") - F.shiftleft("_rk_pid", _LOCAL_BITS)))

    # At most (partitions + groups) rows: one per group fragment.
    stats = (ranged.groupBy("_rk_pid", *partition_by)
                   .agg(F.min("_rk_local").alias("_rk_first"),
                        F.count(F.lit(1)).alias("_rk_cnt")))
    w = (Window.partitionBy(*partition_by) if partition_by else Window.partitionBy(F.lit(0)))
    w = w.orderBy("_rk_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_rk_before", F.coalesce(F.sum("_rk_cnt").over(w), F.lit(0)))
    stats = stats.select(*[F.col(c).alias(f"_rk_g_{c}") for c in partition_by],
                         F.col("_rk_pid").alias("_rk_g_pid"), "_rk_first", "_rk_before")

    cond = [F.col("_rk_pid") == F.col("_rk_g_pid")]
    cond += [F.col(c).eqNullSafe(F.col(f"_rk_g_{c}")) for c in partition_by]
    joined = ranged.join(stats, reduce(lambda a, b: a & b, cond), "inner")
    rn = (F.col("_rk_before") + F.col("_rk_local") - F.col("_rk_first") + F.lit(base)).cast("long")
    return joined.select(*df.columns, rn.alias(name))
