"""Driver tables: one Parquet file per table under an ``sf_dir``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read one table; selecting ``columns`` here lets the scan prune the rest."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Default size of a scan split.
SPLIT_BYTES = 128 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition the rows over the cluster's cores when a scan yields
    fewer partitions than that (a small single-row-group file gives one task).

    The size comes from the plan's statistics, so nothing runs while a plan is
    built. A scan estimated to fill every core with a split of its own, or of a file
    for each core, passes through unchanged: no shuffle is added at scale. Hash partitioning (on
    ``keys``, else on all columns) is deterministic on retry.
    """
    try:
        spark = df.sparkSession
        cores = spark.sparkContext.defaultParallelism
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - no JVM plan (Spark Connect): leave as is
        return df
    if size >= cores * SPLIT_BYTES or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores, *(keys or df.columns))
