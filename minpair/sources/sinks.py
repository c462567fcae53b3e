"""Results files and sidecars.

The long Parquet table is canonical; CSV (wide) is for interchange with
tools that expect the published layout. Scratch locations live under the
session's checkpoint directory (shared storage on a cluster).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minpair.functions.text import round_half_even
from minpair.session import checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh directory under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _exists(spark: SparkSession, path: str) -> bool:
    """Path existence through the Hadoop file system of the session (any
    scheme); plain local check when there is no JVM gateway."""
    try:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        return bool(jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path))
    except Exception:  # noqa: BLE001
        import os
        return os.path.exists(path)


def write_results_csv(wide: DataFrame, path: str) -> None:
    """A5: wide results as CSV with a header, no index column."""
    wide.write.mode("overwrite").option("header", True).csv(path)


def read_results_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
                     missing_ok: bool = True) -> DataFrame:
    """A4: read results CSV; an absent path gives an empty frame with
    ``schema`` when ``missing_ok`` (scorer), else raises (summaries)."""
    if not _exists(spark, path):
        if missing_ok and schema is not None:
            return spark.createDataFrame([], schema)
        raise FileNotFoundError(f"Did not find {path}")
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def write_results_long(long: DataFrame, path: str, mode: str = "append") -> None:
    """A5 canonical sink: long Parquet, partitioned by method."""
    long.write.mode(mode).partitionBy("scoring_method").parquet(path)


def scored_sentence_lines(scores: DataFrame, text_col: str = "sentence", score_col: str = "score") -> DataFrame:
    """``"{sentence} {score:.4f}"`` per sentence (rounded half-even first,
    like Python formatting of the stored double)."""
    return scores.select(F.format_string("%s %.4f", F.col(text_col),
                                         round_half_even(score_col, 4)).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


def write_params_json(params: DataFrame, path: str, key: str = "param_name") -> None:
    """One JSON document per parameter set, under ``key=<value>/``."""
    params.repartition(key).write.mode("overwrite").partitionBy(key).json(path)


def read_params_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read parameter documents (each file one JSON object)."""
    r = spark.read.option("multiLine", True)
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)
