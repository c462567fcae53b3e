"""L1: the results table grown incrementally, first row per key wins.

Each scoring run appends files of long-form rows to a landing directory; the
stream appends the first row per key to the results table. Which row came
first is kept in the state store, one row per key, so a micro-batch costs what
it brings however many came before it; nothing written is read again.
A new checkpoint over a sink that already holds rows takes their keys into its
state once, by a second source, and writes folders of its own.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minpair.operators.results import KEYS


def _or_none(read):
    """What ``read`` gives, or None where its path does not exist."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _adopt_sink(spark: SparkSession, key_schema: T.StructType, sink: str, checkpoint: str) -> str:
    """The name under which this checkpoint writes to the sink. On its first start the
    keys that the sink holds already are written to ``checkpoint``/known. The name is
    written last, so an interrupted start is done again."""
    mark = _or_none(lambda: spark.read.text(f"{checkpoint}/sink-run").first())
    if mark is not None:
        return mark["value"]
    held = _or_none(lambda: spark.read.schema(key_schema).parquet(sink).select(*key_schema.names).distinct())
    if held is None:
        held = spark.createDataFrame([], key_schema)
    held.write.mode("overwrite").parquet(f"{checkpoint}/known")
    run = f"r{uuid.uuid4().hex}"
    spark.createDataFrame([(run,)], "value string").coalesce(1).write.mode("overwrite").text(f"{checkpoint}/sink-run")
    return run


def results_dedup_stream(spark: SparkSession, landing: str, schema: T.StructType, sink: str,
                         checkpoint: str, keys: list[str] | None = None,
                         max_files_per_trigger: int | None = None):
    """Start the dedup stream (``availableNow``) and return the query handle.

    Rows of an earlier micro-batch win, then, within one, those of the earliest
    file (by modification time, then path, then the row's own values). A row
    whose key the sink held when the checkpoint began never wins. A batch
    overwrites its own folder, so a replay after a failure writes the same
    rows. Batch times, which Spark keeps in the checkpoint, tell whether a key
    is new; the driver's clock must not run backwards between micro-batches.
    NULL keys are equal to each other.
    """
    keys = keys or KEYS + ["paradigm"]
    rest = [c for c in schema.names if c not in keys]
    key_schema = T.StructType([schema[k] for k in keys])
    run = _adopt_sink(spark, key_schema, sink, checkpoint)
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    landed = reader.parquet(landing).select("*", F.col("_metadata.file_modification_time").alias("_at"),
                                            F.col("_metadata.file_path").alias("_file"))
    # read whole in the first micro-batch; a row without a file is first of its key and never written
    known = spark.readStream.schema(key_schema).parquet(f"{checkpoint}/known").select(
        *keys, *[F.lit(None).cast(schema[c].dataType).alias(c) for c in rest],
        F.timestamp_seconds(F.lit(0)).alias("_at"), F.lit("").alias("_file"))
    rows = landed.unionByName(known).withColumn("_in", F.current_timestamp())
    first = rows.groupBy(*keys).agg(F.min(F.struct("_in", "_at", "_file", *rest)).alias("_v"), F.max("_in").alias("_now"))
    new = first.where((F.col("_v._in") == F.col("_now")) & (F.col("_v._file") != ""))
    new = new.select(*keys, *[F.col("_v")[c].alias(c) for c in rest])

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={run}-{batch_id:06d}")

    return (new.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start())


def run_to_completion(query, timeout_s: float | None = None) -> None:
    """Wait for the stream's end. With ``timeout_s``, a stream that is not done by
    then is stopped and TimeoutError is raised."""
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"stream not done after {timeout_s} s")
    if query.exception() is not None:
        raise query.exception()


def read_sink(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(sink).drop("batch")
