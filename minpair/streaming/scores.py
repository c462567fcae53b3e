"""L2: token log-probabilities arriving in batches, summed into sentence
scores by a stateful streaming aggregation.

The aggregate state is one running sum per sentence. In update mode each
micro-batch emits only the sentences it changed; ``foreachBatch`` writes them
as a new ``batch=<id>`` partition (idempotent on replay: the partition is
overwritten), and readers take the latest value per sentence.

``complete_score_stream`` knows how many tokens a sentence has: it emits each
sentence once, when its last token has come, and drops its state; a timer does
the same for sentences whose last token never comes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from minpair.operators.scorer import ship_package

# The complete-score stream adds up whole steps of 1e-10, so the order of arrival changes no sum.
SCORE_STEPS = 1e10


def sentence_score_stream(spark: SparkSession, landing: str, schema: T.StructType, sink: str,
                          checkpoint: str, keys: list[str], value: str = "logprob",
                          max_files_per_trigger: int | None = 1):
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(landing)
    sums = src.groupBy(*keys).agg(F.sum(value).alias("score"), F.count(F.lit(1)).alias("n_tokens"))

    def upsert(batch: DataFrame, batch_id: int) -> None:
        target = f"{sink}/batch={batch_id:06d}"
        batch.write.mode("overwrite").parquet(target)

    return (sums.writeStream.outputMode("update").foreachBatch(upsert)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def current_scores(spark: SparkSession, sink: str, keys: list[str]) -> DataFrame:
    """Latest value per sentence across the update batches written so far."""
    df = spark.read.parquet(sink)
    latest = F.max_by(F.struct("score", "n_tokens"), F.col("batch"))
    return df.groupBy(*keys).agg(latest.alias("_v")).select(*keys, "_v.score", "_v.n_tokens")


def complete_score_stream(spark: SparkSession, landing: str, schema: T.StructType, sink: str, checkpoint: str,
                          keys: list[str], value: str = "logprob", expected: str = "n_expected",
                          timeout_s: float | None = None, max_files_per_trigger: int | None = 1):
    """Start the stream (``availableNow``) that writes keys + (score, n_tokens, complete)
    once per sentence, and return the query handle.

    Every token row carries its sentence's token count in ``expected``. NULL
    scores count as tokens and add nothing; one NaN makes the sentence's score
    NULL, which never wins a pair.
    A sentence without a new token for ``timeout_s`` seconds, up to the start of
    the latest micro-batch with rows, is written with ``complete`` false and
    forgotten; without a timeout it waits. A sentence with a NULL count only
    leaves by the timer. The timer goes by a watermark on the batch time, which
    no row is behind, so none is dropped as late; and unlike one on the
    processing time it lets the run end. Tokens beyond the count that come
    in later micro-batches begin the sentence anew.
    """
    ship_package(spark)
    rows = (spark.readStream.schema(schema).options(**({"maxFilesPerTrigger": max_files_per_trigger} if max_files_per_trigger else {}))
            .parquet(landing)
            .select(*keys, F.rint(F.nanvl(value, F.lit(None).cast("double")) * SCORE_STEPS).alias("_steps"),
                    F.coalesce(F.isnan(value), F.lit(False)).alias("_nan"), F.col(expected).cast("double").alias("_want")))
    if timeout_s is not None:
        wait_ms = max(1, int(timeout_s * 1000))
        rows = rows.withColumn("_in", F.current_timestamp()).withWatermark("_in", f"{wait_ms} milliseconds")
    names = [*keys, "score", "n_tokens", "complete"]
    out = T.StructType([*(schema[k] for k in keys), T.StructField("score", T.DoubleType()),
                        T.StructField("n_tokens", T.LongType()), T.StructField("complete", T.BooleanType())])
    state = T.StructType([T.StructField("steps", T.DoubleType()), T.StructField("n", T.LongType())])
    steps_per_nat = SCORE_STEPS

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        steps, n = held.get if held.exists else (0.0, 0)
        if held.hasTimedOut:
            held.remove()
            yield pd.DataFrame([[*key, steps / steps_per_nat, n, False]], columns=names)
            return
        want = float("nan")
        for b in batches:
            steps += float("nan") if b["_nan"].any() else float(b["_steps"].sum())
            n += len(b)
            want = b["_want"].max()
        if n >= want:
            if held.exists:
                held.remove()
            yield pd.DataFrame([[*key, steps / steps_per_nat, n, True]], columns=names)
            return
        held.update((float(steps), int(n)))
        if timeout_s is not None:  # out when the watermark, the wait behind the batch time, passes this batch
            held.setTimeoutTimestamp(held.getCurrentProcessingTimeMs())

    timer = GroupStateTimeout.NoTimeout if timeout_s is None else GroupStateTimeout.EventTimeTimeout
    done = rows.groupBy(*keys).applyInPandasWithState(step, out, state, "append", timer)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id:06d}")

    return (done.writeStream.outputMode("append").foreachBatch(write)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
