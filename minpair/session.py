"""Session construction and lineage cutting.

On a cluster the session comes from the launcher and already names a shared
``spark.checkpoint.dir``; we only read it. A local fallback directory is set
only when nothing is configured (tests, laptops).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale. AQE re-plans joins from runtime sizes (so a
# broadcast only happens for a side measured to be small), splits skewed
# shuffle partitions, and coalesces small ones.
_SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "minpair", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _SCALE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    sc = _context(spark)
    if sc is not None:
        sc.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def _context(spark: SparkSession):
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - e.g. a Spark Connect session
        return None


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory, setting a local one only if unset."""
    sc = _context(spark)
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        # Executors of a cluster would each write to a disk of their own.
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="minpair-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        try:
            spark.conf.set("spark.checkpoint.dir", configured)
        except Exception:  # noqa: BLE001 - core conf not settable here; the context keeps it
            pass
    if sc is None:
        return configured
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, shuffle files go when the action that wrote them ends, not at some collection of
    garbage. Only for actions on plans of their own, as every write is: a plan run twice would shuffle again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def durable_checkpoint(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint directory
    and read it back, cutting lineage.

    Used where a plan reads non-deterministic per-partition values (partition
    ids, monotonically increasing ids) twice, and for fitted model tables:
    every reader sees the same rows even if an executor is lost and a stage
    re-runs. Unlike an eager ``Dataset.checkpoint`` on an unpersisted plan,
    the data is computed once (write), and the re-read carries file sizes for
    AQE's join choices. ``compression``: else the session's.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.parquet(path)


def bucketed_table(df: DataFrame, keys: list[str], buckets: int, dealt: bool = False,
                   compression: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint directory, dealt into ``buckets``
    files by hash of ``keys``: a join on all of ``keys`` reads it without an exchange.
    ``dealt``: ``df`` comes from ``repartition(buckets, *keys)`` already, or in tasks that share few keys.

    The table is external and temporary in the sense of ``durable_checkpoint``: its files lie
    under the checkpoint directory, its name only carries the bucketing to the planner.
    """
    spark = df.sparkSession
    name = f"minpair_{uuid.uuid4().hex}"
    # no sortBy: its order is no use to a join, which sorts what it reads
    df = df if dealt else df.repartition(buckets, *keys)
    options = {"path": f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}"} | ({"compression": compression} if compression else {})
    (df.write.format("parquet").options(**options)
       .bucketBy(buckets, *keys).saveAsTable(name))
    return spark.table(name)
