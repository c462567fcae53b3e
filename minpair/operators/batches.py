"""Batch assembly as grouped aggregates.

A batch is a bounded group (10 or a few hundred sentences), so per-batch
windows and ``collect_list`` hold at most one batch. Element order inside a
batch is made explicit with a sequence column and ``sort_array`` over
structs, never left to arrival order.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minpair.operators.ranking import range_row_number
from minpair.session import durable_checkpoint

BATCH_FIELD_KINDS = ("pad", "stack", "list")


def _check_array(df: DataFrame, col: str, depth: int = 1) -> None:
    dt = df.schema[col].dataType
    for _ in range(depth):
        if not isinstance(dt, T.ArrayType):
            raise TypeError(f"column {col!r} must be an array (depth {depth}), got {df.schema[col].dataType.simpleString()}")
        dt = dt.elementType


def _pad_value(pad_val):
    if pad_val is None:
        warnings.warn("no pad_val given: filling with id 0", stacklevel=3)
        return 0
    return pad_val


def padded_length(max_len: Column, round_to: int | None) -> Column:
    """Round the batch maximum up to a multiple of ``round_to``."""
    if round_to is None:
        return max_len
    return (F.ceil(max_len / F.lit(int(round_to))) * F.lit(int(round_to))).cast("int")


def pad_batch(df: DataFrame, batch_col: str, arr_col: str, pad_val=None,
              round_to: int | None = None, out_col: str = "padded") -> DataFrame:
    """Pad every array to its batch's longest (optionally rounded up).

    Adds ``out_col`` and ``valid_length`` (the original length).
    """
    _check_array(df, arr_col)
    pad = _pad_value(pad_val)
    n = F.size(arr_col)
    width = padded_length(F.max(n).over(Window.partitionBy(batch_col)), round_to)
    elem = df.schema[arr_col].dataType.elementType
    fill = F.array_repeat(F.lit(pad).cast(elem), width - n)
    return df.withColumn("valid_length", n).withColumn(out_col, F.concat(F.col(arr_col), fill))


def pad_inner_axis(df: DataFrame, batch_col: str, arr_col: str, pad_val=None,
                   out_col: str = "padded") -> DataFrame:
    """For 2-D samples (array of rows), pad every inner row to the batch's
    widest inner row (padding along axis 1 of each sample)."""
    _check_array(df, arr_col, depth=2)
    pad = _pad_value(pad_val)
    elem = df.schema[arr_col].dataType.elementType.elementType
    inner_max = F.array_max(F.transform(arr_col, lambda r: F.size(r)))
    width = F.max(inner_max).over(Window.partitionBy(batch_col))
    padded = F.transform(arr_col, lambda r: F.concat(r, F.array_repeat(F.lit(pad).cast(elem), width - F.size(r))))
    return df.withColumn(out_col, padded)


def _ordered(seq_col: str, value: Column) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col(seq_col).alias("s"), value.alias("v")))),
                       lambda x: x["v"])


def stack(df: DataFrame, batch_col: str, seq_col: str, col: str, dtype: str | None = None) -> DataFrame:
    """Stack equal-shape samples of a batch in ``seq_col`` order.

    (batch, stacked, n_rows, shape_ok); ``shape_ok`` is false when sizes differ.
    ``dtype`` casts the elements.
    """
    is_arr = isinstance(df.schema[col].dataType, T.ArrayType)
    value = F.col(col)
    if dtype is not None:
        value = value.cast(f"array<{dtype}>" if is_arr else dtype)
    size = F.size(col) if is_arr else F.lit(0)
    return df.groupBy(batch_col).agg(
        _ordered(seq_col, value).alias("stacked"),
        F.count(F.lit(1)).alias("n_rows"),
        (F.min(size) == F.max(size)).alias("shape_ok"),
    )


def batch_fields(df: DataFrame, batch_col: str, seq_col: str, fields: dict[str, str],
                 pad_val=0, round_to: int | None = None) -> DataFrame:
    """One aggregate per field in a single grouping: ``pad`` (pad to
    the batch maximum then stack), ``stack`` or ``list`` (ordered list).

    The field set is checked against the schema, like the per-field batchify
    wrappers check arity and names.
    """
    missing = [f for f in fields if f not in df.columns]
    if missing:
        raise ValueError(f"batch fields {missing} not in columns {df.columns}")
    bad = {f: k for f, k in fields.items() if k not in BATCH_FIELD_KINDS}
    if bad:
        raise ValueError(f"unknown batchify kinds {bad}; expected {BATCH_FIELD_KINDS}")
    cur = df
    out_cols = []
    for f, kind in fields.items():
        if kind == "pad":
            cur = pad_batch(cur, batch_col, f, pad_val, round_to, out_col=f"_pad_{f}").drop("valid_length")
            out_cols.append(_ordered(seq_col, F.col(f"_pad_{f}")).alias(f))
        else:
            out_cols.append(_ordered(seq_col, F.col(f)).alias(f))
    return cur.groupBy(batch_col).agg(*out_cols)


def attention_mask(valid_length, width) -> Column:
    """[i < valid_length for i in 0..width-1]."""
    vl = F.col(valid_length) if isinstance(valid_length, str) else valid_length
    w = F.col(width) if isinstance(width, str) else F.lit(int(width))
    return F.when(w > 0, F.transform(F.sequence(F.lit(0), w - 1), lambda i: i < vl)).otherwise(
        F.array().cast("array<boolean>"))


#: Rows that one shard of a bucket holds on average, unless the caller says otherwise.
SHARD_ROWS = 100_000


def length_histogram(df: DataFrame, length_col: str) -> DataFrame:
    """(length, n): rows by length. One scan of the length column, aggregated before its
    shuffle; histograms of parts add up. A null length is a length of its own."""
    return df.groupBy(F.col(length_col).alias("length")).agg(F.count(F.lit(1)).alias("n"))


def _bucket(length, lo: Column, hi: Column, num_buckets: int, batch_size: int, ratio: float) -> tuple[Column, Column, Column]:
    """Bucket, its upper bound and its batch size, of a length between ``lo`` and ``hi``."""
    width = F.greatest(F.lit(1), F.ceil((hi - lo + 1) / F.lit(num_buckets)))
    bucket = F.least(F.floor((F.col(length) - lo) / width), F.lit(num_buckets - 1)).cast("int")
    key = lo + (bucket + 1) * width - 1
    max_key = lo + F.lit(num_buckets) * width - 1
    size = F.greatest(F.floor(max_key / key * F.lit(float(ratio)) * F.lit(batch_size)), F.lit(batch_size))
    return bucket, key.cast("long"), size.cast("long")


def bucket_plan(histogram: DataFrame, num_buckets: int = 10, batch_size: int = 500, ratio: float = 1.0,
                shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Buckets from a ``length_histogram`` alone, ``num_buckets`` rows at most:
    (bucket, upper_length, bucket_batch_size, n_rows, shortest, longest, shards).

    A bucket has as many shards as it has ``shard_rows`` rows, begun ones included, so its
    batches depend on the rows and not on the session. A null length falls into the last bucket.
    """
    lo, hi = (histogram.select(f("length")).scalar() for f in (F.min, F.max))
    bucket, key, size = _bucket("length", lo, hi, num_buckets, batch_size, ratio)
    tagged = histogram.select(bucket.alias("bucket"), key.alias("upper_length"), size.alias("bucket_batch_size"), "length", "n")
    return tagged.groupBy("bucket", "upper_length", "bucket_batch_size").agg(
        F.sum("n").alias("n_rows"), F.min("length").alias("shortest"), F.max("length").alias("longest"),
        F.ceil(F.sum("n") / F.lit(shard_rows)).cast("int").alias("shards"))


def bucketed_batches(df: DataFrame, length_col: str, keys: list[str], num_buckets: int = 10,
                     batch_size: int = 500, ratio: float = 1.0, shards: int | None = None,
                     shard: Column | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Length-bucketed batches without shuffling the order inside a bucket.

    bucket = floor((len - min) / width) clipped to num_buckets - 1, with
    width = max(1, ceil((max - min + 1) / num_buckets)); bucket key = its upper
    bound; bucket batch size
    ``max(floor(max_key / key * ratio * batch_size), batch_size)`` so shorter
    buckets get larger batches. Rows are numbered inside
    (bucket, shard) by ``keys``, so no numbering covers a whole bucket; the
    last batch of a shard may be short.

    shard = ``shard``, else hash of keys modulo ``shards``, else modulo the
    bucket's share by ``shard_rows``: the same batches in any session. All of
    that comes from one histogram of the lengths.
    """
    plan = durable_checkpoint(bucket_plan(length_histogram(df, length_col), num_buckets, batch_size, ratio, shard_rows))
    lo, hi = plan.select(F.min("shortest")).scalar(), plan.select(F.max("longest")).scalar()
    bucket, _, size = _bucket(length_col, lo, hi, num_buckets, batch_size, ratio)
    tagged = df.select("*", bucket.alias("bucket"), size.alias("bucket_batch_size"))
    if shard is not None:
        tagged = tagged.withColumn("shard", shard)
    elif shards:
        tagged = tagged.withColumn("shard", F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int"))
    else:
        own = plan.select(F.col("bucket").alias("_bucket"), F.col("shards").alias("_shards"))  # num_buckets rows at most
        tagged = (tagged.join(F.broadcast(own), F.col("bucket") == F.col("_bucket"))
                  .withColumn("shard", F.pmod(F.xxhash64(*keys), F.col("_shards")).cast("int")).drop("_bucket", "_shards"))
    ranked = range_row_number(tagged, ["bucket", "shard"], keys, name="_seq", base=0)
    return ranked.withColumn("batch_in_shard", F.floor(F.col("_seq") / F.col("bucket_batch_size")).cast("long")).drop("_seq")


def bucket_stats(batches: DataFrame, length_col: str) -> DataFrame:
    """Per bucket: rows, batches, and the share of padding positions
    (padding to each batch's longest)."""
    per_batch = batches.groupBy("bucket", "shard", "batch_in_shard").agg(
        F.count(F.lit(1)).alias("n"), F.max(length_col).alias("mx"), F.sum(length_col).alias("tot"))
    return per_batch.groupBy("bucket").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_batches"),
        F.round(F.lit(1.0) - F.sum("tot") / F.sum(F.col("n") * F.col("mx")), 6).alias("padding_share"))
