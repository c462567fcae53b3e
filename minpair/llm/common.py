"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from minpair.session import checkpoint_dir

#: White space between words (fixed by the query contracts), as Java regex.
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read back.

    Cuts lineage without executor-local state: a lost executor costs a re-read
    at most. The re-read is an exchange boundary too, so AQE can split a hot
    key on either side of a join over it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def no_null(text: str | Column) -> Column:
    """Text with null as empty (and any type as string)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text: its longest runs of non-space characters."""
    return F.array_remove(F.split(text, SPACE), "")


def crc_fold(doc_id: str | Column, m: int) -> Column:
    """crc32 of the id as text, modulo m (null for a null id)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(m))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int,
                    use: Column | None = None, id_col: str = "doc_id",
                    text_col: str = "text", seed: int = 7) -> DataFrame:
    """(id, text, label) of at most ``max_rows`` labelled rows, by hash order.

    ``use`` filters the label rows (training folds). The sample is a hash
    threshold set from the label count, so it is the same for any
    partitioning; a final limit makes the bound hard. Only its ids (8 bytes
    each, at most ``max_rows``) are broadcast to the scan of the texts.
    """
    lab = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
    lab = lab.filter(F.col("id").isNotNull() & F.col("label").isNotNull())
    if use is not None:
        lab = lab.filter(use)
    n = lab.count()
    if n > max_rows:
        # a threshold a little under the bound; the limit is the guard
        cut = int(0.97 * max_rows / n * 1_000_000)
        lab = lab.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < cut)
    lab = lab.limit(max_rows)
    return (docs.select(F.col(id_col).alias("id"), no_null(text_col).alias("text"))
            .join(F.broadcast(lab), "id"))
