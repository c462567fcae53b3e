"""Exact dedup by a 128-bit content hash, bytes compared inside each group.

Rows are grouped by the hash and by the text itself, so two texts share a
group only if their bytes agree; the aggregate combines map-side, so a group
of copies leaves one row per task however large it is. Back on the rows, the
hash alone names the group unless two texts collide on it; only then is the
text of the colliding rows compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minpair.llm.common import no_null, written

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Largest number of repeated hashes (16 bytes each) sent to every task as a filter.
FILTER_MAX_HASHES = 1_000_000


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` agrees on pure ASCII and is much faster."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _UPPER.lower())).otherwise(F.lower(text))


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest",
                normalise=ascii_lower, content_hash=md5_128,
                filter_max_hashes: int = FILTER_MAX_HASHES) -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256; one row per input row.

    Equal: same bytes after ``normalise``; null counts as empty, and empty
    texts are copies of each other. ``keep`` names which id of a group stays
    (``largest`` or ``smallest``). Rows that repeat one id and text all carry
    that id as keep_id, and are kept or dropped together. A null id is kept
    only if its whole group has null ids. Other columns are ignored.
    """
    best = {"largest": F.max, "smallest": F.min}[keep]
    texts = docs.select(F.col(id_col).alias("id"), normalise(no_null(text_col)).alias("x"))
    rows = written(texts.select("id", content_hash(F.col("x")).alias("h"),
                                F.sha2(F.col("x").cast("binary"), 256).alias("sha")))
    sizes = written(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), best("id").alias("keep_id"))
                    .filter("n > 1"))
    hashed = texts.select("id", "x", content_hash(F.col("x")).alias("h"))
    if sizes.limit(filter_max_hashes + 1).count() <= filter_max_hashes:
        # texts that stand alone need not move; beyond the bound all are grouped
        hashed = hashed.join(F.broadcast(sizes.select("h")), "h", "left_semi")
    classes = (hashed.groupBy("h", "x").agg(F.count(F.lit(1)).alias("n"), best("id").alias("keep_id"))
               .select("h", "n", "keep_id", F.sha2(F.col("x").cast("binary"), 256).alias("sha"),
                       F.xxhash64("x").alias("x64"), "x"))
    # hashes shared by different texts: only for these the text itself is the key
    per_hash = classes.groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    clash = written(per_hash.filter("c > 1").select("h"))
    if clash.isEmpty():
        groups = sizes
        out = rows.join(groups, "h", "left").select("id", "n", "keep_id", "sha")
    else:
        split = written(classes.join(clash, "h", "left_semi").select("h", "x", "n", "keep_id"))
        alone = (rows.join(clash, "h", "left_anti").join(sizes, "h", "left")
                 .select("id", "n", "keep_id", "sha"))
        some = (texts.select("id", "x", content_hash(F.col("x")).alias("h")).join(clash, "h", "left_semi")
                .join(split, ["h", "x"], "left")
                .select("id", "n", "keep_id", F.sha2(F.col("x").cast("binary"), 256).alias("sha")))
        out = alone.unionByName(some)
    # a group of one has no row in the group tables
    keep_id = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(F.col("id").alias(id_col), keep_id.alias("keep_id"),
                      F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                      F.col("id").eqNullSafe(keep_id).alias("kept"), F.col("sha").alias("text_sha256"))
