"""Line dedup by site-relative frequency.

A line that more than ``ratio`` of a host's pages hold is boilerplate there.
Counting: each page's distinct lines as 128-bit hashes, aggregated by (host,
line) with map-side combine, against the page total of the host. Dropping:
the boilerplate lines of a host form one short list (a page of k distinct
lines on average allows at most k / ratio of them), which meets the pages by
host; the texts stay where they are while the lists are small enough to
broadcast, and beyond that bound the join shuffles with AQE splitting a hot
host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minpair.llm.common import no_null, written

RATIO = 0.1
#: A line that one page alone holds is no boilerplate, however few pages its host has.
MIN_PAGES = 2
#: Largest number of boilerplate lines (16 bytes each) that are broadcast.
BROADCAST_MAX_LINES = 200_000


def host_of(url: str | Column) -> Column:
    """Host of an address, lower-cased, without user and port; null if there is none."""
    c = F.col(url) if isinstance(url, str) else url
    h = F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(h != "", F.lower(h))


def _line_hash(x: Column) -> Column:
    return F.md5(x.cast("binary"))


def boilerplate_lines(docs: DataFrame, host: Column, text_col: str = "text", ratio: float = RATIO,
                      min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line_hash, pages, host_pages) of the lines to drop. Blank lines never count."""
    d = docs.select(host.alias("host"), no_null(text_col).alias("t"))
    total = d.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    lines = d.select("host", F.explode(F.array_distinct(F.split("t", "\n", -1))).alias("line"))
    count = (lines.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
             .groupBy("host", F.unhex(_line_hash(F.col("line"))).alias("line_hash"))
             .agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages))
    return (count.alias("c").join(total.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
            .filter(F.col("pages") > ratio * F.col("host_pages"))
            .select(F.col("c.host").alias("host"), "line_hash", "pages", "host_pages"))


def line_dedup(docs: DataFrame, host: Column, text_col: str = "text", ratio: float = RATIO,
               min_pages: int = MIN_PAGES, broadcast_max_lines: int = BROADCAST_MAX_LINES,
               dropped_col: str | None = None) -> DataFrame:
    """``docs`` with the boilerplate lines of its host taken out of ``text_col``.

    Every row and column stays, whatever the columns are called; a page all of
    whose lines go keeps an empty text. Kept lines keep their order and
    repetitions, joined by a newline. A null text stays null; null hosts are
    one host; repeated rows count as pages of their own. ``dropped_col`` adds
    the number of lines dropped (and replaces a column of that name).
    """
    found = written(boilerplate_lines(docs, host, text_col, ratio, min_pages)
                    .select("host", F.lower(F.hex("line_hash")).alias("line")))
    lists = found.groupBy("host").agg(F.collect_set("line").alias("gone")).withColumnRenamed("host", "list_host")
    if found.limit(broadcast_max_lines + 1).count() <= broadcast_max_lines:
        lists = F.broadcast(lists)
    else:
        lists = written(lists)
    # the row travels as one column, so that no name of its columns can clash
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), host.alias("host"),
                    F.split(F.col(f"`{text_col}`"), "\n", -1).alias("lines"))
    d = d.join(lists, F.col("host").eqNullSafe(F.col("list_host")), "left")
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~F.array_contains("gone", _line_hash(x))))
    d = d.withColumn("kept", kept)
    out = [F.array_join("kept", "\n").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c != dropped_col]
    if dropped_col:
        out.append(F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).cast("long").alias(dropped_col))
    return d.select(*out)
