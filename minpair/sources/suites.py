"""Suite files: scan (A1-A3) and write.

A suite is a directory of text files, one per paradigm (file stem = paradigm
name), or a Hive-style ``paradigm=<name>/`` layout as written by Spark.
The strict suite scan reads each file whole (``wholetext``): suite files are
small by definition (2,000 or 4,000 lines), and only the whole file tells how
it ends. Corpora are read line by line, a file over as many tasks as its byte
ranges; line numbers come from the ranges' line counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from minpair.functions.text import strip_whitespace
from minpair.session import durable_checkpoint


def _paradigm_from_path():
    """``paradigm=<name>/`` directory if present, else the file stem."""
    return F.coalesce(
        F.nullif(F.regexp_extract(F.col("_path"), r"paradigm=([^/]+)/[^/]*$", 1), F.lit("")),
        F.regexp_extract(F.col("_path"), r"([^/]+)\.txt$", 1))


def _whole_files(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    # text() sets its own wholetext flag, so it must be passed here, not as an option
    df = (spark.read.option("recursiveFileLookup", True)
          .option("pathGlobFilter", glob).text(path, wholetext=True))
    return df.select(F.col("_metadata.file_path").alias("_path"), "value")


def _url_decode(c):
    return F.url_decode(c)


def paradigm_catalog(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """A3: (paradigm, file_path) of every suite file, content not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", glob).load(path).select(F.col("path").alias("_path")))
    return files.select(_url_decode(_paradigm_from_path()).alias("paradigm"), F.col("_path").alias("file_path"))


def scan_suite(spark: SparkSession, path: str, strict: bool = True, glob: str = "*.txt") -> DataFrame:
    """A1: holistic-style scan: split on \\n, \\r\\n or \\r, no stripping.

    (paradigm, line_no, sentence). With ``strict`` the query fails at run
    time if a file has an odd number of lines or ends with an empty line
    (e.g. a trailing newline).
    """
    files = _whole_files(spark, path, glob)
    parts = files.select(_url_decode(_paradigm_from_path()).alias("paradigm"),
                         F.split("value", "\\r\\n|\\r|\\n", -1).alias("_lines"))
    if strict:
        bad = (F.size("_lines") % 2 == 1) | (F.element_at("_lines", -1) == "")
        parts = parts.withColumn("_lines", F.when(bad, F.raise_error(F.concat(
            F.lit("suite file for paradigm "), F.col("paradigm"),
            F.lit(" must have an even number of lines and a non-empty last line"))))
            .otherwise(F.col("_lines")))
    return parts.select("paradigm", F.posexplode("_lines").alias("line_no", "sentence")).select(
        "paradigm", F.col("line_no").cast("long").alias("line_no"), "sentence")


def scan_lines(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(file_path, line_no, line) of every line of every file, from 0, without reading a file whole.

    The reader cuts files into byte ranges (``spark.sql.files.maxPartitionBytes``); a line
    belongs to the range it begins in, a \\r\\n over a border included, and ends with \\n, \\r\\n
    or \\r. A line's number is its place in its range plus the lines of the file's earlier
    ranges: one prefix sum over a table of a row per range. A final newline adds no line; an
    empty file has none.
    """
    rows = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
            .select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("_from"),
                    F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line")))
    # the ids depend on the layout: both uses read the same rows
    rows = durable_checkpoint(rows)
    ranges = rows.groupBy("file_path", "_from").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    earlier = Window.partitionBy("file_path").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("file_path", "_from", (F.coalesce(F.sum("_lines").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return rows.join(ranges, ["file_path", "_from"]).select(
        "file_path", (F.col("_id") + F.col("_shift")).alias("line_no"), "line")


def scan_corpus(spark: SparkSession, path: str, lower_case: bool = False, glob: str = "*.txt") -> DataFrame:
    """A2: MLM-style corpus scan: lines keyed by line number, whitespace stripped, no
    line after a final newline. A large file is read by many tasks (``scan_lines``)."""
    lines = scan_lines(spark, path, glob).withColumnRenamed("file_path", "_path")
    s = strip_whitespace("line")
    if lower_case:
        s = F.lower(s)
    return lines.select(_url_decode(_paradigm_from_path()).alias("paradigm"), "line_no", s.alias("sentence"))


def write_suite_text(lines: DataFrame, path: str) -> None:
    """One text file per paradigm (``paradigm=<name>/part-*.txt``), lines in
    ``line_no`` order, each ending with a newline. A paradigm file is bounded
    (a test suite), so one task streaming one sorted paradigm is fine; the
    (paradigm, line_no) sort already satisfies the writer's required ordering,
    so no second sort is added."""
    (lines.repartition("paradigm").sortWithinPartitions("paradigm", "line_no")
          .select("paradigm", "sentence").write.mode("overwrite").partitionBy("paradigm").text(path))


def write_suite_table(lines: DataFrame, path: str) -> None:
    """The suite as Parquet partitioned by paradigm, ``line_no`` kept so
    order needs no single writer."""
    lines.write.mode("overwrite").partitionBy("paradigm").parquet(path)


def read_suite_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
