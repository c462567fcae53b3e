"""Suite-shaped inputs derived from the driver tables.

The published suites are not shipped, so each fixture re-reads a driver table
and gives it the shape the evaluation expects. All of them read whole tables;
their work grows with the data.

FX1 ``suite_lines``    conversations -> (paradigm, line_no, sentence), 23 paradigms
FX2 ``results_long``   events -> (model, corpora, rep, path, scoring_method, paradigm, accuracy)
FX3 ``logits``         embeddings -> (sent_id, pos, valid_length, label, logits)
FX4 ``pair_scores``    lineitem -> (paradigm, line_no, score), 67 paradigms
FX5 ``sentences``      FX1 lower-cased -> (sent_id, sentence) plus one empty line
FX6 ``runs``           documents -> (param_name, path, lang, source)
FX7 ``minimal_pairs``  conversations -> good / bad (two middle characters swapped)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minpair.functions.text import paradigm_name, swap_middle_chars
from minpair.operators.ranking import range_row_number
from minpair.sources.dims import SUITE23_PARADIGMS
from minpair.sources.tables import read_table

N_SUITE_PARADIGMS = 23
N_SCORE_PARADIGMS = 67


def suite_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX1: one conversation turn per line, numbered from 0 within a paradigm."""
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    df = conv.select((F.col("conv_id") % N_SUITE_PARADIGMS).alias("_p"), "conv_id", "turn",
                     F.replace("text", F.lit("\n"), F.lit(" ")).alias("sentence"))
    df = range_row_number(df, ["_p"], ["conv_id", "turn"], name="line_no", base=0)
    return df.select(paradigm_name(F.col("_p")).alias("paradigm"), "line_no", "sentence",
                     "conv_id", "turn")


def results_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX2: long accuracy table, one row per (model, corpora, rep, method, paradigm)."""
    ev = read_table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    names = F.array(*[F.lit(p) for p, _ in SUITE23_PARADIGMS])
    quad = F.floor(F.col("event_id") / 4).cast("long")
    octet = F.floor(F.col("event_id") / 8).cast("long")
    df = ev.select(
        F.col("event_type").alias("model"),
        F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("corpora"),
        (F.col("event_id") % 4).cast("int").alias("rep"),
        F.when(quad % 2 == 0, F.lit("mlm")).otherwise(F.lit("holistic")).alias("scoring_method"),
        F.element_at(names, (octet % N_SUITE_PARADIGMS + 1).cast("int")).alias("paradigm"),
        F.least(F.col("value"), F.lit(100.0)).alias("accuracy"),
    )
    keys = ["model", "corpora", "rep", "scoring_method", "paradigm"]
    out = df.groupBy(*keys).agg(F.max("accuracy").alias("accuracy"))
    path = F.concat_ws("/", "model", "corpora", F.col("rep").cast("string"))
    return out.select("model", "corpora", "rep", path.alias("path"), "scoring_method",
                      "paradigm", "accuracy")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX3: eight positions per sentence over a 64-entry vocabulary."""
    emb = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    sent = F.floor(F.col("vec_id") / 8).cast("long")
    return emb.select(
        sent.alias("sent_id"),
        (F.col("vec_id") % 8).cast("int").alias("pos"),
        (F.lit(4) + sent % 5).cast("int").alias("valid_length"),
        F.col("label"),
        F.transform("embedding", lambda v: v.cast("double")).alias("logits"),
    )


def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX4: sentence scores in line order, 67 paradigms."""
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey",
                    "l_linenumber", "l_extendedprice")
    df = li.withColumn("_p", F.col("l_suppkey") % N_SCORE_PARADIGMS)
    df = range_row_number(df, ["_p"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                       "l_extendedprice"], name="line_no", base=0)
    return df.select(paradigm_name(F.col("_p")).alias("paradigm"), "line_no",
                     F.col("l_extendedprice").alias("score"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX5: lower-cased FX1 sentences keyed by conv_id*10^9+turn, plus one empty line."""
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    df = conv.select((F.col("conv_id").cast("long") * 1_000_000_000 + F.col("turn")).alias("sent_id"),
                     F.lower(F.replace("text", F.lit("\n"), F.lit(" "))).alias("sentence"))
    empty = spark.createDataFrame([(-1, "")], "sent_id long, sentence string")
    return df.unionByName(empty)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX6: one saved run per document, ten parameter sets."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "lang", "source")
    param = F.concat(F.lit("param_"), F.lpad((F.col("doc_id") % 10).cast("string"), 3, "0"))
    path = F.concat(F.lit("/runs/"), param, F.lit("/"), F.col("source"), F.lit("/"),
                    F.col("doc_id").cast("string"), F.lit("/saves/"))
    return docs.select(param.alias("param_name"), path.alias("path"), "lang", "source", "doc_id")


def training_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX7 training text: every non-empty line of every document, lower-cased."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    lines = docs.select("doc_id", F.explode(F.split(F.lower("text"), "\n")).alias("sentence"))
    return lines.filter(F.col("sentence") != "")


def minimal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX7 test lines: each turn gives a pair; good on even lines, bad on odd.

    Output is ``(paradigm, line_no, sentence)`` like a suite scan.
    """
    base = suite_lines(spark, sf_dir).select("paradigm", "line_no", F.lower("sentence").alias("s"))
    # both sides come out of one pass over the lines (no union of two scans)
    sides = F.array(F.struct((F.col("line_no") * 2).alias("line_no"), F.col("s").alias("sentence")),
                    F.struct((F.col("line_no") * 2 + 1).alias("line_no"), swap_middle_chars("s").alias("sentence")))
    return base.select("paradigm", F.inline(sides))


# FX6 companion: run parameters per parameter set (corpora, training order,
# consecutive masking). Sets 006 and 009 are invalid combinations on purpose.
RUN_PARAMS = [
    ("param_000", ["aochildes"], "original", True),
    ("param_001", ["wikipedia1"], "original", True),
    ("param_002", ["aonewsela"], "original", False),
    ("param_003", ["aochildes", "aonewsela", "wikipedia3"], "original", True),
    ("param_004", ["aochildes", "wikipedia3"], "original", True),
    ("param_005", ["aochildes", "wikipedia3"], "reversed", True),
    ("param_006", ["aochildes", "aonewsela"], "original", False),
    ("param_007", ["aochildes", "aonewsela"], "reversed", True),
    ("param_008", ["wikipedia3", "aonewsela"], "original", True),
    ("param_009", ["wikipedia1", "aochildes"], "original", True),
]


def run_params(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RUN_PARAMS, "param_name string, corpora array<string>, "
                                             "training_order string, consecutive_masking boolean")


def checkpoint_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX6 variant for converted checkpoints: (doc_id, dir_name, file_name, ckpt_path)."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "source")
    frag = (F.when(F.col("doc_id") % 3 == 0, F.lit("AO-CHILDES"))
             .when(F.col("doc_id") % 3 == 1, F.lit("Wikipedia-1")).otherwise(F.col("source")))
    dir_name = F.concat(F.lit("RoBERTa-base-"), frag)
    file_name = F.concat(F.lit("checkpoint_last_"), (F.col("doc_id") % 10).cast("string"), F.lit(".pt"))
    return docs.select("doc_id", dir_name.alias("dir_name"), file_name.alias("file_name"),
                       F.concat(F.lit("/fairseq/"), dir_name, F.lit("/"), file_name).alias("ckpt_path"))
