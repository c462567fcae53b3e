"""The model registry as a table.

registry = (name, corpora, rep, path, case_sensitive, trained_on_lower_cased_data)

Model loading is not modelled: a registry row names a model; a ``Scorer``
(``operators.scorer``) turns it into token scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minpair.operators.ranking import range_row_number

REGISTRY_SCHEMA = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("corpora", T.StringType(), True),
    T.StructField("rep", T.IntegerType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("case_sensitive", T.BooleanType(), False),
    T.StructField("trained_on_lower_cased_data", T.BooleanType(), False),
])

# ---------------------------------------------------------------------------
# FIXED VALUES: the four pretrained models scored alongside trained runs
# (name, corpora, rep, path, case_sensitive, trained_on_lower_cased_data).
# ---------------------------------------------------------------------------
PRETRAINED_MODELS = [
    ("RoBERTa-base", "Warstadt2020", 0, "nyu-mll/roberta-base-10M-1", True, False),
    ("RoBERTa-base", "Warstadt2020", 1, "nyu-mll/roberta-base-10M-2", True, False),
    ("RoBERTa-base", "Warstadt2020", 2, "nyu-mll/roberta-base-10M-3", True, False),
    ("RoBERTa-base", "Liu2019", 0, "roberta-base", True, False),
]

# FIXED VALUES: corpora labels for trained runs, keyed by the corpora tuple;
# combinations that also depend on training order are listed per order
# (consecutive masking must be on for those).
CORPORA_LABELS = [
    (["aochildes"], None, "AO-CHILDES"),
    (["wikipedia1"], None, "Wikipedia-1"),
    (["aonewsela"], None, "AO-Newsela"),
    (["aochildes", "aonewsela", "wikipedia3"], None, "AO-CHILDES+AO-Newsela+Wikipedia-3"),
    (["aochildes", "wikipedia3"], "original", "AO-CHILDES+Wikipedia-3 original"),
    (["aochildes", "wikipedia3"], "reversed", "AO-CHILDES+Wikipedia-3 reversed"),
    (["aochildes", "aonewsela"], "original", "AO-CHILDES+AO-Newsela original"),
    (["aochildes", "aonewsela"], "reversed", "AO-CHILDES+AO-Newsela reversed"),
    (["wikipedia3", "aonewsela"], "original", "Wikipedia-3+AO-Newsela original"),
    (["wikipedia3", "aonewsela"], "reversed", "Wikipedia-3+AO-Newsela reversed"),
]

# FIXED VALUES: model name given to runs trained from parameter sets.
TRAINED_MODEL_NAME = "BabyBERTa"

# FIXED VALUES: checkpoint directory name fragment -> corpora label.
CHECKPOINT_CORPORA = [("AO-CHILDES", "AO-CHILDES"), ("Wikipedia-1", "Wikipedia-1")]


def pretrained_registry(spark: SparkSession) -> DataFrame:
    """A10: inline registry of the pretrained models."""
    return spark.createDataFrame(PRETRAINED_MODELS, REGISTRY_SCHEMA)


def lower_case_flag(registry: DataFrame, override: bool | None = None) -> DataFrame:
    """Score on lower-cased input iff case sensitive and trained on
    lower-cased data, unless a fixed choice overrides it."""
    flag = (F.lit(bool(override)) if override is not None
            else F.col("case_sensitive") & F.col("trained_on_lower_cased_data"))
    return registry.withColumn("lower_case", flag)


def select_runs(runs: DataFrame, param_names: list[str] | DataFrame) -> DataFrame:
    """Keep the listed parameter sets (IN list, or a semi join for a table)."""
    if isinstance(param_names, DataFrame):
        return runs.join(param_names.select("param_name"), "param_name", "left_semi")
    return runs.where(F.col("param_name").isin(list(param_names)))


def saved_runs(runs: DataFrame, root: str = "/runs") -> DataFrame:
    """A9 on a paths table: ``root/param_NNN/**/saves/`` directories."""
    pat = "^" + root.rstrip("/").replace(".", r"\.") + r"/param_[0-9]{3,}/(.+/)?saves/$"
    return runs.where(F.col("path").rlike(pat))


def list_saved_runs(spark: SparkSession, root: str) -> DataFrame:
    """A9 on a file system: (param_name, path) of every ``saves/`` directory
    under ``root/param_NNN/``, found from the files inside them (the
    ``binaryFile`` listing is pruned to the path column, so no content is
    read)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .load(root).select("path"))
    m = r"^(.*/(param_[0-9]{3,})/(?:.+/)?saves/)"
    runs = files.select(F.regexp_extract("path", m, 1).alias("path"),
                        F.regexp_extract("path", m, 2).alias("param_name"))
    return runs.where(F.col("path") != "").select("param_name", "path").distinct()


def list_checkpoints(spark: SparkSession, root: str) -> DataFrame:
    """(dir_name, file_name, path) of ``checkpoint_last_*.pt`` files."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", "checkpoint_last_*.pt").load(root).select("path"))
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("dir_name"),
                        F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "path")


def replication_numbers(runs: DataFrame) -> DataFrame:
    """H1: rep = rank of the path within its parameter set, from 0."""
    return range_row_number(runs, ["param_name"], ["path"], name="rep", base=0)


def corpora_label(corpora: Column, training_order: Column, consecutive_masking: Column) -> Column:
    """K7: label from the corpora array; order-dependent combinations need
    consecutive masking; anything else is NULL (invalid)."""
    expr = None
    for arr, order, label in CORPORA_LABELS:
        cond = corpora == F.array(*[F.lit(x) for x in arr])
        if order is not None:
            cond = cond & (training_order == F.lit(order)) & consecutive_masking
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def checkpoint_label(dir_name: Column) -> Column:
    """K8: corpora label from the model directory name (first fragment found)."""
    expr = None
    for frag, label in CHECKPOINT_CORPORA:
        cond = dir_name.contains(frag)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def checkpoint_rep(file_name: Column) -> Column:
    """K8: replication = last character of the file stem."""
    return F.regexp_extract(file_name, r"(\d)\.pt$", 1).cast("int")


def trained_registry(runs: DataFrame, params: DataFrame) -> DataFrame:
    """Registry rows of trained runs: H1 rep numbers + K7 labels.

    ``runs`` (param_name, path), ``params`` (param_name, corpora array,
    training_order, consecutive_masking). Runs of invalid parameter sets get
    a NULL corpora.
    """
    numbered = replication_numbers(saved_runs(runs.select("param_name", "path")))
    p = params.select("param_name", corpora_label(F.col("corpora"), F.col("training_order"),
                                                  F.col("consecutive_masking")).alias("corpora"))
    return numbered.join(F.broadcast(p), "param_name", "left").select(
        F.lit(TRAINED_MODEL_NAME).alias("name"), "corpora", F.col("rep").cast("int").alias("rep"), "path",
        F.lit(False).alias("case_sensitive"), F.lit(True).alias("trained_on_lower_cased_data"))


# FIXED VALUES: model name and flags of converted checkpoints.
CHECKPOINT_MODEL = ("RoBERTa-base", True, True)


def checkpoint_registry(files: DataFrame, strict: bool = True) -> DataFrame:
    """Registry rows of converted checkpoints (dir_name, file_name, path).

    A directory whose corpora are not known is an error at run time; with
    ``strict`` off its files are left out and ``invalid_checkpoints`` lists them.
    """
    name, cased, lowered = CHECKPOINT_MODEL
    label = checkpoint_label(F.col("dir_name"))
    if strict:
        label = F.coalesce(label, F.raise_error(F.concat(F.lit("unknown corpora of checkpoint "), F.col("path"))).cast("string"))
    return files.select(F.lit(name).alias("name"), label.alias("corpora"), checkpoint_rep(F.col("file_name")).alias("rep"),
                        "path", F.lit(cased).alias("case_sensitive"),
                        F.lit(lowered).alias("trained_on_lower_cased_data")).where(F.col("corpora").isNotNull())


def invalid_checkpoints(files: DataFrame) -> DataFrame:
    return files.where(checkpoint_label(F.col("dir_name")).isNull())


def registry_union(*registries: DataFrame) -> DataFrame:
    """Concatenate registries by column name."""
    out = registries[0]
    for r in registries[1:]:
        out = out.unionByName(r)
    return out
