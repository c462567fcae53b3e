"""From raw documents to token ids: quality, line dedup, near dedup, mixing, encoding.

``STAGES`` names five stages; each takes (spark, docs, sf_dir) and works on
all that its predecessor kept. All but the last return the columns of
``documents``. The stages learn and count on their own input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minpair.llm import op2_mixing, op3_probminhash, op6_line_dedup, op7_quality_classifier, op8_bpe
from minpair.llm.common import read, written
from minpair.llm.queries import RANKS, WEIGHTS, digests, levels

#: Share of the tokens that the mix takes; a document is taken once at most.
MIX_FRACTION = 0.8
#: The stages before encoding leave memory held in the executors, so its workers remember less than in the query of its own.
BPE_CACHE_BYTES = 16 << 20


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = op7_quality_classifier.fit(docs, read(spark, sf_dir, "labels"), op7_quality_classifier.training_fold())
    score, keep = _free(docs, "score"), _free(docs, "keep")
    out = op7_quality_classifier.quality_scores(docs, model, docs.columns, score_col=score, predicted_col=keep)
    return out.filter(F.col(keep) == 1).select(*[f"`{c}`" for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that more than a tenth of a source's documents hold go; n_chars follows the text."""
    out = op6_line_dedup.line_dedup(docs, F.col("source"))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one of the smallest id; of
    rows that repeat an id, one."""
    classes = written(op3_probminhash.near_dedup(docs))
    gone = classes.filter(~F.col("kept")).select("doc_id").distinct()
    again = written(classes.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    out = docs.join(gone, "doc_id", "left_anti")
    if not again.isEmpty():
        out = out.join(again, "doc_id", "left_anti").unionByName(
            docs.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return out.select(*[f"`{c}`" for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token-prefix of each leaf of the domain-language-source tree that its budget allows.
    Rows are told apart by their id as text, those without one by their text."""
    key = _free(docs, "key")
    named = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("string"),
                                            F.concat(F.lit("-"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))))
    mix = op2_mixing.mix(named, levels(), WEIGHTS, MIX_FRACTION, max_epochs=1, id_col=key)
    gone = written(mix.filter("copies = 0").select(key).distinct())
    return named.join(gone, key, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, their digest, and the digest of what they decode to."""
    out = op8_bpe.bpe_encode_decode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN,
                                    cache_bytes=BPE_CACHE_BYTES)
    return digests(out)


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("near dedup", near_dedup),
          ("mixing", mixing), ("byte-level BPE", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned scores, sketches and the codec are beyond SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None
