"""Sentence scores from token scores.

MLM scoring sums log P(true token) over every masked inner position
(pseudo-log-likelihood); holistic scoring averages the per-token cross entropy
over the non-padding positions. Both are one hash aggregation by sentence with
map-side partial aggregation (the batch-by-batch accumulation of the
original becomes partial + final aggregates). Sums are order-independent
(``functions.numeric.score_sum``), so scores can be compared without rounding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minpair.functions.numeric import joined_mean, joined_sum, score_sum
from minpair.functions.tokens import split_tokens
from minpair.operators import count_model as cm

# FIXED VALUES: default run settings.
HOLISTIC_BATCH_SIZE = 10
HOLISTIC_MAX_LENGTH = 128

POOLINGS = ("mean", "sum")


def pll_from_tokens(token_scores: DataFrame, keys: list[str], value: str = "logprob",
                    name: str = "score") -> DataFrame:
    """E7 + C5: sum per sentence; sentences whose rows carry NULL (no scorable
    tokens: empty) score 0.0."""
    return token_scores.groupBy(*keys).agg(F.coalesce(score_sum(value), F.lit(0.0)).alias(name))


def mlm_scores(model: "cm.CountModel", sentences: DataFrame, keys: list[str],
               text_col: str = "sentence", max_tokens: int | None = None) -> DataFrame:
    """Pseudo-log-likelihood per sentence under the count model.

    Every sentence is scored unless the caller sets ``max_tokens`` (boundaries
    included): longer ones then score NULL, which never wins a comparison,
    and ``over_long`` lists them.
    """
    parts = cm.sentence_parts(model, sentences, text_col, keys)
    return parts.select(*keys, _mlm(max_tokens).alias("score"))


def _mlm(max_tokens: int | None) -> Column:
    """The sum of a sentence's parts: 0.0 without tokens, NULL above ``max_tokens``."""
    score = F.coalesce(joined_sum(), F.lit(0.0))
    return score if max_tokens is None else F.when(F.col("_n") + 2 <= F.lit(int(max_tokens)), score)


def over_long(sentences: DataFrame, keys: list[str], unit: str, max_tokens: int,
              text_col: str = "sentence") -> DataFrame:
    """keys + n_tokens (boundaries included) of the sentences beyond ``max_tokens``."""
    n = F.size(split_tokens(F.col(text_col), unit)) + 2
    return sentences.select(*keys, n.alias("n_tokens")).where(F.col("n_tokens") > F.lit(int(max_tokens)))


def holistic_scores(model: "cm.CountModel", sentences: DataFrame, keys: list[str],
                    text_col: str = "sentence", pooling: str = "mean") -> DataFrame:
    """Cross entropy per sentence under the count model (smaller is better).

    The count model gives boundary tokens no probability, so only real tokens
    contribute. ``pooling='mean'`` follows the original code; ``'sum'`` is the
    variant its documentation describes. No tokens -> NULL.
    """
    if pooling not in POOLINGS:
        raise ValueError(f"unknown pooling {pooling!r}; expected one of {POOLINGS}")
    parts = cm.sentence_parts(model, sentences, text_col, keys)
    at = (-F.col("_hi"), -F.col("_lo"))
    return parts.select(*keys, (joined_mean(*at) if pooling == "mean" else joined_sum(*at)).alias("score"))


def holistic_from_token_loss(token_loss: DataFrame, keys: list[str], pos: str = "pos",
                             valid_length: str = "valid_length", loss: str = "ce",
                             pooling: str = "mean") -> DataFrame:
    """E6 on per-position losses: padding (pos >= valid_length) is left out by
    the attention mask, boundary positions are kept."""
    if pooling not in POOLINGS:
        raise ValueError(f"unknown pooling {pooling!r}; expected one of {POOLINGS}")
    agg = F.avg(loss) if pooling == "mean" else F.sum(loss)
    return (token_loss.where(F.col(pos) < F.col(valid_length))
                      .groupBy(*keys).agg(agg.alias("score")))


def both_scores(model: "cm.CountModel", sentences: DataFrame, keys: list[str],
                text_col: str = "sentence", max_tokens: int | None = None) -> DataFrame:
    """MLM and holistic scores from one token pass and one aggregation, in
    long form: keys + (scoring_method, score).

    mlm: sum of log P, 0.0 without tokens, NULL above ``max_tokens``
    (boundaries included, no bound unless set); holistic: mean of -log P, NULL without tokens.
    """
    parts = cm.sentence_parts(model, sentences, text_col, keys)
    sides = F.array(F.struct(F.lit("mlm").alias("scoring_method"), _mlm(max_tokens).alias("score")),
                    F.struct(F.lit("holistic").alias("scoring_method"), joined_mean(-F.col("_hi"), -F.col("_lo")).alias("score")))
    return parts.select(*keys, F.inline(sides))
