"""Vocabulary, encoding, masked copies.

The vocabulary is a Spark job: token counts, then a global rank by
(count desc, token) computed with range partitioning (``range_row_number``),
so no single task sees every type. Ids 0-4 are reserved.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minpair.functions.tokens import (BOS_ID, EOS_ID, FIRST_FREE_ID, MASK_ID, RESERVED_TOKENS,
                                      UNK_ID, split_tokens)
from minpair.operators.ranking import range_row_number
from minpair.sources.tables import spread

# Vocabularies up to this many entries (counted when built) are broadcast.
BROADCAST_MAX_TYPES = 2_000_000


@dataclass
class Vocabulary:
    table: DataFrame    # (token, token_id, count), reserved ids included with count 0
    size: int
    unit: str

    def broadcastable(self) -> bool:
        try:
            value = self.table.sparkSession.conf.get("minpair.broadcast.maxTypes", None)
        except Exception:  # noqa: BLE001
            value = None
        return self.size <= (int(value) if value else BROADCAST_MAX_TYPES)

    def lookup(self) -> DataFrame:
        t = self.table.select("token", "token_id")
        return F.broadcast(t) if self.broadcastable() else t


def explode_tokens(sentences: DataFrame, keys: list[str], text_col: str = "sentence",
                   unit: str = "word", outer: bool = False) -> DataFrame:
    """keys + (pos, token), 0-based positions; ``outer`` keeps empty sentences
    as one NULL row."""
    gen = F.posexplode_outer if outer else F.posexplode
    return spread(sentences).select(*keys, gen(split_tokens(F.col(text_col), unit)).alias("pos", "token"))


def token_counts(sentences: DataFrame, text_col: str = "sentence", unit: str = "word") -> DataFrame:
    return (explode_tokens(sentences, [], text_col, unit)
            .groupBy("token").agg(F.count(F.lit(1)).alias("count")))


def vocab_build(sentences: DataFrame, text_col: str = "sentence", unit: str = "word") -> Vocabulary:
    """(token, token_id, count); id = 5 + rank by (count desc, token)."""
    counts = token_counts(sentences, text_col, unit)
    ranked = range_row_number(counts, [], [F.col("count").desc(), F.col("token").asc()],
                              name="token_id", base=FIRST_FREE_ID)
    reserved = sentences.sparkSession.createDataFrame(
        [(t, i, 0) for i, t in RESERVED_TOKENS], "token string, token_id long, count long")
    # ranks come from a checkpointed table; the union with the reserved ids is cheap
    table = ranked.select("token", "token_id", "count").unionByName(reserved)
    return Vocabulary(table, table.count(), unit)


def encode(sentences: DataFrame, vocab: Vocabulary, keys: list[str],
           text_col: str = "sentence") -> DataFrame:
    """Keys + token_ids array<long> with <s> first and </s> last; unknown
    tokens get <unk>. An empty sentence encodes to [<s>, </s>]."""
    toks = explode_tokens(sentences, keys, text_col, vocab.unit, outer=True)
    ided = toks.join(vocab.lookup(), "token", "left").select(
        *keys, "pos", F.when(F.col("token").isNotNull(),
                             F.coalesce("token_id", F.lit(UNK_ID))).alias("token_id"))
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", "token_id"))
    grouped = ided.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    ids = F.concat(F.array(F.lit(BOS_ID).cast("long")),
                   F.transform("_items", lambda s: s["token_id"]),
                   F.array(F.lit(EOS_ID).cast("long")))
    return grouped.select(*keys, ids.alias("token_ids"))


def decode(encoded: DataFrame, vocab: Vocabulary, keys: list[str], ids_col: str = "token_ids") -> DataFrame:
    """Keys + (pos, token_id, token) for every id, reserved ids included."""
    ex = encoded.select(*keys, F.posexplode(ids_col).alias("pos", "token_id"))
    return ex.join(vocab.lookup(), "token_id", "left")


def length_guard(encoded: DataFrame, max_len: int, ids_col: str = "token_ids") -> DataFrame:
    """Adds n_ids and ``kept`` (n_ids <= max_len)."""
    n = F.size(ids_col)
    return encoded.withColumn("n_ids", n).withColumn("kept", n <= F.lit(int(max_len)))


def maskable_positions(encoded: DataFrame, keys: list[str], ids_col: str = "token_ids") -> DataFrame:
    """Keys + (pos, token_id) for inner positions 1..n-2."""
    ex = encoded.select(*keys, F.size(ids_col).alias("_n"), F.posexplode(ids_col).alias("pos", "token_id"))
    return ex.where((F.col("pos") > 0) & (F.col("pos") < F.col("_n") - 1)).drop("_n")


def masked_copies(encoded: DataFrame, keys: list[str], ids_col: str = "token_ids",
                  max_len: int | None = None) -> DataFrame:
    """D3: one copy per inner position with that id replaced by <mask>.

    keys + (mask_pos, label, token_ids, valid_length, normalization). L tokens
    give L rows of L ids, so this is built only for models that need ids;
    the count model never calls it.
    """
    src = encoded if max_len is None else encoded.where(F.size(ids_col) <= max_len)
    ex = src.select(*keys, ids_col, F.posexplode(ids_col).alias("mask_pos", "label"))
    ex = ex.where((F.col("mask_pos") > 0) & (F.col("mask_pos") < F.size(ids_col) - 1))
    masked = F.transform(ids_col, lambda x, i: F.when(i == F.col("mask_pos"), F.lit(MASK_ID).cast("long"))
                         .otherwise(x))
    return ex.select(*keys, "mask_pos", "label", masked.alias("token_ids"),
                     F.size(ids_col).alias("valid_length"), F.lit(1).alias("normalization"))


def true_token_lengths(encoded: DataFrame, keys: list[str], ids_col: str = "token_ids") -> DataFrame:
    """N - 2 per sentence that has at least one masked copy."""
    n = F.size(ids_col)
    return encoded.where(n > 2).select(*keys, (n - 2).alias("n_tokens"))
