"""Token column expressions shared by the token, model and scoring operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: reserved vocabulary entries (id, token), in id order.
RESERVED_TOKENS = [(0, "<s>"), (1, "<pad>"), (2, "</s>"), (3, "<unk>"), (4, "<mask>")]
BOS, PAD, EOS, UNK, MASK = (t for _, t in RESERVED_TOKENS)
BOS_ID, PAD_ID, EOS_ID, UNK_ID, MASK_ID = (i for i, _ in RESERVED_TOKENS)
FIRST_FREE_ID = 5

UNITS = ("char", "word")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_tokens(s, unit: str = "char") -> Column:
    """Sentence -> array of token strings; an empty sentence has no tokens.

    ``char``: one token per character. ``word``: split on single spaces.
    """
    s = _col(s)
    if unit == "char":
        toks = F.split(s, "")
    elif unit == "word":
        toks = F.split(s, " ")
    else:
        raise ValueError(f"unknown token unit {unit!r}; expected one of {UNITS}")
    return F.when(s == "", F.array().cast("array<string>")).otherwise(toks)


def with_boundaries(tokens) -> Column:
    """``[<s>] + tokens + [</s>]``."""
    return F.concat(F.array(F.lit(BOS)), _col(tokens), F.array(F.lit(EOS)))


def trigram_structs(tokens) -> Column:
    """Array of ``struct(pos, l, t, r)`` for every real token, 0-based ``pos``.

    Left/right neighbours are the boundary-padded array shifted by one, zipped
    with the tokens: linear in sentence length, and no window or shuffle is
    needed to find them.
    """
    toks = _col(tokens)
    padded = with_boundaries(toks)
    n = F.size(toks)
    return F.arrays_zip(F.transform(toks, lambda x, i: i).alias("pos"),
                        F.slice(padded, 1, n).alias("l"),
                        toks.alias("t"),
                        F.slice(padded, 3, n).alias("r"))
