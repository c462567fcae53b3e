"""Text statistics as built-in Spark expressions, whole texts, no Python.

``text_stats`` works in projections that each name an array once, so that no
expression is evaluated per element of another.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minpair.llm.common import SPACE, no_null, words

#: Fixed by the query contract.
SYMBOLS = "#*$%&|<>"

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_chars", "n_lines", "n_distinct_words", "n_upper", "n_exclaim", "n_pipe", "n_digit",
        "n_letter"]


def _count(text: Column, chars: str) -> Column:
    """Code points of the regex class ``chars`` in the text."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def text_stats(df: DataFrame, keys: list[str], text_col: str = "text", more: bool = False,
               named: bool = True) -> DataFrame:
    """``keys`` plus the base statistics (and, with ``more``, further ones).

    n_words; word_chars (code points in words); n_symbols; n_dup_lines (lines
    holding a word and equal to an earlier line); n_repeat_words (words lying
    in a 3-word window that the text holds twice or more, first included).
    A null or empty text gives zeros; repeated rows give repeated rows; other
    columns of ``df`` are ignored, whatever their names. With ``named`` False
    the keys come out as _k0, _k1, .., so that they may have any name.
    """
    k = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keys)]
    ks = [f"_k{i}" for i in range(len(keys))]
    d = df.select(*k, no_null(text_col).alias("t"))
    extra = []
    if more:
        extra = [F.length("t").cast("long").alias("n_chars"),
                 _count(F.col("t"), r"\p{Lu}").alias("n_upper"),
                 _count(F.col("t"), "!").alias("n_exclaim"),
                 _count(F.col("t"), "|").alias("n_pipe"),
                 _count(F.col("t"), r"\p{N}").alias("n_digit"),
                 _count(F.col("t"), r"\p{L}").alias("n_letter")]
    d = d.select(
        *ks, words(F.col("t")).alias("w"),
        F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        _count(F.col("t"), SYMBOLS).alias("n_symbols"), *extra)
    carried = ["word_chars", "n_symbols"] + ([c for c in MORE if c not in ("n_lines", "n_distinct_words")] if more else [])
    d = d.select(
        *ks, *carried, F.size("w").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        *([F.size("lines").cast("long").alias("n_lines"),
           F.size(F.array_distinct("w")).cast("long").alias("n_distinct_words")] if more else []),
        "w",
        # the 3-word windows by hash: longs are told apart and sorted faster than strings
        F.when(F.size("w") >= 3, F.transform(
            F.sequence(F.lit(0), F.size("w") - 3),
            lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).alias("win"))
    carried += ["n_words", "n_dup_lines"] + (["n_lines", "n_distinct_words"] if more else [])

    def repeated(srt):
        return F.filter(srt, lambda x, i: x["g"].eqNullSafe(F.get(srt, i - 1)["g"])
                        | x["g"].eqNullSafe(F.get(srt, i + 1)["g"]))

    # sorted with their places, only where some hash repeats
    d = d.select(*ks, *carried, "w", F.when(
        F.size(F.array_distinct("win")) < F.size("win"),
        F.sort_array(F.transform("win", lambda x, i: F.struct(x.alias("g"), i.alias("p"))))).alias("srt"))
    # the windows of a repeated hash once more, by their words; these hold no
    # space, so the joined text is the window
    d = d.select(*ks, *carried, F.sort_array(F.transform(repeated("srt"), lambda x: F.struct(
        F.concat_ws(" ", F.get("w", x["p"]), F.get("w", x["p"] + 1), F.get("w", x["p"] + 2)).alias("g"),
        x["p"].alias("p")))).alias("same"))
    d = d.select(*ks, *carried, repeated("same").alias("rep"))
    d = d.select(*ks, *carried, F.sort_array("rep.p").alias("p"))
    d = d.select(*ks, *carried, F.coalesce(F.aggregate(
        F.transform("p", lambda x, i: F.least(F.lit(3), x - F.coalesce(F.get("p", i - 1), F.lit(-3)))),
        F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"))
    # a generator of one row: a filter on a statistic stays above it. Pushed below,
    # the filter would spell the whole chain of projections out inside itself.
    cols = BASE + (MORE if more else [])
    d = d.select(*ks, F.explode_outer(F.array(F.struct(*cols))).alias("_s"))
    return d.select(*[F.col(f"_k{i}").alias(c) if named else F.col(f"_k{i}") for i, c in enumerate(keys)],
                    *[F.col(f"_s.{c}").alias(c) for c in cols])


#: Scale-free statistics (name, expression over the counts); 0 where a denominator is 0.
def ratios() -> dict[str, Column]:
    def per(a, b):
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    return {
        "words": F.col("n_words").cast("double"),
        "word_len": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeat_words": per("n_repeat_words", "n_words"),
        "distinct_words": per("n_distinct_words", "n_words"),
        "upper": per("n_upper", "n_letter"),
        "exclaim_per_word": per("n_exclaim", "n_words"),
        "pipe_per_word": per("n_pipe", "n_words"),
        "digits": per("n_digit", "n_chars"),
        "letters": per("n_letter", "n_chars"),
        "words_per_line": per("n_words", "n_lines"),
    }


def with_ratios(st: DataFrame) -> DataFrame:
    """The output of ``text_stats(more=True)`` with each ratio as ``r_<name>``."""
    return st.select("*", *[c.alias(f"r_{n}") for n, c in ratios().items()])


def labelled_ratios(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """ids, labels and ratios of a bounded labelled sample (id, text, label), in
    id order so that any partitioning gives the same model."""
    names = list(ratios())
    st = with_ratios(text_stats(sample, ["id", "label"], "text", more=True))
    rows = sorted(st.select("id", "label", *[f"r_{n}" for n in names]).collect())
    x = {n: np.array([r[i + 2] for r in rows], dtype=float) for i, n in enumerate(names)}
    # ids only deal the rows into parts; those that are no numbers do so by their crc32
    ids = [r[0] if isinstance(r[0], int) else crc32(str(r[0]).encode()) for r in rows]
    return (np.array(ids, dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64), x)
