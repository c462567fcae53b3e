"""Array math on logits columns (C4, E3, E5, E9, E10), all higher-order
built-in functions: no Python in the hot path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def log_norm(logits) -> Column:
    """log(sum(exp(x))), stable and in one pass: the accumulator carries the
    running maximum m and sum(exp(x - m)), rescaled when m grows."""
    x = _col(logits)
    init = F.struct(F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("s"))

    def step(acc, v):
        m = F.greatest(acc["m"], v)
        return F.struct(m.alias("m"), (acc["s"] * F.exp(acc["m"] - m) + F.exp(v - m)).alias("s"))

    return F.aggregate(x, init, step, lambda acc: acc["m"] + F.ln(acc["s"]))


def log_softmax(logits) -> Column:
    """X - logsumexp(x), element-wise. The normaliser is evaluated once per
    row (as an argument, not inside the lambda), so the cost is linear."""
    x = _col(logits)
    return F.zip_with(x, F.array_repeat(log_norm(x), F.size(x)), lambda v, c: v - c)


def label_gather(values, label) -> Column:
    """C4: value at 0-based ``label``."""
    return F.element_at(_col(values), _col(label) + 1)


def token_cross_entropy(logits, label) -> Column:
    """E5: -log_softmax(logits)[label] (no reduction)."""
    return log_norm(logits) - label_gather(logits, label)


def argmax(values) -> Column:
    """0-based index of the first maximum."""
    x = _col(values)
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def topk_indices(values, k: int = 5) -> Column:
    """0-based indices of the ``k`` largest values, larger first, ties
    by smaller index."""
    x = _col(values)
    ranked = F.sort_array(F.transform(x, lambda v, i: F.struct((-v).alias("neg"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: s["i"])
