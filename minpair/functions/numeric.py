"""Order-independent numeric aggregates.

A double ``avg`` depends on summation order, i.e. on partitioning; when the
mean lands on a rounding tie (two-decimal accuracies averaged, then rounded
to two decimals) the printed result could change between runs. Summing as
exact decimals first gives the same double on every run and every engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "decimal(38,10)"
# Token scores are added up in two whole parts, steps of 1 / COARSE and of
# 1 / (COARSE * FINE). Sums of whole numbers are exact in a double (up to 2^53:
# 9e9 nats, 18 million tokens a sentence), so neither partitioning nor order
# changes a sentence score, and ties stay ties.
COARSE, FINE = 1e6, 1e9


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def score_parts(c) -> tuple[Column, Column]:
    """The whole parts of a token score; sums of each are exact."""
    x = _col(c) * F.lit(COARSE)
    return F.rint(x), F.rint((x - F.rint(x)) * F.lit(FINE))


def score_sum(c) -> Column:
    """Sum of token scores, the same in whatever order they come; NaN if any is NaN."""
    hi, lo = score_parts(c)
    return F.sum(hi) / F.lit(COARSE) + F.sum(lo) / F.lit(COARSE * FINE)


def score_mean(c) -> Column:
    """Mean of token scores, on the same sums as ``score_sum``."""
    hi, lo = score_parts(c)
    return F.avg(hi) / F.lit(COARSE) + F.avg(lo) / F.lit(COARSE * FINE)


def joined_sum(hi="_hi", lo="_lo") -> Column:
    """``score_sum`` from the summed parts."""
    return _col(hi) / F.lit(COARSE) + _col(lo) / F.lit(COARSE * FINE)


def joined_mean(hi="_hi", lo="_lo", n="_n") -> Column:
    """``score_mean`` from the summed parts of ``n`` scores; NULL if there are none."""
    count = _col(n).cast("double")
    return F.when(_col(n) > 0, _col(hi) / count / F.lit(COARSE) + _col(lo) / count / F.lit(COARSE * FINE))


def exact_avg(c) -> Column:
    """Mean computed on an exact decimal sum, returned as double; NaN if any value is NaN."""
    nan = F.isnan(_col(c).cast("double"))
    return F.when(F.max(nan), F.lit(float("nan"))).otherwise(
        F.avg(F.when(~nan, _col(c).cast(EXACT))).cast("double"))


def exact_weighted_mean(value, weight) -> Column:
    """sum(value * weight) / sum(weight) over rows with a value, both sums exact."""
    v = _col(value)
    w = F.when(v.isNotNull(), _col(weight))
    num = F.sum(v.cast(EXACT) * w.cast("decimal(20,0)")).cast("double")
    den = F.sum(w).cast("double")
    return num / den
