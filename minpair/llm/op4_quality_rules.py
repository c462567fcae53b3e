"""Quality rules: a learned decision list over text statistics.

Sequential covering in the manner of incremental reduced-error pruning: grow
a conjunction of thresholds that covers rejected rows, prune it on rows it
was not grown on, keep it if it is precise enough, take away what it covers,
repeat. The list becomes one ordered Spark conditional expression. The
statistics, the verdict and the table the learner sees come from DataFrame
functions; only a bounded sample of labelled statistics rows (``max_rows``)
reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minpair.llm.common import labelled_sample
from minpair.llm.stats import BASE, labelled_ratios, text_stats, with_ratios

#: Bound on the labelled rows the learner sees.
MAX_ROWS = 20_000


@dataclass(frozen=True)
class Condition:
    feature: str
    op: str  # ">=" or "<"
    value: float

    def column(self) -> Column:
        c = F.col(f"r_{self.feature}")
        return c >= F.lit(self.value) if self.op == ">=" else c < F.lit(self.value)

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.value if self.op == ">=" else x[self.feature] < self.value


@dataclass
class DecisionList:
    """Ordered rules; a row gets the verdict of the first that holds, else the default (keep)."""

    rules: list[tuple[list[Condition], str]] = field(default_factory=list)
    default: str = "keep"

    def column(self) -> Column:
        out = None
        for conds, verdict in self.rules:
            c = F.lit(True)
            for k in conds:
                c = c & k.column()
            out = F.when(c, verdict) if out is None else out.when(c, verdict)
        return F.lit(self.default) if out is None else out.otherwise(self.default)

    def describe(self) -> list[str]:
        return [" and ".join(f"{c.feature} {c.op} {c.value:g}" for c in conds) + f" -> {v}"
                for conds, v in self.rules] + [f"else -> {self.default}"]


def _covered(conds, x, n):
    m = np.ones(n, dtype=bool)
    for c in conds:
        m &= c.holds(x)
    return m


def _grow(x, y, cuts, max_conds):
    """Add the threshold of the highest information gain until no kept row is covered."""
    m, conds = np.ones(len(y), dtype=bool), []
    while len(conds) < max_conds:
        p0, n0 = int((m & y).sum()), int((m & ~y).sum())
        if p0 == 0 or n0 == 0:
            break
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for f, values in cuts.items():
            for v in values:
                ge = x[f] >= v
                for op, hit in ((">=", ge), ("<", ~ge)):
                    h = m & hit
                    p = int((h & y).sum())
                    if p == 0:
                        continue
                    n = int(h.sum()) - p
                    gain = p * (np.log2(p / (p + n)) - base)
                    if gain > best[0]:
                        best = (gain, Condition(f, op, float(v)))
        if best[1] is None:
            break
        conds.append(best[1])
        m &= best[1].holds(x)
    return conds


def _prune(conds, x, y):
    """The prefix of the rule with the best (p - n) / (p + n) on the pruning rows."""
    best, kept = -2.0, conds
    for k in range(len(conds), 0, -1):
        m = _covered(conds[:k], x, len(y))
        p, n = int((m & y).sum()), int((m & ~y).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best:
            best, kept = worth, conds[:k]
    return kept


def learn(x: dict[str, np.ndarray], reject: np.ndarray, prune_row: np.ndarray, *, max_rules: int = 8,
          max_conds: int = 3, n_cuts: int = 24, min_precision: float = 0.9,
          min_cover: int = 3) -> DecisionList:
    """A decision list for the rejected rows. ``prune_row`` marks the pruning rows.

    A rule joins the list if, over growing and pruning rows together, it
    covers ``min_cover`` rejected rows and ``min_precision`` of what it covers
    is rejected. No labelled rows, or none rejected: the empty list (keep all).
    """
    out, left = DecisionList(), np.ones(len(reject), dtype=bool)
    cuts = {f: np.unique(np.quantile(v, np.linspace(0, 1, n_cuts + 2)[1:-1])) for f, v in x.items() if len(v)}
    # rare rejected kinds live beyond the overall quantiles: cut inside them too
    if reject.any():
        cuts = {f: np.unique(np.concatenate([c, np.quantile(x[f][reject], np.linspace(0, 1, n_cuts + 2)[1:-1])]))
                for f, c in cuts.items()}
    for _ in range(max_rules):
        g, q = left & ~prune_row, left & prune_row
        if int((g & reject).sum()) < min_cover:
            break
        conds = _grow({f: v[g] for f, v in x.items()}, reject[g], cuts, max_conds)
        if not conds:
            break
        conds = _prune(conds, {f: v[q] for f, v in x.items()}, reject[q])
        m = _covered(conds, x, len(reject)) & left
        p, n = int((m & reject).sum()), int((m & ~reject).sum())
        if p < min_cover or p < min_precision * (p + n):
            break
        out.rules.append((conds, "reject"))
        left &= ~m
    return out


def fit(docs: DataFrame, labels: DataFrame, use: Column | None = None, max_rows: int = MAX_ROWS,
        **options) -> DecisionList:
    """Learn the list from (at most ``max_rows``) rows of ``labels.quality``; 0 is rejected."""
    s = labelled_sample(docs, labels, "quality", max_rows, use)
    ids, label, x = labelled_ratios(s)
    return learn(x, label == 0, ids % 3 == 0, **options)


def quality_rules(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """id, base statistics, base_failed, verdict of the list and kept, one row per input row.

    A null or empty text has no words: base_failed, not kept. Null ids stay;
    repeated rows are judged alike; other columns are dropped.
    """
    st = text_stats(docs, [id_col], text_col, more=True)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    st = with_ratios(st).select(id_col, *BASE, failed.alias("base_failed"), rules.column().alias("verdict"))
    return st.withColumn("kept", ~F.col("base_failed") & (F.col("verdict") == "keep"))
