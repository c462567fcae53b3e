"""Quality classifier: a sparse rule ensemble.

Small trees over the text statistics give their paths as conjunctive rules;
a lasso logistic regression weights the rules (and clipped linear terms) and
zeroes most; what is left is one Spark column expression. Trees and lasso are
fitted in numpy on a bounded sample of labelled rows (``max_rows``); scoring
is JVM-side over every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minpair.llm.common import crc_fold, labelled_sample
from minpair.llm.stats import labelled_ratios, text_stats, with_ratios

MAX_ROWS = 20_000
CUTOFF = 0.3

Rule = tuple[tuple[str, str, float], ...]  # conditions (feature, ">=" or "<", threshold)


@dataclass
class RuleEnsemble:
    intercept: float
    rules: list[tuple[Rule, float]]
    linear: list[tuple[str, float, float, float]]  # feature, low, high, weight

    def score(self) -> Column:
        """Probability of label 1, from the columns of ``with_ratios``."""
        z = F.lit(float(self.intercept))
        for conds, w in self.rules:
            c = F.lit(True)
            for f, op, v in conds:
                c = c & (F.col(f"r_{f}") >= F.lit(v) if op == ">=" else F.col(f"r_{f}") < F.lit(v))
            z = z + F.when(c, F.lit(float(w))).otherwise(0.0)
        for f, lo, hi, w in self.linear:
            z = z + F.lit(w) * (F.least(F.greatest(F.col(f"r_{f}"), F.lit(lo)), F.lit(hi)) - F.lit(lo)) / F.lit(hi - lo)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{f} {op} {v:g}" for f, op, v in c) for c, w in self.rules]


def _tree(codes, edges, names, resid, rows, feats, depth, path, out, min_leaf=5):
    """Least-squares tree on binned statistics; adds each node's path to ``out``,
    returns the prediction for ``rows``."""
    pred = np.full(len(rows), resid[rows].mean() if len(rows) else 0.0)
    if depth == 0 or len(rows) < 2 * min_leaf:
        return pred
    r, best = resid[rows], (1e-9, None, None)
    total, n = r.sum(), len(r)
    for f in feats:
        k = len(edges[f])
        if k == 0:
            continue
        c = codes[rows, f]
        cnt = np.bincount(c, minlength=k + 1).cumsum()[:-1]
        s = np.bincount(c, weights=r, minlength=k + 1).cumsum()[:-1]
        ok = (cnt >= min_leaf) & (n - cnt >= min_leaf)
        if not ok.any():
            continue
        gain = np.where(ok, s**2 / np.maximum(cnt, 1) + (total - s) ** 2 / np.maximum(n - cnt, 1) - total**2 / n, -1)
        j = int(gain.argmax())
        if gain[j] > best[0]:
            best = (gain[j], f, j)
    if best[1] is None:
        return pred
    _, f, j = best
    left = codes[rows, f] <= j
    for side, op in ((left, "<"), (~left, ">=")):
        p = (*path, (names[f], op, float(edges[f][j])))
        out.append(p)
        pred[side] = _tree(codes, edges, names, resid, rows[side], feats, depth - 1, p, out, min_leaf)
    return pred


def _matrix(rules: list[Rule], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    cols = []
    for r in rules:
        m = np.ones(n, dtype=bool)
        for f, op, v in r:
            m &= x[f] >= v if op == ">=" else x[f] < v
        cols.append(m)
    return np.array(cols, dtype=float).T if cols else np.zeros((n, 0))


def _lasso(a: np.ndarray, y: np.ndarray, lam: float, iterations: int) -> tuple[float, np.ndarray]:
    """Logistic loss plus lam * |w|, by accelerated proximal gradient; the intercept is free."""
    n, d = a.shape
    # Lipschitz bound of the mean logistic loss, by power iteration
    v = np.ones(d + 1) / np.sqrt(d + 1)
    full = np.hstack([np.ones((n, 1)), a])
    for _ in range(20):
        v = full.T @ (full @ v)
        v /= max(np.linalg.norm(v), 1e-12)
    step = 1.0 / max(np.linalg.norm(full @ v) ** 2 / n / 4 * 1.05, 1e-9)
    w, z, t = np.zeros(d + 1), np.zeros(d + 1), 1.0
    for _ in range(iterations):
        g = full.T @ (1 / (1 + np.exp(-(full @ z))) - y) / n
        u = z - step * g
        u[1:] = np.sign(u[1:]) * np.maximum(np.abs(u[1:]) - step * lam, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = u + (t - 1) / t2 * (u - w), u, t2
    return float(w[0]), w[1:]


def learn(x: dict[str, np.ndarray], y: np.ndarray, *, n_trees: int = 24, depth: int = 3, rate: float = 0.2,
          lam: float = 5e-4, iterations: int = 400, seed: int = 11) -> RuleEnsemble:
    """Boosted small trees -> path rules -> lasso weights. With no rows, or one
    class only, the ensemble is its intercept (a smoothed share of label 1)."""
    n, names = len(y), list(x)
    share = (y.sum() + 1.0) / (n + 2.0)
    if n < 10 or y.min() == y.max():
        return RuleEnsemble(float(np.log(share / (1 - share))), [], [])
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[f], np.linspace(0, 1, 34)[1:-1])) for f in names]
    rare = y == (1 if y.mean() < 0.5 else 0)
    edges = [np.unique(np.concatenate([e, np.quantile(x[f][rare], np.linspace(0, 1, 34)[1:-1])]))
             for e, f in zip(edges, names)]
    codes = np.stack([np.searchsorted(e, x[f], side="right") for e, f in zip(edges, names)], axis=1)
    paths: list[Rule] = []
    f_hat = np.full(n, np.log(share / (1 - share)))
    for _ in range(n_trees):
        resid = y - 1 / (1 + np.exp(-f_hat))
        feats = rng.permutation(len(names))[: max(3, len(names) * 2 // 3)]
        rows = np.flatnonzero(rng.random(n) < 0.7)
        own: list[Rule] = []
        _tree(codes, edges, names, resid, rows, feats, depth, (), own)
        # leaf steps for all rows, from the paths that are not extended
        leaves = [p for p in own if not any(q[: len(p)] == p and len(q) > len(p) for q in own)]
        m = _matrix(leaves, x, n)
        for j in range(m.shape[1]):
            hit = m[:, j] > 0
            if hit.any():
                s = 1 / (1 + np.exp(-f_hat[hit]))
                f_hat[hit] += rate * np.clip(resid[hit].sum() / max((s * (1 - s)).sum(), 1e-3), -4, 4)
        paths += own
    rules, seen, cols = [], set(), []
    for p in dict.fromkeys(paths):
        col = _matrix([p], x, n)[:, 0]
        key = col.tobytes()
        if 0 < col.sum() < n and key not in seen:  # rules that say the same of every row count once
            seen.add(key)
            rules.append(p)
            cols.append(col)
    linear, lin = [], []
    for f in names:
        lo, hi = (float(v) for v in np.quantile(x[f], [0.025, 0.975]))
        if hi > lo:
            linear.append((f, lo, hi))
            lin.append((np.clip(x[f], lo, hi) - lo) / (hi - lo))
    a = np.array(cols + lin, dtype=float).T
    b, w = _lasso(a, y.astype(float), lam, iterations)
    k = len(rules)
    return RuleEnsemble(b, [(r, float(v)) for r, v in zip(rules, w[:k]) if v != 0],
                        [(*t, float(v)) for t, v in zip(linear, w[k:]) if v != 0])


def fit(docs: DataFrame, labels: DataFrame, use: Column | None = None, max_rows: int = MAX_ROWS,
        **options) -> RuleEnsemble:
    """Learn from at most ``max_rows`` rows of ``labels.quality`` that pass ``use`` (over ``id``)."""
    s = labelled_sample(docs, labels, "quality", max_rows, use)
    _, label, x = labelled_ratios(s)
    return learn(x, label, **options)


def quality_scores(docs: DataFrame, model: RuleEnsemble, keys: list[str], text_col: str = "text",
                   cutoff: float = CUTOFF, score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """``keys`` plus score and predicted (1 if score >= ``cutoff``), one row per
    input row. Null and empty texts have all-zero statistics and get the score
    of those; repeated rows score alike; other columns are dropped."""
    st = with_ratios(text_stats(docs, keys, text_col, more=True, named=False))
    st = st.select(*[f"_k{i}" for i in range(len(keys))], model.score().alias("_score"))
    return st.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], F.col("_score").alias(score_col),
                     (F.col("_score") >= cutoff).cast("int").alias(predicted_col))


def training_fold(id_col: str = "id") -> Column:
    return crc_fold(id_col, 5) != 0
