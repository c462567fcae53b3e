"""Toxicity: a lexicon trie met by Levenshtein automata, with context scores.

The lexicon is learned from labelled texts: words, and stems that carry many
endings, whose document frequencies among toxic texts cannot be chance. At
scoring, each distinct word runs through one automaton: the Levenshtein
automata of the terms intersected with the lexicon's trie, determinised state
by state as words need them. Each hit is weighed by its context window, which
tells quotation from abuse; a logistic model turns the sums into a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minpair.llm.arrow import map_arrow
from minpair.llm.common import crc_fold, labelled_sample, no_null, written

#: Bound on the labelled texts the lexicon and the weights are learned from.
MAX_ROWS = 8_000
CUTOFF = 0.3
FEATURES = ("exact", "fuzzy", "stem", "quoted", "rate")

_WORD = re.compile(r"[^\W_]+")
_QUOTES = "\"“”„«»‹›"
# Reporting words (fixed values): a hit near one, or inside quotation marks, is quoted.
_REPORTS = frozenset(("said says wrote writes called quote quoted quotes word "
                      "sagte schrieb nannte zitat dit écrit citation dijo escribió cita").split())


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool  # any ending may follow

    @property
    def distance(self) -> int:
        """Edits allowed in a misspelling of the term."""
        n = len(self.text)
        return 0 if self.stem or n < 5 else 1 if n < 9 else 2


class LexiconAutomaton:
    """Determinised on demand; at most ``max_states`` states are held, then it starts anew."""

    def __init__(self, terms: list[Term], max_states: int = 50_000):
        self.child: list[dict[str, int]] = [{}]
        self.reach = [0]  # edits allowed by any term below the node
        self.word, self.stem = [None], [False]
        self.limit = max_states
        for t in terms:
            node = 0
            self.reach[0] = max(self.reach[0], t.distance)
            for ch in t.text:
                nxt = self.child[node].get(ch)
                if nxt is None:
                    nxt = self.child[node][ch] = len(self.child)
                    self.child.append({})
                    self.reach.append(0)
                    self.word.append(None)
                    self.stem.append(False)
                node = nxt
                self.reach[node] = max(self.reach[node], t.distance)
            if t.stem:
                self.stem[node] = True
            else:
                self.word[node] = t.distance
        self._reset()

    def _reset(self) -> None:
        self.moves: list[dict[str, int]] = []
        self.result: list[tuple] = []  # (edits of the best word or None, stem reached)
        self.number: dict[frozenset, int] = {}
        self.items: list[frozenset] = []
        # the first letter of a term is never edited: the root only moves by match
        self.start = self._state({0: 0}, False)

    def _state(self, at: dict[int, int], stem: bool) -> int:
        key = frozenset(at.items()) if not stem else frozenset([(-1, 0)])
        s = self.number.get(key)
        if s is None:
            s = self.number[key] = len(self.items)
            self.items.append(key)
            self.moves.append({})
            best = min((e for n, e in at.items() if self.word[n] is not None and e <= self.word[n]), default=None)
            self.result.append((best, stem))
        return s

    def _move(self, state: int, ch: str) -> int:
        at: dict[int, int] = {}

        def add(node, e):
            if e <= self.reach[node] and e < at.get(node, 99):
                at[node] = e
                if node:  # letters of the term left out
                    for c in self.child[node].values():
                        add(c, e + 1)

        stem = False
        for node, e in self.items[state]:
            nxt = self.child[node].get(ch)
            if nxt is not None:
                add(nxt, e)
                stem = stem or (e == 0 and self.stem[nxt])
            if node:
                add(node, e + 1)  # a letter too many
                for c in self.child[node].values():
                    add(c, e + 1)  # another letter
        return self._state(at, stem)

    def match(self, word: str) -> str | None:
        """``exact``, ``fuzzy`` or ``stem``, or None."""
        if len(self.items) > self.limit:
            self._reset()
        s, moves = self.start, self.moves
        for ch in word:
            m = moves[s].get(ch)
            if m is None:
                m = moves[s][ch] = self._move(s, ch)
            s = m
            if self.result[s][1]:
                return "stem"
            if not self.items[s]:
                return None
        e = self.result[s][0]
        return None if e is None else "exact" if e == 0 else "fuzzy"


class _Seen(dict):
    """Word -> kind of hit or None; a missing word runs through the automaton."""

    def __init__(self, automaton: LexiconAutomaton, room: int):
        super().__init__()
        self.automaton, self.room = automaton, room

    def __missing__(self, word: str) -> str | None:
        if len(self) >= self.room:
            self.clear()
        hit = self[word] = self.automaton.match(word)
        return hit


class Scorer:
    """Features of one text; remembers the words it has seen."""

    def __init__(self, terms: list[Term], window: int = 6, cache_words: int = 500_000):
        self.window = window
        self.seen = _Seen(LexiconAutomaton(terms), cache_words)

    def features(self, text: str) -> tuple[float, ...]:
        low = text.lower()
        words = _WORD.findall(low)
        hits = [(i, h) for i, h in enumerate(map(self.seen.__getitem__, words)) if h is not None]
        if not hits:
            return (0.0,) * len(FEATURES)
        sums = dict.fromkeys(FEATURES, 0.0)
        place = [m.span() for m in _WORD.finditer(low)]
        for i, kind in hits:
            first, last = max(0, i - self.window), min(len(words) - 1, i + self.window)
            before, after = low[place[first][0]:place[i][0]], low[place[i][1]:place[last][1]]
            marks = min(sum(c in _QUOTES for c in before), sum(c in _QUOTES for c in after))
            if marks or any(w in _REPORTS for w in words[first:i]):
                sums["quoted"] += 1
            else:
                sums[kind] += 1
        sums["rate"] = 100.0 * len(hits) / len(words)
        return tuple(math.log1p(sums[f]) for f in FEATURES)


@dataclass
class ToxicityModel:
    terms: list[Term]
    weights: list[float]  # intercept, then FEATURES

    def score(self) -> Column:
        z = F.lit(self.weights[0])
        for f, w in zip(FEATURES, self.weights[1:]):
            z = z + F.lit(w) * F.col(f"f_{f}")
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


_SCORERS: dict[tuple, Scorer] = {}


def toxicity_features(docs: DataFrame, terms: list[Term], keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` plus f_<feature> of every whole text (null as empty: all zero)."""
    d = docs.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], no_null(text_col).alias("t"))
    terms = list(terms)
    schema = ", ".join([f"_k{i} {d.schema[i].dataType.simpleString()}" for i in range(len(keys))]
                       + [f"f_{f} double" for f in FEATURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = tuple(terms)
        scorer = _SCORERS.get(key)
        if scorer is None:
            _SCORERS.clear()
            scorer = _SCORERS[key] = Scorer(terms)
        for b in batches:
            rows = [scorer.features(t.as_py()) for t in b.column(b.num_columns - 1)]
            cols = list(zip(*rows)) if rows else [()] * len(FEATURES)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], *[pa.array(c, pa.float64()) for c in cols]],
                names=[f"_k{i}" for i in range(len(keys))] + [f"f_{f}" for f in FEATURES])

    out = map_arrow(d, run, schema)
    return out.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *[f"f_{f}" for f in FEATURES])


def term_counts(sample: DataFrame, longest: int = 12) -> DataFrame:
    """(term, pos, neg): document frequencies among toxic and other texts of every
    word (ending in ``$``) and every word beginning of 4 to ``longest`` letters.
    Equal texts count once."""
    w = F.array_distinct(F.array_remove(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), ""))
    d = sample.select("text", "label").distinct().select("label", w.alias("w"))
    begins = F.transform("w", lambda x: F.when(F.length(x) >= 4, F.transform(
        F.sequence(F.lit(4), F.least(F.length(x), F.lit(longest))), lambda k: F.substring(x, F.lit(1), k)))
        .otherwise(F.array().cast("array<string>")))
    ends = F.transform("w", lambda x: F.concat(x, F.lit("$")))
    d = d.select("label", F.explode(F.array_distinct(F.concat(F.flatten(begins), ends))).alias("term"))
    return d.groupBy("term").agg(F.sum((F.col("label") == 1).cast("long")).alias("pos"),
                                 F.sum((F.col("label") != 1).cast("long")).alias("neg"))


def learn_lexicon(counts: list[tuple[str, int, int]]) -> list[Term]:
    """Terms from the significant (term, pos, neg): each significant beginning is
    followed down the trie while one continuation keeps nearly all of it; where
    that ends in a whole word, the word is a term, else the beginning is a stem."""
    have = {t: p for t, p, _ in counts}
    after: dict[str, list[str]] = {}
    for t in have:
        after.setdefault(t[:-1], []).append(t)
    out: dict[str, Term] = {}
    for t in sorted(have):
        if t[:-1] in have:
            continue
        while not t.endswith("$"):
            nxt = max(after.get(t, []), key=lambda c: (have[c], c), default=None)
            if nxt is None or have[nxt] < 0.9 * have[t]:
                break
            t = nxt
        term = Term(t[:-1], False) if t.endswith("$") else Term(t, True)
        out[t] = term
    return list(out.values())


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> list[float]:
    a = np.hstack([np.ones((len(y), 1)), x])
    w = np.zeros(a.shape[1])
    reg = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + reg
        w = w - np.linalg.solve(h, a.T @ (p - y) + reg @ w)
    return [float(v) for v in w]


def fit(docs: DataFrame, labels: DataFrame, use: Column | None = None, max_rows: int = MAX_ROWS,
        min_share: float = 0.01, min_docs: int = 4, least_g2: float = 20.0) -> ToxicityModel:
    """Lexicon and weights from at most ``max_rows`` rows of ``labels.toxic`` that pass
    ``use`` (over ``id``). Without toxic rows the lexicon is empty and every score low."""
    sample = written(labelled_sample(docs, labels, "toxic", max_rows, use))
    n = {r[0]: r[1] for r in sample.select("text", "label").distinct().groupBy("label").count().collect()}
    n_pos, n_neg = n.get(1, 0), sum(v for k, v in n.items() if k != 1)
    terms: list[Term] = []
    if n_pos and n_neg:
        c, share = term_counts(sample), n_pos / (n_pos + n_neg)
        a, b = F.col("pos").cast("double"), F.col("neg").cast("double")
        g2 = 2 * (a * F.log(a / ((a + b) * share)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0))
        odds = ((a + 0.5) / (n_pos + 1)) / ((b + 0.5) / (n_neg + 1))
        c = (c.filter(a >= max(min_docs, min_share * n_pos)).filter((odds >= 8) & (g2 >= least_g2))
             .orderBy(g2.desc(), "term"))
        # as many as the bounded sample has: each is in at least min_share of its toxic texts
        terms = learn_lexicon([tuple(r) for r in c.collect()])
    rows = sorted(toxicity_features(sample, terms, ["id", "label"]).collect())
    x = np.array([r[2:] for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    y = np.array([r[1] for r in rows], dtype=float)
    weights = _logistic(x, y) if len(rows) and 0 < y.sum() < len(y) else [-3.0] + [0.0] * len(FEATURES)
    return ToxicityModel(terms, weights)


def toxicity_scores(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text",
                    cutoff: float = CUTOFF) -> DataFrame:
    """id, score, predicted and the features, one row per input row. Null and empty
    texts have no hits; null ids and repeated rows stay; other columns are dropped."""
    f = toxicity_features(docs, model.terms, [id_col], text_col)
    f = f.withColumn("score", model.score())
    return f.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))


def training_fold(id_col: str = "id") -> Column:
    return crc_fold(id_col, 4) != 2
