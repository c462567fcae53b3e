"""User-supplied models, run where the data is.

A ``Scorer`` turns a pandas batch of masked or plain inputs into one log
probability per row. ``run_scorer`` runs it with ``mapInPandas``: Arrow
batches in, Arrow batches out, one model instance per Python worker (built
on first use by ``prepare``), and only (keys, logprob) leave the worker: the
vocabulary axis never reaches the JVM.
"""

from __future__ import annotations

from typing import Iterator, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from minpair.functions.numeric import COARSE, FINE
from minpair.functions.tokens import MASK_ID, PAD_ID

#: The model that this Python worker holds: one at most, by its scorer's key.
_HELD: dict[str, object] = {}
_SHIPPED: set[str] = set()

# FIXED VALUES: only unscaled probabilities are supported.
SUPPORTED_TEMPERATURE = 1.0


class Scorer(Protocol):
    """``key`` identifies the model; ``prepare`` loads it (once per worker);
    ``logprob`` returns log P(label) for every row of a batch."""

    key: str

    def prepare(self) -> object: ...

    def logprob(self, model: object, batch: pd.DataFrame) -> np.ndarray: ...


def held_model(scorer) -> object:
    """The scorer's model, loaded on first use. A worker holds one model: the one
    before goes first (its ``close``, if it has one, is called)."""
    if scorer.key not in _HELD:
        for old in _HELD.values():
            if callable(close := getattr(old, "close", None)):
                close()
        _HELD.clear()
        _HELD[scorer.key] = scorer.prepare()
    return _HELD[scorer.key]


def check_temperature(temperature: float) -> float:
    """The scorer accepts only temperature 1.0."""
    if float(temperature) != SUPPORTED_TEMPERATURE:
        raise ValueError(f"temperature {temperature} is not supported; only 1.0")
    return float(temperature)


def ship_package(spark) -> None:
    """Make this package importable in the Python workers (once per
    application): the scorer and its helpers are pickled by reference. The
    zip is built on the driver and distributed by Spark (``addPyFile``)."""
    import os
    import tempfile
    import zipfile

    import minpair
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no context (Spark Connect): rely on the environment
        return
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(minpair.__file__))
    fd, path = tempfile.mkstemp(prefix="minpair-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def run_scorer(df: DataFrame, scorer: Scorer, keys: list[str], temperature: float = 1.0,
               out_col: str = "logprob") -> DataFrame:
    """keys + ``out_col`` for every input row, computed by ``scorer``.

    Inputs are sorted by length inside each partition first when a
    ``valid_length`` column exists, so batches hold similar lengths and
    padding stays small (the length-bucketing of the original, without a
    shuffle).
    """
    check_temperature(temperature)
    ship_package(df.sparkSession)
    key_fields = [f for f in df.schema.fields if f.name in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in key_fields) + f", {out_col} double"
    src = df.sortWithinPartitions("valid_length") if "valid_length" in df.columns else df

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held_model(scorer)
        for b in batches:
            out = b[keys].copy()
            out[out_col] = np.asarray(scorer.logprob(model, b), dtype="float64")
            yield out

    return src.mapInPandas(score, schema)


class LogitsScorer:
    """Reference scorer over precomputed logits (``logits`` array column):
    log-softmax then the label's entry, in NumPy. Used to check the plumbing
    against the SQL log-softmax, and as a template for real models."""

    key = "logits-identity"

    def prepare(self) -> object:
        return None

    def logprob(self, model: object, batch: pd.DataFrame) -> np.ndarray:
        rows = batch["logits"].to_numpy()
        labels = batch["label"].to_numpy().astype("int64")
        if len(rows) and len({len(r) for r in rows}) == 1:
            # one vocabulary size: the whole Arrow batch as one matrix
            x = np.stack([np.asarray(r, dtype="float64") for r in rows])
            m = x.max(axis=1, keepdims=True)
            lse = m[:, 0] + np.log(np.exp(x - m).sum(axis=1))
            return x[np.arange(len(x)), labels] - lse
        out = np.empty(len(rows), dtype="float64")
        for i, (row, label) in enumerate(zip(rows, labels)):
            x = np.asarray(row, dtype="float64")
            m = x.max()
            out[i] = x[int(label)] - m - np.log(np.exp(x - m).sum())
        return out


class TokenModel(Protocol):
    """A user's model over token ids: unnormalised scores of every label at given places.

    ``prepare`` loads it, once per Python worker. ``logits`` is one forward
    pass over a padded batch: ``ids`` and ``mask`` (true where a row has a
    token) are (batch, length); it returns a (len(rows), labels) array, the
    scores at place ``places[i]`` of row ``rows[i]``. ``label`` maps token ids
    to its columns. ``block_cells``, if set, bounds batch x length of a pass.
    """

    key: str

    def prepare(self) -> object: ...

    def logits(self, model: object, ids: np.ndarray, mask: np.ndarray, rows: np.ndarray,
               places: np.ndarray) -> np.ndarray: ...

    def label(self, ids: np.ndarray) -> np.ndarray: ...


class ToyModel:
    """A deterministic model of 64 labels, to check the scoring path end to end."""

    def __init__(self, key: str = "toy-64"):
        self.key = key

    def prepare(self) -> object:
        return np.arange(64, dtype="int64") ** 2 * 7

    def logits(self, model, ids, mask, rows, places):
        s = np.where(mask, ids, 0).sum(axis=1)[rows] * 31 + places * 17
        return ((s[:, None] + model[None, :]) % 101) / 10.0

    def label(self, ids):
        return ids % 64


#: Id cells (rows x longest row) of one forward pass, and how many passes' worth of sentences are packed together.
BLOCK_CELLS, HELD_BLOCKS = 1 << 16, 32


def pack(lengths: np.ndarray, budget: int) -> Iterator[tuple[int, int]]:
    """Blocks [lo, hi) of rows in ascending order of length whose padded size stays within
    ``budget`` cells (a row longer than that is a block of its own)."""
    lo = 0
    while lo < len(lengths):
        hi = min(len(lengths), lo + max(1, budget // max(1, int(lengths[lo]))))
        while hi - lo > 1 and (hi - lo) * int(lengths[hi - 1]) > budget:
            hi = lo + max(1, budget // int(lengths[hi - 1]))
        yield lo, hi
        lo = hi


class SentenceScorer:
    """Scores of many sentences by few forward passes: rows of all sentences, sorted by
    length, fill blocks of a cell budget; scores are added up per sentence (E11)."""

    def __init__(self, scorer: TokenModel, model: object):
        self.scorer, self.model = scorer, model
        self.budget = int(getattr(scorer, "block_cells", BLOCK_CELLS))

    def _padded(self, sentences, owner):
        lengths = np.array([len(sentences[i]) for i in owner])
        ids = np.full((len(owner), lengths.max()), PAD_ID, dtype="int64")
        for at, i in enumerate(owner):
            ids[at, :lengths[at]] = sentences[i]
        return ids, np.arange(ids.shape[1])[None, :] < lengths[:, None]

    def _logprob(self, ids, mask, rows, places, labels):
        x = np.asarray(self.scorer.logits(self.model, ids, mask, rows, places), dtype="float64")
        if len(x) != len(rows):
            raise ValueError("the model must return one row of scores per place asked for")
        m = x.max(axis=1, keepdims=True)
        return x[np.arange(len(x)), self.scorer.label(labels)] - m[:, 0] - np.log(np.exp(x - m).sum(axis=1))

    @staticmethod
    def _add(total, owner, logprob):
        """Add token scores to ``total`` in two whole parts, whose sums do not depend on the packing."""
        x = logprob * COARSE
        hi = np.rint(x)
        for part, steps in enumerate((hi, np.rint((x - hi) * FINE))):
            total[part] += np.bincount(owner, weights=steps, minlength=total.shape[1])

    def mlm(self, sentences: list[np.ndarray]) -> np.ndarray:
        """Sum over the inner positions of log P(label) with that position masked; 0.0 without any."""
        lengths = np.array([len(s) for s in sentences], dtype="int64")
        copies = np.maximum(lengths - 2, 0)
        order = np.argsort(lengths, kind="stable")
        owner = np.repeat(order, copies[order])
        place = 1 + np.arange(len(owner)) - np.repeat(np.cumsum(copies[order]) - copies[order], copies[order])
        total = np.zeros((2, len(sentences)))
        for lo, hi in pack(lengths[owner], self.budget):  # the masked copies of one block only
            rows, at = np.arange(hi - lo), place[lo:hi]
            ids, mask = self._padded(sentences, owner[lo:hi])
            labels = ids[rows, at]
            ids[rows, at] = MASK_ID
            self._add(total, owner[lo:hi], self._logprob(ids, mask, rows, at, labels))
        return total[0] / COARSE + total[1] / (COARSE * FINE)

    def holistic(self, sentences: list[np.ndarray]) -> np.ndarray:
        """Mean cross entropy over all positions of the plain sentence; NaN without any.
        One row per sentence, whatever its length."""
        lengths = np.array([len(s) for s in sentences], dtype="int64")
        order = np.argsort(lengths, kind="stable")
        order = order[lengths[order] > 0]
        total = np.zeros((2, len(sentences)))
        for lo, hi in pack(lengths[order], self.budget):
            owner = order[lo:hi]
            ids, mask = self._padded(sentences, owner)
            rows, at = np.nonzero(mask)  # no padding enters the loss
            self._add(total, owner[rows], -self._logprob(ids, mask, rows, at, ids[rows, at]))
        n = np.maximum(lengths, 1)
        return np.where(lengths > 0, total[0] / n / COARSE + total[1] / n / (COARSE * FINE), np.nan)


def scorer_scores(encoded: DataFrame, scorer: TokenModel, keys: list[str], ids_col: str = "token_ids",
                  methods: tuple[str, ...] = ("mlm", "holistic"), max_ids: int | None = None, profile=None) -> DataFrame:
    """keys + a score per method, by a user's model. Sentences of many rows share the
    forward passes, and all methods one loaded model. Beyond ``max_ids`` ids
    (boundaries included) ``mlm`` is NULL. ``profile`` is a ResourceProfile
    for the stage that runs the model (its accelerators and memory)."""
    ship_package(encoded.sparkSession)
    schema = ", ".join([*(f"{k} {encoded.schema[k].dataType.simpleString()}" for k in keys), *(f"{m} double" for m in methods)])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work = SentenceScorer(scorer, held_model(scorer))

        def flush(held):
            rows = pd.concat(held, ignore_index=True)
            ids = [np.asarray(x, dtype="int64") for x in rows[ids_col]]
            out = rows[keys].copy()
            for m in methods:
                if m == "mlm" and max_ids is not None:
                    fits = np.array([len(x) <= max_ids for x in ids], dtype=bool)
                    out[m] = np.where(fits, work.mlm([x if ok else x[:0] for x, ok in zip(ids, fits)]), np.nan)
                else:
                    out[m] = getattr(work, m)(ids)
            return out

        held, cells = [], 0
        for b in batches:
            if len(b):
                held.append(b)
                n = b[ids_col].map(len).to_numpy(dtype="int64")
                cells += int((n * np.maximum(n - 2, 1)).sum() if "mlm" in methods else n.sum())
            if cells >= HELD_BLOCKS * work.budget:
                yield flush(held)
                held, cells = [], 0
        if held:
            yield flush(held)

    return encoded.select(*keys, ids_col).mapInPandas(score, schema, profile=profile)


def scorer_mlm_scores(encoded: DataFrame, scorer: TokenModel, keys: list[str], ids_col: str = "token_ids") -> DataFrame:
    """D3 + E8 + E7: keys + score, the sum over the inner positions of log P(label)
    with that position masked, read at the masked position only. Copies are
    made lazily inside the worker; a sentence without tokens scores 0.0."""
    return scorer_scores(encoded, scorer, keys, ids_col, ("mlm",)).withColumnRenamed("mlm", "score")


def scorer_holistic_scores(encoded: DataFrame, scorer: TokenModel, keys: list[str], ids_col: str = "token_ids") -> DataFrame:
    """E6 with a user's model: keys + score, the mean cross entropy over all positions
    of the plain sentence, boundaries included. Smaller is better."""
    return scorer_scores(encoded, scorer, keys, ids_col, ("holistic",)).withColumnRenamed("holistic", "score")


def scorer_fill_mask(encoded: DataFrame, scorer: TokenModel, keys: list[str], ids_col: str = "token_ids",
                     k: int = 5, profile=None) -> DataFrame:
    """E10 with a user's model: keys + (pos, rank, label, logprob), the ``k`` most probable
    labels at every position of the plain sentence, ties by label. The label axis stays
    in the worker: a partial selection keeps k labels a position before anything leaves."""
    ship_package(encoded.sparkSession)
    schema = ", ".join([*(f"{x} {encoded.schema[x].dataType.simpleString()}" for x in keys),
                        "pos int", "rank int", "label int", "logprob double"])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work = SentenceScorer(scorer, held_model(scorer))
        for b in batches:
            sentences = [np.asarray(x, dtype="int64") for x in b[ids_col]]
            lengths = np.array([len(s) for s in sentences], dtype="int64")
            order = np.argsort(lengths, kind="stable")
            order = order[lengths[order] > 0]
            for lo, hi in pack(lengths[order], work.budget):
                ids, mask = work._padded(sentences, order[lo:hi])
                rows, at = np.nonzero(mask)
                x = np.asarray(scorer.logits(work.model, ids, mask, rows, at), dtype="float64")
                m = x.max(axis=1, keepdims=True)
                x = x - m - np.log(np.exp(x - m).sum(axis=1, keepdims=True))
                top = min(k, x.shape[1])
                # the k-th best value splits off few labels; those equal to it come by label
                least = np.partition(x, x.shape[1] - top, axis=1)[:, x.shape[1] - top]
                r, label = np.nonzero(x >= least[:, None])
                best = np.lexsort((label, -x[r, label], r))
                r, label = r[best], label[best]
                rank = np.arange(len(r)) - np.searchsorted(r, r)
                r, label, rank = (y[rank < top] for y in (r, label, rank))
                out = b[keys].iloc[order[lo:hi][rows[r]]].reset_index(drop=True)
                yield out.assign(pos=at[r].astype("int32"), rank=(rank + 1).astype("int32"), label=label.astype("int32"),
                                 logprob=x[r, label])

    return encoded.select(*keys, ids_col).mapInPandas(score, schema, profile=profile)
