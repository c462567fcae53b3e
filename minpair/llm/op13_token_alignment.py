"""Cross-tokenizer alignment: two tokenisations of one text, side by side.

Both tokenisers cut the same bytes. Per batch, ``pandas.merge_asof`` keyed by
document finds for each token start the other side's covering token, in both
directions; the union of both is every overlapping pair of tokens. Overlapping
tokens with equal ends close a group: the smallest spans that both sides cut
out alike. All pairs of tokens of a group are linked.

How many documents hold an id pair linked is counted over the whole corpus by
one grouped aggregation of each document's distinct pairs, and comes back to
the documents by a join on the pair (broadcast below a checked size).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minpair.llm.arrow import map_arrow
from minpair.llm.common import no_null, written

#: Characters of the texts that are aligned together.
BATCH_CHARS = 600_000
#: Chunks of text whose tokens a worker remembers (in each of two generations), and the longest that is.
HELD_CHUNKS, HELD_CHARS = 200_000, 40
#: Id pairs of one block of links; a group with more pairs goes by its distinct ids.
BLOCK_LINKS, LARGE_GROUP = 1 << 20, 4096
#: Largest number of id pairs (some 30 bytes each) sent to every task.
BROADCAST_MAX_PAIRS = 1_000_000


def byte_letters() -> dict[str, int]:
    """Letter -> byte of the printable alphabet that byte-level vocabularies are written in:
    printable Latin-1 stands for itself, the other bytes follow from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: A single space between two printable ASCII characters. Neither side has a token across the
#: place before it (see ``splits``), so the chunks between such spaces are encoded on their own.
_CHUNK = re.compile("(?<=[!-~]) (?=[!-~])")


class ByteLevelSide:
    """Tokeniser file of byte-level pieces; its token bytes by id."""

    def __init__(self, payload: bytes):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(payload.decode())
        self.tok.encode_special_tokens = True
        letters = byte_letters()
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

        # the usual pre-tokeniser of byte-level pieces lets a piece begin at such a space, never go over it
        spec = json.loads(payload)
        pre = spec.get("pre_tokenizer") or {}
        self.splits = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]


class PieceSide:
    """Piece model with byte fallback; it puts the leading space itself."""

    def __init__(self, payload: bytes):
        import sentencepiece

        self.tok = sentencepiece.SentencePieceProcessor(model_proto=payload)
        self.bytes = []
        for i in range(self.tok.get_piece_size()):
            piece = self.tok.id_to_piece(i)
            byte = re.fullmatch("<0x([0-9A-Fa-f]{2})>", piece)
            self.bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
        # merges never go over a space that no piece has after another character
        self.splits = not any(b" " in x.lstrip(b" ") for x in self.bytes)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.tok.encode(texts, num_threads=1)


def _spans(ids: list[np.ndarray], sizes: np.ndarray) -> pd.DataFrame:
    """doc, id, start, stop of every token; documents laid end to end."""
    flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64)
    stop = np.cumsum(sizes[flat])
    return pd.DataFrame({"doc": np.repeat(np.arange(len(ids)), [len(x) for x in ids]), "id": flat,
                         "start": stop - sizes[flat], "stop": stop})


def group_ends(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Ascending byte offsets where tokens of both sides end."""
    def equal_ends(x, y):
        got = pd.merge_asof(x[["doc", "start", "stop"]], y[["doc", "start", "stop"]].rename(columns={"stop": "other"}),
                            on="start", by="doc")
        stop = got["stop"].to_numpy()
        return stop[stop == got["other"].to_numpy()]

    # overlaps found from either side; each list is ascending
    ends = np.sort(np.concatenate((equal_ends(a, b), equal_ends(b, a))), kind="stable")
    return ends[np.r_[True, ends[1:] != ends[:-1]]] if len(ends) else ends


def _large_pairs(ids_a: np.ndarray, ids_b: np.ndarray, size_b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct id pairs of one group and how often each is linked, in blocks."""
    x, nx = np.unique(ids_a, return_counts=True)
    y, ny = np.unique(ids_b, return_counts=True)
    step = max(1, BLOCK_LINKS // len(y))
    for i in range(0, len(x), step):
        yield (x[i:i + step, None] * size_b + y[None, :]).ravel(), (nx[i:i + step, None] * ny[None, :]).ravel()


def _summed(key: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, and the sums of n (ones if None)."""
    if n is None:
        key = np.sort(key)
    else:
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    if n is None:
        return key[first], np.diff(np.r_[first, len(key)])
    return key[first], np.add.reduceat(n, first) if len(first) else n


def linked_pairs(a: pd.DataFrame, b: pd.DataFrame, group_a: np.ndarray, group_b: np.ndarray, na: np.ndarray, nb: np.ndarray,
                 size_a: int, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, key, links) of every distinct id pair of a document; key = A id * size_b + B id."""
    ida, idb, doc = a["id"].to_numpy(), b["id"].to_numpy(), a["doc"].to_numpy()
    first_a, first_b = np.cumsum(na) - na, np.cumsum(nb) - nb
    pairs, parts = size_a * size_b, []  # keys of the documents lie one after another
    per_a = np.where(na * nb <= LARGE_GROUP, nb, 0)[group_a]  # B tokens that each A token is linked with
    total = np.cumsum(per_a)
    lo = 0
    while lo < len(per_a):  # blocks of A tokens
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + BLOCK_LINKS, side="right")))
        m = per_a[lo:hi]
        row = np.repeat(np.arange(lo, hi), m)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
        parts.append(_summed(doc[row] * pairs + ida[row] * size_b + idb[first_b[group_a[row]] + nth]))
        lo = hi
    for g in np.flatnonzero(na * nb > LARGE_GROUP):
        at = doc[first_a[g]] * pairs
        parts += [(at + key, n) for key, n in _large_pairs(ida[first_a[g]:first_a[g] + na[g]], idb[first_b[g]:first_b[g] + nb[g]], size_b)]
    if not parts:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    key, n = parts[0] if len(parts) == 1 else _summed(*(np.concatenate(x) for x in zip(*parts)))
    return key // pairs, key % pairs, n


class Aligner:
    """Both sides of a worker, and their tables."""

    def __init__(self, a: ByteLevelSide, b: PieceSide):
        self.a, self.b, self.held, self.older = a, b, {}, {}
        self.sizes = [np.array([len(x) for x in s.bytes], dtype=np.int64) for s in (a, b)]
        na, nb = len(a.bytes), len(b.bytes)
        # a token and what follows it: A inside its run, A at its end, B inside, B at its end
        self.text = np.array([*(f"{i}," for i in range(na)), *(f"{i}|" for i in range(na)),
                              *(f"{i}," for i in range(nb)), *(f"{i};" for i in range(nb))], dtype=object)
        self.offset = (0, na, 2 * na, 2 * na + nb)

    def _encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides, or None where a side's bytes are not space + text."""
        out = []
        for text, x, y in zip(texts, self.a.encode(texts), self.b.encode(texts)) if texts else ():
            want = b" " + text.encode()
            same = all(b"".join(map(s.bytes.__getitem__, ids)) == want for s, ids in ((self.a, x), (self.b, y)))
            out.append((np.array(x, dtype="<u4"), np.array(y, dtype="<u4")) if same else None)
        return out

    def _learn(self, chunks: list[str]) -> dict[str, tuple[bytes, bytes] | None]:
        """Packed ids of both sides of new chunks: in one text, cut again at the chunks' ends."""
        plain = [c for c in chunks if "!" <= c[0] <= "~" and "!" <= c[-1] <= "~"]
        got = {}
        if plain and (ids := self._encode([" ".join(plain)])[0]):
            ends = np.cumsum([1 + len(c.encode()) for c in plain])
            sides = []
            for x, sizes in zip(ids, self.sizes):
                stops = np.cumsum(sizes[x])
                at = np.searchsorted(stops, ends)
                if (stops[at] != ends).any():
                    break
                raw, cut = x.tobytes(), [0, *(4 * (at + 1)).tolist()]
                sides.append([raw[i:j] for i, j in zip(cut, cut[1:])])
            if len(sides) == 2:
                got = dict(zip(plain, zip(*sides)))
        rest = [c for c in chunks if c not in got]
        return got | {c: x and (x[0].tobytes(), x[1].tobytes()) for c, x in zip(rest, self._encode(rest))}

    def _chunk_tokens(self, chunks: list[str]) -> dict[str, tuple[bytes, bytes] | None]:
        got, new = {}, []
        for c in dict.fromkeys(chunks):
            x = self.held.get(c) or self.older.get(c)
            if x:
                got[c] = self.held[c] = x
            else:
                new.append(c)
        if new:
            learned = self._learn(new)
            got |= learned
            self.held |= {c: x for c, x in learned.items() if x and len(c) <= HELD_CHARS}
        if len(self.held) > HELD_CHUNKS:
            self.held, self.older = {}, self.held
        return got

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides; none where the text is empty or a side's bytes are not space + text."""
        none = np.zeros(0, dtype=np.int64)
        ids = [[none] * len(texts), [none] * len(texts)]
        if not (self.a.splits and self.b.splits):
            some = [i for i, t in enumerate(texts) if t]
            for i, x in zip(some, self._encode([texts[i] for i in some])):
                if x:
                    ids[0][i], ids[1][i] = (y.astype(np.int64) for y in x)
            return ids[0], ids[1]
        chunks = [_CHUNK.split(t) if t else [] for t in texts]
        got = self._chunk_tokens([c for x in chunks for c in x])
        for i, x in enumerate(chunks):
            own = [got[c] for c in x]
            if own and None not in own:
                for k in (0, 1):
                    ids[k][i] = np.frombuffer(b"".join([o[k] for o in own]), dtype="<u4").astype(np.int64)
        return ids[0], ids[1]

    def align(self, texts: list[str]) -> dict[str, list]:
        """Columns n_a, n_b, n_groups, n_links, groups, pairs, links; a row per text."""
        ids_a, ids_b = self.tokens(texts)
        a, b = (_spans(x, s) for x, s in zip((ids_a, ids_b), self.sizes))
        rows = len(texts)
        ends = group_ends(a, b) if len(a) else np.zeros(0, dtype=np.int64)
        ga, gb = (np.searchsorted(ends, x["stop"].to_numpy()) for x in (a, b))
        na, nb = (np.bincount(g, minlength=len(ends)) for g in (ga, gb))
        # order of writing: of each group its A tokens, then its B tokens
        out = np.empty(len(a) + len(b), dtype=object)
        at_a, at_b = np.arange(len(a)) + (np.cumsum(nb) - nb)[ga], np.arange(len(b)) + np.cumsum(na)[gb]
        o = self.offset
        for at, ids, g, off in ((at_a, a["id"], ga, (o[0], o[1])), (at_b, b["id"], gb, (o[2], o[3]))):
            last = np.r_[g[1:] != g[:-1], True] if len(g) else np.zeros(0, dtype=bool)
            out[at] = self.text[ids.to_numpy() + np.where(last, off[1], off[0])]
        n_a, n_b = ([len(x) for x in y] for y in (ids_a, ids_b))
        cut = np.cumsum([0, *(x + y for x, y in zip(n_a, n_b))])
        groups = ["".join(out[i:j])[:-1] for i, j in zip(cut, cut[1:])]
        doc_of = a["doc"].to_numpy()[np.cumsum(na) - na] if len(ends) else np.zeros(0, dtype=np.int64)
        doc, key, n = linked_pairs(a, b, ga, gb, na, nb, *map(len, self.sizes))
        at = np.searchsorted(doc, np.arange(rows + 1))
        return {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(doc_of, minlength=rows),
                "n_links": np.bincount(doc_of, weights=na * nb, minlength=rows).astype(np.int64), "groups": groups,
                "pairs": [key[i:j] for i, j in zip(at, at[1:])], "links": [n[i:j] for i, j in zip(at, at[1:])]}


_ALIGNERS: dict[str, Aligner] = {}


def align(docs: DataFrame, byte_level_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, groups, pairs, links; one row per input row.

    groups: the ids of each group, ``a1,a2|b1;a3|b2,b3``. pairs: distinct linked id pairs of the
    document (A id * size of B's vocabulary + B id); links: how often each is linked. Null and
    empty texts, and those whose token bytes are not space + text, have no tokens: zeros and empty
    values. Null ids and repeated rows stay; other columns are ignored. The two vocabulary files
    are read on the driver and broadcast (a fixed size).
    """
    files = [open(p, "rb").read() for p in (byte_level_path, piece_path)]  # noqa: SIM115
    payload = docs.sparkSession.sparkContext.broadcast(files)
    name = json.dumps([byte_level_path, piece_path])
    d = docs.select(F.col(id_col).alias("id"), no_null(text_col).alias("t"))
    kinds = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups": pa.string(),
             "pairs": pa.list_(pa.int64()), "links": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ALIGNERS:
            _ALIGNERS[name] = Aligner(ByteLevelSide(payload.value[0]), PieceSide(payload.value[1]))
        for b in batches:
            texts = b.column(1).to_pylist()
            size = np.cumsum([len(t) for t in texts])
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + BATCH_CHARS, side="right")))
                got = _ALIGNERS[name].align(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(got[k], t) for k, t in kinds.items())],
                                                 names=["id", *kinds])
                lo = hi

    out = map_arrow(d, run, f"id {d.schema['id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, "
                            "groups string, pairs array<long>, links array<long>")
    return out.withColumnRenamed("id", id_col)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """From a table with pairs: pair, count (documents that hold it linked), best (no pair of its A id has a higher count)."""
    counts = written(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count")))
    a = F.floor(F.col("pair") / F.lit(size_b)).cast("long")
    top = counts.groupBy(a.alias("a")).agg(F.max("count").alias("top"))
    return (counts.withColumn("a", a).join(top, "a")
            .select("pair", "count", (F.col("count") == F.col("top")).alias("best")))


def with_pair_counts(aligned: DataFrame, size_b: int, broadcast_max_pairs: int = BROADCAST_MAX_PAIRS) -> DataFrame:
    """aligned (computed once and stored) + n_best (links whose pair is a best one of its A id) and
    count_sum (the pairs' counts over all links), without pairs and links."""
    rows = written(aligned.withColumn("row", F.monotonically_increasing_id()))
    counts = written(pair_counts(rows, size_b))
    if counts.count() <= broadcast_max_pairs:
        counts = F.broadcast(counts)
    each = rows.select("row", F.inline(F.arrays_zip("pairs", "links"))).withColumnRenamed("pairs", "pair")
    sums = each.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("count")).alias("count_sum"))
    return (rows.drop("pairs", "links").join(sums, "row", "left").drop("row")
            .withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")}))


def piece_count(piece_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()
