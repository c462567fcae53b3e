"""Spelling variant grouping: k-d trees over letter-count vectors.

Two words are near if one inserted, deleted or replaced code point turns one
into the other. One edit moves the letter counts by an L1 distance of at most
two: a replacement takes one letter away and adds one, an insertion adds one.
So the near words of a word are searched in a k-d tree over letter counts, by
boxes pruned at that distance, once per pair of lengths (equal, or one apart);
the order of the letters is then compared exactly.

Letter counts are kept in unary: bit (letter, c) says that the word has the
letter at least c times. A split of the tree is one such bit (count below or
at least c), the box of a node is the AND and the OR of its points' bits, and
a distance is a count of bits. Frequent letters have ``LEVELS`` bits; counts
beyond that are not told apart by the tree, only by the final comparison.

The vocabulary of a length is dealt into shards by the top of such a tree,
split on a bounded sample; every word has one home shard, and the shards' boxes
(from all their words) say which shards a word must be looked up in.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minpair.llm.arrow import gathered, map_arrow
from minpair.llm.common import no_null, written
from minpair.operators.scorer import ship_package

#: Runs of letters (fixed by the query contract).
LETTERS = r"[A-Za-zÀ-ÿ]+"
MIN_CHARS, MIN_COUNT, DELETE_EVERY = 5, 3, 97
#: Words that a task holds before it passes on their counts.
HELD_WORDS = 200_000
#: Bits of a plain letter, and of a letter of the Latin-1 half.
LEVELS, OTHER_LEVELS = 4, 1
#: Words of one shard, and letters of one (shards of long words hold fewer words).
SHARD_WORDS, SHARD_LETTERS = 8192, 1 << 22
#: The sample that places the shards: words of a shard, and shards of all lengths together.
SAMPLE_WORDS, MAX_SHARDS = 64, 4096
LEAF = 32
#: Words looked up together.
BATCH_WORDS = 16384
#: Cells of one comparison.
BLOCK_CELLS = 1 << 22

WORDS = 3  # 64-bit words of a bit vector


def _bit_table() -> np.ndarray:
    """First bit and number of bits of every code point below 256."""
    table, at = np.zeros((256, 2), dtype=np.int64), 0
    for c in (*range(97, 123), *range(0xC0, 0x100)):
        n = LEVELS if c < 128 else OTHER_LEVELS
        table[c] = at, n
        at += n
    if at > 64 * WORDS:
        raise ValueError("too many letter levels")
    return table


_BITS = _bit_table()


def letter_matrix(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row each (all are below 256)."""
    return np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), length)


def letter_bits(matrix: np.ndarray) -> np.ndarray:
    """Unary letter counts, a row of ``WORDS`` unsigned 64-bit integers per word."""
    out = np.zeros((len(matrix), WORDS), dtype=np.uint64)
    for c in np.flatnonzero(np.bincount(matrix.ravel(), minlength=256)):
        at, levels = _BITS[c]
        counts = (matrix == c).sum(axis=1)
        for k in range(levels):
            bit = at + k
            out[counts > k, bit >> 6] |= np.uint64(1 << (bit & 63))
    return out


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1, dtype=np.int16)


class KdTree:
    """Points in leaf order; nodes as arrays. ``order`` gives the points' rows in that order."""

    def __init__(self, bits: np.ndarray, leaf: int = LEAF):
        self.left, self.right, self.split, self.lo, self.hi, self.span = [], [], [], [], [], []
        self.order = np.arange(len(bits))
        if len(bits):
            self._build(bits, leaf)
        self.bits = bits[self.order]

    def _build(self, bits, leaf):
        stack = [(0, len(bits), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            node, idx = len(self.split), self.order[a:b]
            if parent >= 0:
                (self.left, self.right)[side][parent] = node
            x = bits[idx]
            lo, hi = np.bitwise_and.reduce(x, axis=0), np.bitwise_or.reduce(x, axis=0)
            for at, v in ((self.left, -1), (self.right, -1), (self.split, -1), (self.lo, lo), (self.hi, hi), (self.span, (a, b))):
                at.append(v)
            if b - a <= leaf or (lo == hi).all():
                continue
            # the count threshold that halves the points best
            set_ = np.unpackbits(x.view(np.uint8).reshape(b - a, 8 * WORDS), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            bit = int(np.abs(2 * set_ - (b - a)).argmin())
            self.split[node] = bit
            has = (x[:, bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1) == 1
            m = a + int((~has).sum())
            self.order[a:b] = np.concatenate((idx[~has], idx[has]))
            stack += [(m, b, node, 1), (a, m, node, 0)]

    def home(self, q: np.ndarray) -> np.ndarray:
        """The leaf that the splits lead each row of ``q`` to, as the number of the leaf."""
        out, stack = np.zeros(len(q), dtype=np.int64), [(0, np.arange(len(q)))]
        number = {n: i for i, n in enumerate(self.leaves())}
        while stack:
            node, idx = stack.pop()
            if not len(idx):
                continue
            bit = self.split[node]
            if bit < 0:
                out[idx] = number[node]
                continue
            has = (q[idx, bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1) == 1
            stack += [(self.left[node], idx[~has]), (self.right[node], idx[has])]
        return out

    def leaves(self) -> list[int]:
        return sorted((n for n, s in enumerate(self.split) if s < 0), key=lambda n: self.span[n])

    def set_boxes(self, boxes: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Give the leaves (by number) the boxes of all their words, and the inner nodes theirs."""
        none = np.full(WORDS, ~np.uint64(0)), np.zeros(WORDS, dtype=np.uint64)
        for i, n in enumerate(self.leaves()):
            self.lo[n], self.hi[n] = boxes.get(i, none)
        for n in range(len(self.split) - 1, -1, -1):  # children come after their parent
            if self.split[n] >= 0:
                a, b = self.left[n], self.right[n]
                self.lo[n], self.hi[n] = self.lo[a] & self.lo[b], self.hi[a] | self.hi[b]

    def search(self, q: np.ndarray, less: int, more: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf node, rows of q) where the leaf's box holds a vector that lacks at most
        ``less`` of the row's letters and has at most ``more`` others."""
        stack = [(0, np.arange(len(q)))] if len(q) and self.split else []
        while stack:
            node, idx = stack.pop()
            x = q[idx]
            near = (_ones(x & ~self.hi[node]) <= less) & (_ones(self.lo[node] & ~x) <= more)
            idx = idx[near]
            if not len(idx):
                continue
            if self.split[node] < 0:
                yield node, idx
            else:
                stack += [(self.right[node], idx), (self.left[node], idx)]


def _one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def _one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """b (one longer) is a with one letter put in."""
    head = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= a.shape[1]


def near_pairs(points: np.ndarray, queries: np.ndarray, replaced: bool, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(rows of queries, rows of points) one edit apart: a replaced letter, or one
    letter more in the points. ``own``: queries are the points, each pair once."""
    tree = KdTree(letter_bits(points))
    q = tree.bits if own else letter_bits(queries)
    qm, pm = (points[tree.order] if own else queries), points[tree.order]
    less, more, same = (1, 1, _one_replaced) if replaced else (0, 1, _one_inserted)
    found_q, found_p = [], []
    for node, idx in tree.search(q, less, more):
        a, b = tree.span[node]
        if own:
            idx = idx[idx < b]  # the later one of a pair is found from the earlier one
        for pa_ in range(a, b, 256):
            pts = np.arange(pa_, min(b, pa_ + 256))
            step = max(1, BLOCK_CELLS // (8 * WORDS * len(pts)))
            for i in range(0, len(idx), step):
                rows = idx[i:i + step]
                x, y = q[rows][:, None, :], tree.bits[pts][None, :, :]
                hit = (_ones(x & ~y) <= less) & (_ones(y & ~x) <= more)
                r, p = np.nonzero(hit)
                r, p = rows[r], pts[p]
                if own:
                    r, p = r[r < p], p[r < p]
                block = max(1, BLOCK_CELLS // max(1, pm.shape[1]))
                for j in range(0, len(r), block):
                    rr, pp = r[j:j + block], p[j:j + block]
                    ok = same(qm[rr], pm[pp])
                    found_q.append(rr[ok])
                    found_p.append(pp[ok])
    if not found_q:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    r, p = np.concatenate(found_q), np.concatenate(found_p)
    return (tree.order[r] if own else r), tree.order[p]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                min_count: int = MIN_COUNT, delete_every: int = DELETE_EVERY) -> DataFrame:
    """word, n: the runs of letters of all texts, A-Z lower-cased, with the code point
    ``h % length`` deleted where h, the crc32 of ``<id>:<run>``, is a multiple of
    ``delete_every``; words of fewer code points or occurrences are left out.

    Counts leave a task pre-aggregated, whenever it holds ``HELD_WORDS`` of them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(f"{LETTERS[:-1]}{{{min_chars},}}").findall
        held: dict[str, int] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            for i, text in zip(b.column(0), b.column(1)):
                head = crc32(f"{i.as_py()}:".encode())
                # the bytes' lower() moves A-Z alone
                for w, c in Counter(find(text.as_py().encode().lower().decode())).items():
                    h = crc32(w.encode(), head)
                    if h % delete_every == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1:]
                        if len(w) < min_chars:
                            continue
                    held[w] = held.get(w, 0) + c
                if len(held) >= HELD_WORDS:
                    yield flush()
        yield flush()

    rows = docs.select(no_null(id_col).alias("i"), no_null(text_col).alias("t"))
    return (map_arrow(rows, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= min_count))


def _top_trees(vocab: DataFrame) -> dict[int, KdTree]:
    """Length -> tree whose leaves are shards, for lengths of more than one shard."""
    sizes = {r.len: r["count"] for r in vocab.groupBy("len").count().collect()}
    shards = {k: -(-n // min(SHARD_WORDS, max(64, SHARD_LETTERS // k))) for k, n in sizes.items()}
    shards = {k: s for k, s in shards.items() if s > 1}
    fit = min(1.0, MAX_SHARDS / max(1, sum(shards.values())))
    want = {k: max(2, int(s * fit)) * SAMPLE_WORDS for k, s in shards.items()}
    if not want:
        return {}
    cut = F.create_map(*[F.lit(x) for k, n in want.items() for x in (k, int(min(1.0, n / sizes[k]) * 1_000_000))])
    rows = vocab.filter(F.pmod(F.xxhash64("word"), F.lit(1_000_000)) < cut[F.col("len")]).select("len", "word").orderBy("word").collect()
    by: dict[int, list[str]] = {}
    for r in rows:
        by.setdefault(r.len, []).append(r.word)
    return {k: KdTree(letter_bits(letter_matrix(w, k)), SAMPLE_WORDS) for k, w in by.items()}


def _columns(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, list[str], np.ndarray]]:
    """Rows of a batch by word length: length, rows, words, their bits."""
    lens, words = np.asarray(b.column("len")), b.column("word").to_pylist()
    for k in np.unique(lens):
        rows = np.flatnonzero(lens == k)
        w = [words[i] for i in rows]
        yield int(k), rows, w, letter_bits(letter_matrix(w, int(k)))


def _shards(vocab: DataFrame, trees) -> DataFrame:
    """vocab + shard (home shard of its length's tree) and the three words of its bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, BATCH_WORDS):
            home, bits = np.zeros(b.num_rows, dtype=np.int32), np.zeros((b.num_rows, WORDS), dtype=np.uint64)
            for k, rows, _, x in _columns(b):
                bits[rows] = x
                if (tree := trees.value.get(k)) is not None:
                    home[rows] = tree.home(x)
            yield pa.RecordBatch.from_arrays(
                [b.column("len"), b.column("word"), b.column("n"), pa.array(home), *[pa.array(bits[:, i].view(np.int64)) for i in range(WORDS)]],
                names=["len", "word", "n", "shard", *[f"b{i}" for i in range(WORDS)]])

    return map_arrow(vocab, run, "len int, word string, n long, shard int, " + ", ".join(f"b{i} long" for i in range(WORDS)))


#: Roles of a row in a shard: a word at home, a word of equal length from an earlier shard, a word one shorter.
POINT, EQUAL, SHORTER = 0, 1, 2


def _routed(homes: DataFrame, trees) -> DataFrame:
    """len, shard, role, word, n: every word at home and in each shard it must be looked up in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, BATCH_WORDS):
            shard, n = np.asarray(b.column("shard")), np.asarray(b.column("n"))
            for k, rows, words, x in _columns(b):
                parts = [(np.full(len(rows), k), shard[rows], np.full(len(rows), POINT), np.arange(len(rows)))]
                for length, role, reach in ((k, EQUAL, (1, 1)), (k + 1, SHORTER, (0, 1))):
                    tree = trees.value.get(length)
                    if tree is None:  # one shard; words of equal length are at home there already
                        if role == SHORTER:
                            parts.append((np.full(len(rows), length), np.zeros(len(rows)), np.full(len(rows), role), np.arange(len(rows))))
                        continue
                    number = {node: i for i, node in enumerate(tree.leaves())}
                    for node, idx in tree.search(x, *reach):
                        if role == EQUAL:
                            idx = idx[shard[rows[idx]] < number[node]]
                        parts.append((np.full(len(idx), length), np.full(len(idx), number[node]), np.full(len(idx), role), idx))
                ln, sh, ro, ix = (np.concatenate(c) for c in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ln.astype(np.int32)), pa.array(sh.astype(np.int32)), pa.array(ro.astype(np.int8)),
                     pa.array(words).take(pa.array(ix)), pa.array(n[rows][ix])], names=["len", "shard", "role", "word", "n"])

    return map_arrow(homes.select("len", "word", "n", "shard"), run, "len int, shard int, role byte, word string, n long")


def _search(table: pa.Table) -> pa.Table:
    """Near pairs of one shard: a, a_n, b, b_n."""
    role, n = np.asarray(table.column("role")), np.asarray(table.column("n"))
    words = np.array(table.column("word").to_pylist(), dtype=object)
    home = np.flatnonzero(role == POINT)
    a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    if len(home):
        length = len(words[home[0]])
        points = letter_matrix(words[home].tolist(), length)
        for r, k in ((POINT, length), (EQUAL, length), (SHORTER, length - 1)):
            rows = np.flatnonzero(role == r)
            if len(rows):
                q, p = near_pairs(points, points if r == POINT else letter_matrix(words[rows].tolist(), k), r != SHORTER, r == POINT)
                a.append(rows[q])
                b.append(home[p])
    a, b = np.concatenate(a), np.concatenate(b)
    return pa.table({"a": pa.array(words[a].tolist(), pa.string()), "a_n": pa.array(n[a], pa.int64()),
                     "b": pa.array(words[b].tolist(), pa.string()), "b_n": pa.array(n[b], pa.int64())})


def near_words(vocab: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: every pair of near words once, from word, n (words of Latin-1 letters, each once)."""
    spark = vocab.sparkSession
    v = vocab.select(F.char_length("word").alias("len"), "word", F.col("n").cast("long").alias("n"))
    trees = _top_trees(v)
    tops = spark.sparkContext.broadcast(trees)
    homes = written(_shards(v, tops))
    if trees:
        box = [f(f"b{i}").alias(f"{name}{i}") for name, f in (("lo", F.bit_and), ("hi", F.bit_or)) for i in range(WORDS)]
        boxes: dict[int, dict] = {}
        for r in homes.filter(F.col("len").isin(list(trees))).groupBy("len", "shard").agg(*box).collect():
            lo, hi = (np.array([r[f"{s}{i}"] for i in range(WORDS)], dtype=np.int64).view(np.uint64) for s in ("lo", "hi"))
            boxes.setdefault(r.len, {})[r.shard] = (lo, hi)
        for k, tree in trees.items():
            tree.set_boxes(boxes.get(k, {}))
        tops = spark.sparkContext.broadcast(trees)
    ship_package(spark)
    return (_routed(homes, tops).groupBy("len", "shard")
            .applyInArrow(lambda t: _search(t), "a string, a_n long, b string, b_n long"))


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                    min_count: int = MIN_COUNT, delete_every: int = DELETE_EVERY, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n; one row per word.

    A word's form is its near word of largest n (ties: the smallest in code
    point order) if that n is at least ``ratio`` (2 or more) times the word's;
    root follows forms to the last one. Null and empty texts have no words, a
    null id counts as an empty one, every row counts (repeated rows too), and
    other columns are ignored. Without a word the result is empty.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")  # n then doubles along forms: no cycle, short chains
    vocab = written(count_words(docs, id_col, text_col, min_chars, min_count, delete_every))
    pairs = written(near_words(vocab))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    strong = -F.col("best.minus") >= ratio * F.col("n")
    words = written(vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.minus")).alias("form_n")))
    # forms of forms by doubling: a chain of k steps takes log2(k) rounds
    root = words.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        root = written(root)
        on = root.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if root.join(on, "root", "left_semi").isEmpty():
            break
        root = root.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return words.join(root, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
