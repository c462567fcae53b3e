"""Near-dedup by ProbMinHash over weighted five-word shingles.

A shingle of weight w (its count in the text) is a Poisson process of rate w
whose arrivals fall on random registers; each register keeps the shingle that
arrives first. Arrivals of a shingle come in increasing time, so it stops as
soon as its next one is later than every register holds. Two texts agree on a
register with the probability Jaccard similarity of their shingle counts. A
text that repeats a shingle has a second set of registers, with every weight 1:
two texts agree on those with the plain Jaccard of their distinct shingles (for
a text that repeats none the two sets are one).

Bands of registers give buckets, the same for both sets. Texts that are equal word by word are one
node from the start. In a small bucket every two nodes are compared; in a
large one (a large group of near copies, or texts round a common passage)
each node first meets the bucket's pivot, the node with the most company over
all bands. The nodes that the pivot's component has not reached meet further
ones, drawn anew in each bucket and round, while that settles half of them or
more. What is left then meets the whole bucket: blocks of nodes are compared
by matrix products over their common shingles, which give every pair's plain
Jaccard and an upper bound of its probability Jaccard. So two nodes of a
bucket end in one class, or have been compared. Every link is verified on the
whole texts: it is an exact similarity of 0.8 or more, by the probability
Jaccard of the shingle counts or by the Jaccard of the distinct shingles (the
two differ only where a text repeats itself).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minpair.llm.arrow import map_arrow
from minpair.llm.common import no_null, words, written
from minpair.operators.scorer import ship_package

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5  # a pair at 0.8 by either measure shares no band with probability 5e-5
#: Largest number of candidate ids (8 bytes each) sent to the scan of the texts;
#: beyond it the scan and the ids meet in a shuffle.
BROADCAST_MAX_IDS = 2_000_000
#: Nodes of a bucket up to which every two are compared.
SMALL_BUCKET = 8

#: Nodes and words of a block; two blocks are held by one task at a time.
BLOCK_NODES, BLOCK_WORDS = 512, 400_000
#: Shingles of one matrix product of two blocks.
SLICE = 4096

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64 constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_counts(flat: np.ndarray, starts: np.ndarray, width: int = WIDTH):
    """Distinct shingles of many texts: (text index, shingle hash, count), by text.

    ``flat`` holds the word hashes of all texts, ``starts`` their n + 1
    offsets. A text of fewer than ``width`` words is one shingle; an empty one
    has none.
    """
    n = len(starts) - 1
    flat = flat.astype(_U, copy=False)
    size = np.diff(starts)
    doc = np.repeat(np.arange(n), size)
    place = np.arange(len(flat)) - np.repeat(starts[:-1], size)
    length = np.minimum(size, width)  # words of the text's shingles
    first = place <= np.repeat(size - length, size)
    at, d = np.flatnonzero(first), doc[first]
    h = np.zeros(len(at), dtype=_U)
    for k in range(width):
        inside = k < length[d]
        w = flat[np.minimum(at + k, max(len(flat) - 1, 0))] if len(flat) else h
        h = np.where(inside, _mix(h * _U(0x9E3779B97F4A7C15) + w + _U(k + 1)), h)
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return d[at], h[at], np.diff(np.append(at, len(h)))


def signatures(d: np.ndarray, h: np.ndarray, w: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m registers: the shingle of the first arrival (0 where a text has none)."""
    time = np.full(n * m, np.inf)
    owner = np.zeros(n * m, dtype=_U)
    when = np.zeros(len(h))
    step = 0
    while len(h):
        step += 1
        r = _mix(h + _U((step * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        when = when - np.log1p(-(r >> _U(11)).astype(float) * 2.0**-53) / w
        if step > 1:
            go = when < latest[d]
            d, h, w, when, r = d[go], h[go], w[go], when[go], r[go]
            if not len(h):
                break
        slot = d * m + (_mix(r) % _U(m)).astype(np.int64)
        np.minimum.at(time, slot, when)
        won = time[slot] == when
        owner[slot[won]] = h[won]
        # no later arrival of a shingle can count once all registers are earlier
        latest = np.full(n, np.inf)
        live = np.unique(d)
        latest[live] = time.reshape(n, m)[live].max(axis=1)
        go = when < latest[d]
        d, h, w, when = d[go], h[go], w[go], when[go]
    return owner.reshape(n, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n x bands bucket keys."""
    out = np.zeros((len(sig), bands), dtype=_U)
    for b in range(bands):
        k = np.full(len(sig), b + 1, dtype=_U)
        for r in range(rows):
            k = _mix(k * _U(0x9E3779B97F4A7C15) + sig[:, b * rows + r])
        out[:, b] = k
    return out


def probability_jaccard(ha, wa, hb, wb) -> float:
    """Exact similarity of two weighted sets given as sorted hashes and weights."""
    common, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = wa[ia].astype(float), wb[ib].astype(float)
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    r = y / x
    # sum over j of max(x_j / x_i, y_j / y_i): x wins where r_j <= r_i
    upto = np.searchsorted(r, r, side="right")
    cx, cy = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(y)])
    total = (cx[upto] + only_a) / x + (cy[-1] - cy[upto] + only_b) / y
    return float((1.0 / total).sum())


def plain_jaccard(ha, hb) -> float:
    """Exact Jaccard similarity of two sets given as distinct hashes."""
    both = len(np.intersect1d(ha, hb, assume_unique=True))
    return both / (len(ha) + len(hb) - both) if both else 0.0


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list<int64> column without nulls."""
    off = col.offsets.to_numpy().astype(np.int64)
    return col.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]].view(_U), off - off[0]


def _word_hashes(text):
    return F.transform(words(text), lambda x: F.xxhash64(x))


def _fingerprint(text):
    """Equal for texts of equal words."""
    return F.md5(F.array_join(words(text), " ").cast("binary"))


def band_table(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, width: int) -> DataFrame:
    """(id, fp, size, keys): fingerprint, number of words and bucket keys of every row; no
    keys without words."""
    d = docs.select(F.col(id_col).alias("id"), words(no_null(text_col)).alias("w"))
    d = d.select("id", F.md5(F.array_join("w", " ").cast("binary")).alias("fp"),
                 F.transform("w", lambda x: F.xxhash64(x)).alias("wh"))
    id_type = d.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, starts = _lists(b.column(2))
            n = b.num_rows
            x, h, w = shingle_counts(flat, starts, width)
            keys = band_keys(signatures(x, h, w, n, bands * rows), bands, rows).view(np.int64)
            some = np.diff(starts) > 0
            # the texts that repeat a shingle once more, by their distinct shingles
            again = np.unique(x[w > 1])
            mine = np.isin(x, again)
            flat_keys = np.zeros_like(keys)
            flat_keys[again] = band_keys(signatures(np.searchsorted(again, x[mine]), h[mine], np.ones(mine.sum()), len(again),
                                                    bands * rows), bands, rows).view(np.int64)
            use = np.repeat(np.stack([some, np.isin(np.arange(n), again)], axis=1), bands, axis=1)
            keys = np.concatenate([keys, flat_keys], axis=1)
            offsets = np.concatenate([[0], np.cumsum(use.sum(axis=1))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.diff(starts)),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[use]))],
                names=["id", "fp", "size", "keys"])

    return map_arrow(d, run, f"id {id_type}, fp string, size bigint, keys array<bigint>")


def _texts(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t) of the rows whose id is among the distinct ``ids``."""
    ids = written(ids)
    if ids.limit(BROADCAST_MAX_IDS + 1).count() <= BROADCAST_MAX_IDS:
        ids = F.broadcast(ids)
    return written(docs.select(F.col(id_col).alias("id"), no_null(text_col).alias("t")).join(ids, "id", "left_semi"))


def verify(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, similarity: float,
           width: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole texts have that similarity or more by either
    measure, with the larger (s)."""
    texts = _texts(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), docs, id_col, text_col)
    one = texts.select(F.col("id").alias("a"), F.col("t").alias("ta"))
    two = texts.select(F.col("id").alias("b"), F.col("t").alias("tb"))
    both = pairs.join(one, "a").join(two, "b").select(
        "a", "b", _word_hashes(F.col("ta")).alias("wa"), _word_hashes(F.col("tb")).alias("wb"))
    id_type = both.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = (shingle_counts(*_lists(b.column(i)), width) for i in (2, 3))
            n = b.num_rows
            la, lb = (np.searchsorted(x[0], np.arange(n + 1)) for x in (left, right))
            s = np.zeros(n)
            for i in range(n):
                x, y = slice(la[i], la[i + 1]), slice(lb[i], lb[i + 1])
                s[i] = max(probability_jaccard(left[1][x], left[2][x], right[1][y], right[2][y]),
                           plain_jaccard(left[1][x], right[1][y]))
            ok = pa.array(s >= similarity - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)],
                                             names=["a", "b", "s"]).filter(ok)

    return map_arrow(both, run, f"a {id_type}, b {id_type}, s double")


def block_links(ids: list, label: np.ndarray, first: np.ndarray, second: np.ndarray, flat: np.ndarray,
                starts: np.ndarray, similarity: float, width: int) -> list[tuple]:
    """Links between the texts ``first`` and the texts ``second`` (indices), enough to
    join all classes (``label``) that a pair of ``similarity`` or more joins."""
    n = len(ids)
    d, h, w = shingle_counts(flat, starts, width)
    at = np.searchsorted(d, np.arange(n + 1))
    distinct, total = np.diff(at).astype(float), np.bincount(d, weights=w, minlength=n)
    _, col, times = np.unique(h, return_inverse=True, return_counts=True)
    shared = times[col] > 1
    place = np.cumsum(times > 1) - 1
    sd, sw, sc = d[shared], w[shared], place[col[shared]]
    order = np.argsort(sc, kind="stable")
    sd, sw, sc = sd[order], sw[order], sc[order]
    repeats = bool((sw > 1).any())
    # distinct shingles in common, and their counts in the first and in the second text
    both = np.zeros((len(first), len(second)))
    mine, theirs = (np.zeros_like(both), np.zeros_like(both)) if repeats else (both, both)
    for lo in range(0, int(sc[-1]) + 1 if len(sc) else 0, SLICE):
        x = slice(*np.searchsorted(sc, [lo, lo + SLICE]))
        has = np.zeros((n, SLICE), dtype=np.float32)
        has[sd[x], sc[x] - lo] = 1
        both += has[first] @ has[second].T
        if repeats:
            count = np.zeros((n, SLICE), dtype=np.float32)
            count[sd[x], sc[x] - lo] = sw[x]
            mine += count[first] @ has[second].T
            theirs += has[first] @ count[second].T
    plain = both / (distinct[first][:, None] + distinct[second][None, :] - both)
    # each term of the probability Jaccard is at most max(x_i, y_i) / sum of max(x_j, y_j)
    bound = (mine + theirs - both) / (total[first][:, None] + total[second][None, :] - both)
    least = similarity - 1e-9
    ok = (np.maximum(plain, bound) >= least) & (label[first][:, None] != label[second][None, :])
    parent = {int(x): int(x) for x in np.unique(label)}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in np.argwhere(ok):
        a, b = first[i], second[j]
        p, q = root(int(label[a])), root(int(label[b]))
        if p == q:
            continue
        x, y = slice(at[a], at[a + 1]), slice(at[b], at[b + 1])
        if plain[i, j] >= least or probability_jaccard(h[x], w[x], h[y], w[y]) >= least:
            parent[p] = q
            out.append((min(ids[a], ids[b]), max(ids[a], ids[b])))
    return out


def bucket_links(members: DataFrame, docs: DataFrame, id_col: str, text_col: str, similarity: float,
                 width: int) -> DataFrame:
    """(a, b): links of all the members (key, id, size, label, reached) of the buckets.

    A bucket's members are dealt to blocks, the unreached (``label`` is not
    ``reached``) and the others apart; the others are of one class, so each
    block of the unreached meets every block but needs no others to meet. One
    task holds two blocks.
    """
    m = members.withColumn("far", F.col("label") != F.col("reached"))
    near, far = F.when(~F.col("far"), F.col("size")), F.when(F.col("far"), F.col("size"))
    blocks = lambda c: F.ceil(F.greatest(
        F.count(c) / F.lit(BLOCK_NODES), F.coalesce(F.sum(c), F.lit(0)) / F.lit(BLOCK_WORDS))).cast("int")
    deal = written(m.groupBy("key").agg(blocks(far).alias("nf"), blocks(near).alias("nn"), blocks(F.col("size")).alias("n_all"))
                   .filter("nf > 0"))
    m = m.join(deal, "key").withColumn(
        "mine", F.pmod(F.xxhash64("id"), F.when(F.col("far"), F.col("nf")).otherwise(F.col("nn"))).cast("int"))
    # (i, j, side): row block i of the unreached and column block j, the others' after the unreached
    task = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rows = F.transform(F.filter(upto(F.col("nf") + F.col("nn")), lambda j: j >= F.col("mine")),
                       lambda j: task(F.col("mine"), j, 0))
    cols = F.transform(F.filter(upto(F.col("nf")), lambda i: i < F.col("mine")), lambda i: task(i, F.col("mine"), 1))
    others = F.transform(upto(F.col("nf")), lambda i: task(i, F.col("nf") + F.col("mine"), 1))
    alone = F.array(F.when(F.col("far"), task(F.lit(0), F.lit(0), 0)).otherwise(task(F.lit(0), F.lit(0), 1)))
    m = m.select("key", "id", "label", F.explode(
        F.when(F.col("n_all") <= 1, alone).when(F.col("far"), F.concat(rows, cols)).otherwise(others)).alias("x"))
    m = written(m.select("key", F.col("x.i").alias("i"), F.col("x.j").alias("j"), F.col("x.side").alias("side"), "id",
                         F.xxhash64("label").alias("label")))
    texts = _texts(m.select("id").distinct(), docs, id_col, text_col)
    texts = texts.dropDuplicates(["id", "t"]).select("id", _word_hashes(F.col("t")).alias("wh"))
    id_type = m.schema["id"].dataType.simpleString()

    def run(key, t):
        t = t.combine_chunks()
        side, label = t["side"].to_numpy(), t["label"].to_numpy()
        flat, starts = _lists(pa.concat_arrays(t["wh"].chunks))
        first = np.flatnonzero(side == 0)
        second = np.arange(len(side)) if key[1].as_py() == key[2].as_py() else np.flatnonzero(side)
        found = block_links(t["id"].to_pylist(), label, first, second, flat, starts, similarity, width)
        return pa.table({c: pa.array([x[k] for x in found], t["id"].type) for k, c in enumerate("ab")})

    ship_package(docs.sparkSession)
    return m.join(texts, "id").groupBy("key", "i", "j").applyInArrow(run, f"a {id_type}, b {id_type}")


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id linked, through any number of edges (a, b).

    Minimum labels over neighbours with pointer jumping; each round is a
    written table. A node with very many edges is the hot side of a join of
    two written tables (AQE splits it) or of an aggregate that combines
    map-side.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        near = (both.join(labels, both["b"] == labels["id"]).groupBy(F.col("a").alias("id"))
                .agg(F.min("label").alias("near")))
        moved = written(labels.join(near, "id").select("id", F.col("label").alias("old"),
                                                       F.least("label", "near").alias("label")))
        jump = moved.select(F.col("id").alias("at"), F.col("label").alias("root"))
        nxt = written(moved.join(jump, F.col("label") == F.col("at")).select("id", "old", F.least("root", "label").alias("label")))
        labels = nxt.select("id", "label")
        if nxt.filter("old != label").isEmpty():
            return labels


def _pivots(members: DataFrame, turn: int = 0) -> DataFrame:
    """(key, pivot): the node of most company in each bucket of (key, id, score); at
    later turns company is weighed by chance, each bucket and turn on its own."""
    worth = F.col("score").cast("double")
    if turn:
        worth = worth * (F.pmod(F.xxhash64("id", "key", F.lit(turn)), F.lit(1000)) + 1)
    return (members.groupBy("key").agg(F.max(F.struct(worth.alias("w"), F.col("id"))).alias("m"))
            .select("key", F.col("m.id").alias("pivot")))


def _ordered(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).filter("a < b").distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
               width: int = WIDTH, bands: int = BANDS, rows: int = ROWS,
               small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """One row per input row: id, copy_of (smallest id of the rows of equal words),
    group_id (smallest id of the class) and kept (the id is its class's).

    Classes are the connected components of the links. A text without words
    has no shingles and stands alone; so does a null id. Rows that share an
    id are one document. A text of fewer than ``width`` words is one shingle.
    Other columns are ignored.
    """
    table = written(band_table(docs, id_col, text_col, bands, rows, width))
    nodes = written(table.filter(F.col("id").isNotNull() & (F.size("keys") > 0)).groupBy("fp", "keys")
                    .agg(F.min("id").alias("node"), F.max("size").alias("size")))
    # rows of one id with several texts link them, each to the smallest
    held = (table.filter(F.col("id").isNotNull() & (F.size("keys") > 0)).select("id", "fp")
            .join(nodes.select("fp", "node"), "fp").select("id", "node"))
    least = held.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("id", "a")
    links = written(held.join(written(least), "id").filter("node != a").select("a", F.col("node").alias("b")).distinct())
    members = nodes.select(F.col("node").alias("id"), "size", F.explode(F.array_distinct("keys")).alias("key"))
    busy = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = written(members.join(written(busy), "key"))
    company = members.groupBy("id").agg(F.sum("n").alias("score"))
    members = written(members.join(written(company), "id"))
    small = members.filter(F.col("n") <= small_bucket).select("key", "id")
    large = members.filter(F.col("n") > small_bucket).select("key", "id", "score", "size")
    pivots = written(_pivots(large))
    met = _ordered(large.join(pivots, "key"), "id", "pivot")
    every = _ordered(small.alias("x").join(small.alias("y"), F.col("x.key") == F.col("y.key"))
                     .filter(F.col("x.id") < F.col("y.id")).select(F.col("x.id").alias("u"), F.col("y.id").alias("v")), "u", "v")
    asked = written(met.union(every).distinct())
    edges = written(verify(asked, docs, id_col, text_col, similarity, width).select("a", "b").distinct().union(links))
    labels = components(edges)
    left, turn, before = large, 0, None
    while True:
        # members that their bucket's pivot has not reached meet two more of the
        # bucket: one of all its members and one of those not reached
        turn += 1
        at = pivots.join(labels, F.col("pivot") == F.col("id"), "left").select(
            "key", F.coalesce("label", "pivot").alias("reached"))
        # classes only grow, so what one round has reached needs no second look
        named = left.select("key", "id", "score").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        left = written(named.join(at, "key").filter("label != reached").select("key", "id", "score", "label"))
        n = left.count()
        if not n or before is not None and n > before / 2:
            break
        before = n
        drawn = large.join(left.select("key").distinct(), "key")
        met = (left.join(_pivots(drawn, turn), "key").select("id", "pivot")
               .union(left.join(_pivots(left, turn), "key").select("id", "pivot")))
        new = written(_ordered(met, "id", "pivot").join(asked, ["a", "b"], "left_anti"))
        found = written(verify(new, docs, id_col, text_col, similarity, width).select("a", "b").distinct())
        asked = written(asked.union(new))
        if not found.isEmpty():
            edges = written(edges.union(found))
            labels = components(edges)
    if n:
        # what is left meets the whole of its buckets
        rest = (large.join(left.select("key").distinct(), "key").join(labels, "id", "left")
                .withColumn("label", F.coalesce("label", "id")).join(at, "key"))
        # an id with several texts is one member
        rest = written(rest.groupBy("key", "id", "label", "reached").agg(F.sum("size").alias("size")))
        found = written(bucket_links(rest, docs, id_col, text_col, similarity, width).distinct())
        if not found.isEmpty():
            labels = components(written(edges.union(found)))
    home = written(nodes.select("fp", "node").join(labels.withColumnRenamed("id", "node"), "node", "left")
                   .select("fp", "node", F.coalesce("label", "node").alias("label")))
    out = table.select("id", "fp").join(home, "fp", "left")
    alone = F.col("id").isNull() | F.col("node").isNull()
    group = F.when(alone, F.col("id")).otherwise(F.col("label"))
    return out.select(F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("node")).alias("copy_of"),
                      group.alias("group_id"), F.col("id").eqNullSafe(group).alias("kept"))
