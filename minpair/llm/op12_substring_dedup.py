"""Substring dedup by repeated-phrase automata.

A window is ``window`` consecutive words of one document. Each word covered by
a window whose words also start somewhere in a document of a smaller id is
removed; windows are judged on the input.

1. Find: every document gives the phrases (``phrase`` words) whose hash is
   least in some window. Equal windows choose equal phrases, so a window that
   two documents share has a phrase that two documents give.
2. Confirm: only the windows that chose a recurring phrase are hashed (96
   bits), and each one that recurs is owned by the smallest document that has
   it. Runs of windows that a document owns are its recurring passages.
3. Compile: passages are dealt into shards; the automaton (Aho-Corasick) of a
   shard holds phrases of ``key`` words such that any window of a passage holds a whole one,
   those that few passages of the shard have before the others.
4. Stream: every document that shares a chosen phrase with a smaller owner's
   passage passes through the automata of those shards. Each hit is
   extended word by word over the passage; a match of ``window`` words or more
   is removed. Shards many documents meet in are salted by document.

Documents of equal words form one class first: of a class, only the smallest
id is searched, the others are covered whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minpair.llm.arrow import map_arrow
from minpair.llm.common import no_null, written
from minpair.operators.scorer import ship_package

#: Words of a window (fixed by the query contract), of a chosen phrase, and of an automaton's phrase.
WINDOW, PHRASE, KEY = 50, 16, 8
#: Characters of the passages of one shard, and of the documents that one task streams through it.
SHARD_CHARS, TASK_CHARS = 2_000_000, 16_000_000
#: Window hashes of one batch.
HELD_WINDOWS = 100_000
#: Largest number of documents whose ids (8 bytes each) are sent to every task.
BROADCAST_MAX_IDS = 1_000_000

#: Odd bases of the polynomial hashes: of bytes, and two of words.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as many as were asked for."""

    def __init__(self, base: int):
        self.bases = base, pow(base, -1, 1 << 64)
        self.tables = [np.ones(1, dtype=np.uint64)] * 2

    def __call__(self, n: int) -> list[np.ndarray]:
        while len(self.tables[0]) < n:
            self.tables = [np.concatenate((t, t * np.uint64(pow(b, len(t), 1 << 64)))) for b, t in zip(self.bases, self.tables)]
        return [t[:n] for t in self.tables]


_POWERS = [_Powers(b) for b in _BASES]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slice_hashes(x: np.ndarray, start: np.ndarray, stop: np.ndarray, which: int) -> np.ndarray:
    """64-bit hashes of slices of x: a polynomial over the slice modulo 2^64, by prefix sums."""
    up, down = _POWERS[which](len(x))
    prefix = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(x * up, out=prefix[1:])
    return _mix((prefix[stop] - prefix[start]) * down[start] + (stop - start).astype(np.uint64))


def split_words(text: str | None) -> list[bytes]:
    """Runs of other characters than space and \\x09-\\x0D, as UTF-8 (what bytes.split() takes as space)."""
    return (text or "").encode().split()


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, in order."""
    x = np.frombuffer(raw, dtype=np.uint8)
    edge = np.flatnonzero(np.diff(np.r_[True, (x == 32) | ((x >= 9) & (x <= 13)), True]))
    if not len(edge):
        return np.zeros(0, dtype=np.uint64)
    return _slice_hashes(x.astype(np.uint64) + np.uint64(1), edge[::2], edge[1::2], 0)


def run_hashes(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of every run of ``k`` words, from the words' hashes."""
    start = np.arange(max(0, len(h) - k + 1))
    return _slice_hashes(h, start, start + k, 1 + which) if len(start) else np.zeros(0, dtype=np.uint64)


def chosen(h: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """For every window, the least hash of its phrases (read as signed integers)."""
    g, w = run_hashes(h, phrase).view(np.int64), window - phrase + 1
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    # minimum of a sliding window: of the rest of one block and the beginning of the next
    pad = np.full(-(-len(g) // w) * w, np.iinfo(np.int64).max)
    pad[:len(g)] = g
    blocks = pad.reshape(-1, w)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[w - 1:w - 1 + n])


def _runs(at: np.ndarray, gap: int = 1) -> list[tuple[int, int]]:
    """First and last of each run of ascending numbers at most ``gap`` apart."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > gap)
    return list(zip(at[np.r_[0, cut + 1]].tolist(), at[np.r_[cut, len(at) - 1]].tolist()))


def _cls(sha: bytes) -> int:
    """First 64 bits of a digest: the class of a text."""
    return int.from_bytes(sha[:8], "big", signed=True)


def _joined(words: list[bytes]) -> str:
    return b" ".join(words).decode()


def _summaries(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """id, n_words, sha (of the words joined by a space), cls, seeds (chosen phrases) of every row."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sha, seeds = [], [], []
            for t in b.column(1):
                raw = t.as_py().encode()
                words = raw.split()
                n.append(len(words))
                sha.append(sha256(b" ".join(words)).digest())
                seeds.append(np.unique(chosen(word_hashes(raw), window, phrase)) if len(words) >= window else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), pa.array(map(_cls, sha), pa.int64()),
                                              pa.array(seeds, pa.list_(pa.int64()))], names=["id", "n_words", "sha", "cls", "seeds"])

    return map_arrow(docs, run, f"id {id_type}, n_words long, sha binary, cls long, seeds array<long>")


def _packed(text: str) -> bytes:
    """A text as it travels between stages (zstd)."""
    import zstandard

    return zstandard.compress(text.encode(), 1)


def _unpacked(blob: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(blob)


def _texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (id, cls, ...) + packed text and chars of a row of that id and those words; each key once."""
    ids = keys.select("id").distinct()
    some = docs.join(F.broadcast(ids) if keys.count() <= BROADCAST_MAX_IDS else ids, "id", "left_semi")
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            cls = [_cls(sha256(b" ".join(split_words(t))).digest()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls, pa.int64()), pa.array(map(_packed, texts), pa.binary()),
                                              pa.array(map(len, texts), pa.int64())], names=["id", "cls", "packed", "chars"])

    rows = map_arrow(some.select("id", "text"), run, f"id {id_type}, cls long, packed binary, chars long")
    return keys.join(rows, ["id", "cls"]).dropDuplicates(["id", "cls"])


def _window_rows(cand: DataFrame, window: int, phrase: int) -> DataFrame:
    """id, sub, pos, h1, h2 of every window of ``cand`` whose chosen phrase recurs."""
    id_type = cand.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, n = [], 0
            for i in range(b.num_rows):
                h = word_hashes(_unpacked(b.column("packed")[i].as_py()))
                again = b.column("seeds")[i].values.to_numpy(zero_copy_only=False)
                pos = np.flatnonzero(np.isin(chosen(h, window, phrase), again))
                held.append((np.full(len(pos), i), pos, *(run_hashes(h, window, k)[pos].view(np.int64) for k in (0, 1))))
                n += len(pos)
                if n >= HELD_WINDOWS or i + 1 == b.num_rows:
                    row, pos, one, two = (np.concatenate(x) for x in zip(*held))
                    row = pa.array(row)
                    yield pa.RecordBatch.from_arrays([b.column("id").take(row), b.column("sub").take(row), pa.array(pos.astype(np.int32)),
                                                      pa.array(one), pa.array(two.astype(np.int32))], names=["id", "sub", "pos", "h1", "h2"])
                    held, n = [], 0

    return map_arrow(cand.select("id", "sub", "packed", "seeds"), run, f"id {id_type}, sub int, pos int, h1 long, h2 int")


def _passages(owned: DataFrame, window: int, phrase: int) -> DataFrame:
    """owner, sub, passage (its words joined by a space), seeds: the runs of windows that a document owns."""
    id_type = owned.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, texts, seeds = [], [], []
            for i in range(b.num_rows):
                raw = _unpacked(b.column("packed")[i].as_py())
                words, h = raw.split(), word_hashes(raw)
                for x, y in _runs(np.sort(b.column("starts")[i].values.to_numpy(zero_copy_only=False))):
                    rows.append(i)
                    texts.append(_joined(words[x:y + window]))
                    seeds.append(np.unique(chosen(h[x:y + window], window, phrase)))
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("sub").take(at), pa.array(texts, pa.string()),
                                              pa.array(seeds, pa.list_(pa.int64()))], names=["owner", "sub", "passage", "seeds"])

    return map_arrow(owned.select("id", "sub", "packed", "starts"), run, f"owner {id_type}, sub int, passage string, seeds array<long>")


def _flat(words: list[bytes]) -> str:
    """Words between spaces, a character per byte: as the automaton reads them."""
    return f" {b' '.join(words).decode('latin-1')} "


class PassageAutomaton:
    """Aho-Corasick automaton over phrases of passages; finds where a text repeats a passage."""

    def __init__(self, passages: list[tuple[object, str]], window: int = WINDOW, key: int = KEY):
        import ahocorasick

        self.window, self.passages, self.owners = window, [], []
        at: dict[str, list[tuple[int, int]]] = {}
        grams = [run_hashes(word_hashes(text.encode()), key) for _, text in passages]
        _, of, counts = np.unique(np.concatenate([*grams, np.zeros(0, dtype=np.uint64)]), return_inverse=True, return_counts=True)
        often, end = counts[of], np.cumsum([0, *map(len, grams)])
        for (owner, text), a, b in zip(passages, end, end[1:]):
            words = split_words(text)
            for k in self._places(often[a:b], len(words) - window, window - key + 1):
                at.setdefault(_flat(words[k:k + key]), []).append((len(self.passages), k))
            self.passages.append(words)
            self.owners.append(owner)
        self.find = ahocorasick.Automaton()
        for text, places in at.items():
            self.find.add_word(text, (len(text), places))
        if at:
            self.find.make_automaton()

    @staticmethod
    def _places(often: np.ndarray, last: int, n: int) -> Iterator[int]:
        """Phrases of a passage such that each of its windows (0 to last) holds one. ``often`` counts
        the phrase that begins at a word among all passages, ``n`` phrases lie in a window: rare
        ones are taken, so that passages which differ by a word are not all met at what they share."""
        s = 0
        while s <= last:
            own = often[s:s + n]
            s += int(np.flatnonzero(own <= 2 * own.min())[-1])
            yield s
            s += 1

    def repeats(self, doc_id, raw: bytes) -> list[tuple[int, int]]:
        """Word ranges (end exclusive) of at least ``window`` words that the text shares with a
        passage of a smaller owner; ranges can overlap."""
        words = raw.split()
        if len(words) < self.window or not len(self.find):
            return []
        flat = _flat(words)
        found, done, space = [], {}, None
        for end, (n, places) in self.find.iter(flat):
            if space is None:  # the space before each word
                space = np.flatnonzero(np.frombuffer(flat.encode("latin-1"), dtype=np.uint8) == 32)
            i = int(space.searchsorted(end - n + 1))
            for p, k in places:
                if not self.owners[p] < doc_id or done.get((p, i - k), -1) >= i:
                    continue
                a, b = self._extent(words, i, self.passages[p], k)
                done[p, i - k] = b
                if b - a >= self.window:
                    found.append((a, b))
        return found

    @staticmethod
    def _extent(x: list[bytes], i: int, y: list[bytes], j: int) -> tuple[int, int]:
        """The longest range of x around i that equals y around j."""
        a, c = i, j
        while a and c and x[a - 1] == y[c - 1]:
            a, c = a - 1, c - 1
        b, d = i, j
        while x[b:b + 64] == y[d:d + 64] and b < len(x) and d < len(y):
            step = min(64, len(x) - b, len(y) - d)
            b, d = b + step, d + step
        while b < len(x) and d < len(y) and x[b] == y[d]:
            b, d = b + 1, d + 1
        return a, b


def _merge(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


_SPANS = "array<struct<start:int,stop:int>>"
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _spans_array(spans: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "stop": b} for a, b in x] for x in spans], _SPANS_ARROW)


def _stream(routed: DataFrame, passages: DataFrame, window: int) -> DataFrame:
    """id, sub, spans: each routed document through the automaton of its shard (shard, salt: one task)."""
    ship_package(routed.sparkSession)
    id_type = routed.schema["id"].dataType.simpleString()

    def run(docs: pa.Table, parts: pa.Table) -> pa.Table:
        auto = PassageAutomaton(list(zip(parts.column("owner").to_pylist(), parts.column("passage").to_pylist())), window, min(KEY, window))
        spans = [_merge(auto.repeats(i.as_py(), _unpacked(t.as_py()))) for i, t in zip(docs.column("id"), docs.column("packed"))]
        return pa.table({"id": docs.column("id"), "sub": docs.column("sub"), "spans": _spans_array(spans)})

    left = routed.select("shard", "salt", "id", "sub", "packed").groupBy("shard", "salt")
    right = passages.select("shard", "salt", "owner", "passage").groupBy("shard", "salt")
    return left.cogroup(right).applyInArrow(lambda a, b: run(a, b), f"id {id_type}, sub int, spans {_SPANS}").filter(F.size("spans") > 0)


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE,
                  shard_chars: int = SHARD_CHARS, task_chars: int = TASK_CHARS) -> tuple[DataFrame, DataFrame]:
    """(rows, cut).

    rows: id, n_words, sha, cls, first; one per input row. ``sha`` is the SHA-256 of the words joined
    by a space, ``cls`` its first 64 bits, ``first`` the smallest id of those words (null below
    ``window`` words). A row whose id is larger than ``first`` is covered whole.
    cut: id, cls, spans (word ranges to remove, end exclusive) and the packed text, for those
    smallest rows of which a part is removed.

    Null texts have no words. A row with a null id neither owns windows nor loses words.
    Rows that repeat an id are one document: none is smaller than the other. Other columns are ignored.
    """
    if not 1 <= phrase <= window:
        raise ValueError("a phrase has 1 to window words")
    d = docs.select(F.col(id_col).alias("id"), no_null(text_col).alias("text"))
    rows = written(_summaries(d, window, phrase))
    long_rows = rows.filter(f"n_words >= {int(window)} and id is not null")
    reps = written(long_rows.groupBy("sha", "cls").agg(F.min("id").alias("id"), F.min_by("seeds", "id").alias("seeds")))
    # phrases that documents of different ids chose
    seeds = reps.select("id", "cls", F.explode("seeds").alias("seed"))
    again = seeds.groupBy("seed").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("seed")
    # sub numbers the different texts of an id (one, as a rule)
    sub = (F.row_number().over(Window.partitionBy("id").orderBy("cls")) - 1).alias("sub")
    keys = written(seeds.join(again, "seed").repartition("id").groupBy("id", "cls").agg(F.collect_list("seed").alias("seeds"))
                   .select("*", sub))
    cand = written(_texts_of(d, keys))
    # a recurring window belongs to the smallest document that has it, once
    wins = (_window_rows(cand, window, phrase).groupBy("h1", "h2")
            .agg(F.min(F.struct("id", "sub", "pos")).alias("own"), F.max("id").alias("hi")).filter("own.id < hi"))
    starts = written(wins.select("own.*").groupBy("id", "sub").agg(F.collect_list("pos").alias("starts")))
    # of the texts, only those of owners travel
    owners = starts.select("id").distinct()
    owned = cand.drop("seeds")
    if owners.count() <= BROADCAST_MAX_IDS:
        owned = owned.join(F.broadcast(owners), "id", "left_semi")
    passages = written(_passages(owned.join(starts, ["id", "sub"]), window, phrase))
    total = passages.agg(F.sum(F.length("passage"))).first()[0] or 0
    n_shards = max(1, -(-int(total) // shard_chars))
    passages = passages.withColumn("shard", F.pmod(F.xxhash64("owner", "sub"), F.lit(n_shards)).cast("int"))
    # a document goes to the shards where a smaller owner's passage chose one of its phrases
    where = passages.select("shard", "owner", F.explode("seeds").alias("seed")).groupBy("seed", "shard").agg(F.min("owner").alias("owner"))
    met = written(cand.select("id", "sub", "chars", F.explode("seeds").alias("seed")).join(where, "seed").filter("owner < id")
                  .select("shard", "id", "sub", "chars").distinct())
    salts = written(met.groupBy("shard").agg(F.ceil(F.sum("chars") / F.lit(task_chars)).cast("int").alias("salts")))
    routed = (met.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("id", "sub"), F.col("salts")).cast("int"))
              .select("shard", "salt", "id", "sub").join(cand.select("id", "sub", "packed"), ["id", "sub"]))
    parts = passages.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    found = _stream(routed, parts, window)
    found = written(found.groupBy("id", "sub").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    first = reps.select("sha", F.col("id").alias("first"))
    return (rows.drop("seeds").join(first, "sha", "left"),
            found.join(cand.select("id", "sub", "cls", "packed"), ["id", "sub"]))


def _cut(found: DataFrame) -> DataFrame:
    """id, cls, n_removed, kept (the words left, joined by a space) from removed_spans' second table."""
    id_type = found.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone, kept = [], []
            for t, s in zip(b.column("packed"), b.column("spans")):
                words, spans, at, left = _unpacked(t.as_py()).split(), _merge((x["start"], x["stop"]) for x in s.as_py()), 0, []
                for a, z in spans:
                    left += words[at:a]
                    at = z
                left += words[at:]
                gone.append(len(words) - len(left))
                kept.append(_joined(left))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("cls"), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                                             names=["id", "cls", "n_removed", "kept"])

    return map_arrow(found.select("id", "cls", "packed", "spans"), run, f"id {id_type}, cls long, n_removed long, kept string")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE,
                    shard_chars: int = SHARD_CHARS, task_chars: int = TASK_CHARS) -> DataFrame:
    """id, n_words, n_removed, kept, kept_sha256; one row per input row.

    ``kept`` is the text left where something was removed (words joined by one space, empty if all
    are covered) and null where nothing was: the row's own text then stands. ``kept_sha256`` is of
    the words left, joined by one space. See ``removed_spans`` for nulls and repeated ids.
    """
    rows, found = removed_spans(docs, id_col, text_col, window, phrase, shard_chars, task_chars)
    parts = _cut(found).select(F.col("id").alias("first"), "cls", F.col("n_removed").alias("part"), F.col("kept").alias("left"))
    whole = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    some = F.col("part").isNotNull()
    out = rows.join(parts, ["first", "cls"], "left")
    kept = F.when(whole, F.lit("")).otherwise(F.col("left"))
    sha = F.when(whole | some, F.sha2(kept.cast("binary"), 256)).otherwise(F.lower(F.hex("sha")))
    return out.select(F.col("id").alias(id_col), "n_words",
                      F.when(whole, F.col("n_words")).otherwise(F.coalesce("part", F.lit(0))).cast("long").alias("n_removed"),
                      kept.alias("kept"), sha.alias("kept_sha256"))
