"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Merges run in rank order, leftmost first. The queue has one bucket of
positions per rank; three levels of 64-bit words say which buckets hold
anything, so the next rank is three find-first-set steps whatever the length
of the pre-token. Pairs live in a doubly linked list over byte offsets; an
entry whose pair has changed since it was queued is stale and skipped.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minpair.llm.arrow import map_arrow, text_slices
from minpair.llm.common import no_null

#: Bytes of the pre-tokens remembered per Python worker (in each of two generations), and the longest that is.
CACHE_BYTES = 112 << 20
CACHE_CHARS = 48
#: What a remembered pre-token takes besides its characters and ids: two objects and its place in the table.
ENTRY_BYTES = 180
#: Bytes of text encoded before the ids are passed on.
SLICE_BYTES = 2 << 20


class _Pieces(dict):
    """Pre-token -> packed ids; a missing one is merged. Kept in two generations,
    so that the bound never forgets the pieces in use."""

    def __init__(self, merge, bound: int):
        super().__init__()
        self.merge, self.bound, self.old, self.bytes = merge, bound, {}, 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            got = self.merge(piece.encode())
            ids = pack(f"<{len(got)}I", *got)
        if len(piece) <= CACHE_CHARS:
            if self.bytes >= self.bound:
                self.old, self.bytes = dict(self), 0
                self.clear()
            # two bytes a character at most, in nearly all texts
            self.bytes += ENTRY_BYTES + 2 * len(piece) + len(ids)
            self[piece] = ids
        return ids


class BytePairCodec:
    """Encoder and decoder of one vocabulary; one instance per Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_bytes: int = CACHE_BYTES):
        import regex

        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.find = regex.compile(pattern).findall
        n = max(ranks.values()) + 1
        # the queue: which ranks, and which 64 and 4096 of them, have a bucket
        self.low, self.mid = [0] * ((n >> 6) + 1), [0] * ((n >> 12) + 1)
        self.pieces = _Pieces(self.merge, cache_bytes)
        self.token = {i: b for b, i in ranks.items()}

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token. The queue's steps are written out in place:
        they are most of the work."""
        ranks, n, get, longest = self.ranks, len(piece), self.ranks.get, self.longest
        if (whole := get(piece)) is not None:
            return [whole]
        low, mid, top, buckets = self.low, self.mid, 0, {}
        # nodes are named by their first byte; nxt[i] is also where node i ends
        nxt, prv, pair = list(range(1, n + 1)), list(range(-1, n)), [-1] * n
        changed = range(n - 1)
        while True:
            for p in changed:  # queue the pair that begins at p
                j = nxt[p]
                end = nxt[j] if j < n else n
                r = get(piece[p:end]) if j < n and end - p <= longest else None
                if r is None:
                    pair[p] = -1
                    continue
                pair[p] = r
                b = buckets.get(r)
                if b is not None:
                    heappush(b, p)
                    continue
                buckets[r] = [p]
                w = r >> 6
                if not low[w]:
                    x = w >> 6
                    mid[x] |= 1 << (w & 63)
                    top |= 1 << x
                low[w] |= 1 << (r & 63)
            i = -1
            while top:  # the smallest rank by find-first-set on three levels, its first position
                x = (top & -top).bit_length() - 1
                m = mid[x]
                w = (x << 6) + (m & -m).bit_length() - 1
                v = low[w]
                r = (w << 6) + (v & -v).bit_length() - 1
                b = buckets[r]
                i = heappop(b)
                if not b:
                    del buckets[r]
                    low[w] = v = v & (v - 1)
                    if not v:
                        mid[x] = m = m & (m - 1)
                        if not m:
                            top &= top - 1
                if pair[i] == r:
                    break
                i = -1  # stale
            if i < 0:
                break
            j = nxt[i]
            end = nxt[i] = nxt[j]
            pair[j] = -1
            k = prv[i]
            if end < n:
                prv[end] = i
            changed = (i,) if k < 0 else (i, k)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:nxt[i]]])
            i = nxt[i]
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


_CODECS: dict[str, BytePairCodec] = {}


def _codec(key: str, ranks, pattern: str, cache_bytes: int) -> BytePairCodec:
    if key not in _CODECS:
        _CODECS[key] = BytePairCodec(ranks.value, pattern, cache_bytes)
    return _CODECS[key]


def bpe_encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                      text_col: str = "text", cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """id, token_ids (binary, little-endian unsigned 32-bit) and decoded (binary), per input row.

    The vocabulary file is read on the driver and broadcast (a fixed size).
    A null text counts as empty: no tokens, empty bytes. Null ids and
    repeated rows stay; other columns are ignored; special tokens in a text
    are plain text. ``cache_bytes`` bounds the remembered pre-tokens of a worker, in each of
    two generations; it changes the work and the memory, never the ids.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    key = f"{ranks_path}|{pattern}|{cache_bytes}"
    d = docs.select(F.col(id_col).alias("id"), no_null(text_col).alias("t"))
    id_type = d.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, ranks, pattern, cache_bytes)
        for b in (s for x in batches for s in text_slices(x, 1, SLICE_BYTES)):
            ids = [codec.encode(t.as_py()) for t in b.column(1)]
            back = [codec.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.binary()), pa.array(back, pa.binary())],
                names=["id", "token_ids", "decoded"])

    out = map_arrow(d, run, f"id {id_type}, token_ids binary, decoded binary")
    return out.withColumnRenamed("id", id_col)
