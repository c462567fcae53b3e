"""Operators 11 to 13 against brute force, and edge cases."""
import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations
from zlib import crc32

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from minpair.llm import op11_spelling_groups as op11
from minpair.llm import op12_substring_dedup as op12
from minpair.llm import op13_token_alignment as op13

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


# ------------------------------------------------------------------ 11

def slow_counts(rows):
    n = Counter()
    for i, text in rows:
        i = "" if i is None else i
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = crc32(f"{i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def slow_groups(n):
    near = defaultdict(list)
    for a, b in combinations(n, 2):
        if abs(len(a) - len(b)) <= 1 and one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), form[w] and n[form[w]])
    return out


def words_of(rng, n, letters, lengths):
    return ["".join(rng.choices(letters, k=rng.choice(lengths))) for _ in range(n)]


def test_near_pairs_equal_all_pairs():
    rng = random.Random(5)
    for letters, lengths in (("ab", (5, 6, 7)), ("abcdeé", (5, 6)), ("a", (6, 7, 40, 41)), ("aàÿ", (9, 10))):
        words = sorted(set(words_of(rng, 300, letters, lengths)))
        want = {tuple(sorted((a, b))) for a, b in combinations(words, 2) if abs(len(a) - len(b)) <= 1 and one_edit(a, b)}
        got = []
        by = defaultdict(list)
        for w in words:
            by[len(w)].append(w)
        for k, own in by.items():
            m = op11.letter_matrix(own, k)
            q, p = op11.near_pairs(m, m, True, True)
            got += [tuple(sorted((own[i], own[j]))) for i, j in zip(q, p)]
            if k - 1 in by:
                q, p = op11.near_pairs(m, op11.letter_matrix(by[k - 1], k - 1), False)
                got += [tuple(sorted((by[k - 1][i], own[j]))) for i, j in zip(q, p)]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("shard_words", [op11.SHARD_WORDS, 64])
def test_spelling_groups_brute_force(spark, make_docs, monkeypatch, shard_words):
    """64 words a shard: the vocabulary is dealt over many, and words meet across them."""
    monkeypatch.setattr(op11, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(op11, "SAMPLE_WORDS", 16)
    rng = random.Random(7)
    pool = words_of(rng, 500, "abcdé", (5, 6, 6, 7)) + ["Straße", "CAFÉS", "cafés", "naïveté"] * 3
    rows = [(i, " ".join(rng.choices(pool, weights=[1 + 3 * (k % 9) for k in range(len(pool))], k=60))) for i in range(60)]
    rows += [(None, "abcde abcde"), (3, None), (4, ""), (5, "ab" * 20000), (5, "ab" * 20000), (6, "ab" * 20000), (7, "1 2 3 --")]
    rows += [(200, "zzchain " * 40), (201, "zzchai " * 15), (202, "zzcha " * 5)]  # a form of a form
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in op11.spelling_groups(make_docs(rows, extra=True)).collect()}
    want = slow_groups(slow_counts(rows))
    assert got == want and any(v[0] for v in want.values()) and any(v[0] and v[1] != v[0] for v in want.values())


def test_spelling_groups_empty(spark, make_docs):
    assert op11.spelling_groups(make_docs([])).collect() == []
    assert op11.spelling_groups(make_docs([(1, None), (2, "ab cd")])).collect() == []
    with pytest.raises(ValueError):
        op11.spelling_groups(make_docs([]), ratio=1)


# ------------------------------------------------------------------ 12

def slow_removed(rows, window):
    docs = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    first = {}
    for i, w in docs:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k:k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k:k + window])] < i:
                    gone[k:k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def passages(seed, n_docs, vocab, window):
    rng = random.Random(seed)
    words = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(vocab)]
    shared = [rng.choices(words, k=rng.randint(window - 3, 3 * window)) for _ in range(12)]
    rows = []
    for i in range(n_docs):
        body = []
        for _ in range(rng.randint(0, 4)):
            body += rng.choices(words, k=rng.randint(0, window)) + rng.choice(shared)
        body += rng.choices(words, k=rng.randint(0, 9))
        sep = rng.choice([" ", "\n", " \t "])
        rows.append((i, sep.join(body)))
    near = shared[0] * 3
    for i in range(40):  # a large group of near copies, one word changed
        x = list(near)
        x[rng.randrange(len(x))] = f"new{i}"
        rows.append((n_docs + i, " ".join(x)))
    rows += [(n_docs + 50 + i, " ".join(near)) for i in range(20)]  # and of exact ones
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("window,phrase,shard,task,vocab", [(50, 16, op12.SHARD_CHARS, op12.TASK_CHARS, 4000),
                                                            (12, 5, 700, 1500, 900), (6, 6, 300, 400, 3)])
def test_substring_dedup_brute_force(spark, make_docs, window, phrase, shard, task, vocab):
    """Small shards and tasks: passages over many automata, hot ones salted; three words: everything repeats."""
    rows = passages(window, 60 if vocab > 3 else 25, vocab, window)
    got = op12.substring_dedup(make_docs(rows, extra=True), window=window, phrase=phrase, shard_chars=shard, task_chars=task)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=str) == slow_removed(rows, window)


def test_substring_dedup_edges(spark, make_docs, edge_rows):
    long = " ".join(f"x{i}" for i in range(30000))
    rows = [*edge_rows, (8, "very " * 70), (None, "very " * 60), (9, long), (10, "y " * 60 + long), (9, "y " * 60), (11, long + " end"),
            (12, "   ".join(["z"] * 60)), (13, "   ".join(["z"] * 60)), (13, long)]
    got = op12.substring_dedup(make_docs(rows))
    have = got.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in have), key=str) == slow_removed(rows, 50)
    for r in have:
        assert (r.kept is None) == (r.n_removed == 0)
        if r.kept is not None:
            assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256
    assert op12.substring_dedup(make_docs([])).collect() == []
    ids = make_docs(rows).selectExpr("concat('d', lpad(doc_id, 4, '0')) as doc_id", "text")
    text = [(None if i is None else f"d{i:04d}", t) for i, t in rows]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in op12.substring_dedup(ids).collect()), key=str) == slow_removed(text, 50)


# ------------------------------------------------------------------ 13

class Slow:
    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        self.letters = op13.byte_letters()

    def piece(self, i):
        p = self.b.id_to_piece(i)
        m = re.fullmatch("<0x(..)>", p)
        return bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return []
        x, y = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        bx = [bytes(self.letters[c] for c in self.a.id_to_token(i)) for i in x]
        by = [self.piece(i) for i in y]
        if b"".join(bx) != (" " + text).encode() or b"".join(by) != (" " + text).encode():
            return []
        ends = sorted(set(np.cumsum([len(z) for z in bx]).tolist()) & set(np.cumsum([len(z) for z in by]).tolist()))
        out, i, j, at_x, at_y = [], 0, 0, 0, 0
        for e in ends:
            g = ([], [])
            while at_x < e:
                at_x += len(bx[i])
                g[0].append(x[i])
                i += 1
            while at_y < e:
                at_y += len(by[j])
                g[1].append(y[j])
                j += 1
            out.append(g)
        return out


TEXTS = ["Hello world, this is a test.", "naïve café — 東京 🙂🙂", "  two  spaces and\ttabs\n\nlines ", "<|endoftext|> is <s> plain </s>", "x",
         " ", "\n", "a▁b", "a\x00b", "ﬁ ligature Ⅷ", "aaaaaaaaaa" * 300, "the the the the", "The quick brown fox; jumped!", "é combining",
         "0x1F600 123456789 3.14", "don't can't we'll", "word " * 400, "ß" * 50, "Zürich\r\nBern", "tail ", "İstanbul ǅ", "​zero width", None, ""]


def slow_alignment(rows):
    slow, per = Slow(), []
    for i, t in rows:
        g = slow.groups(t)
        per.append((i, g, Counter((x, y) for a, b in g for x in a for y in b)))
    count = Counter()
    for _, _, links in per:
        count.update(links.keys())
    best = defaultdict(int)
    for (x, _), c in count.items():
        best[x] = max(best[x], c)
    out = []
    for i, g, links in per:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(links.values()),
                    sum(n for (x, y), n in links.items() if count[x, y] == best[x]), sum(n * count[k] for k, n in links.items()), text))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [op13.BROADCAST_MAX_PAIRS, 0])
def test_alignment_brute_force(spark, make_docs, bound):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[0]), (None, TEXTS[0]), (99, " ".join(t for t in TEXTS[:5] if t) * 40)]
    out = op13.with_pair_counts(op13.align(make_docs(rows, extra=True), A, B), op13.piece_count(B), bound)
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in out.collect()]
    assert sorted(got, key=str) == slow_alignment(rows)
    assert op13.with_pair_counts(op13.align(make_docs([]), A, B), op13.piece_count(B)).collect() == []


def test_chunks_are_encoded_as_whole_texts(monkeypatch):
    """What is remembered of chunks gives the ids of the libraries on whole texts, also when it is forgotten."""
    monkeypatch.setattr(op13, "HELD_CHUNKS", 40)
    al = op13.Aligner(op13.ByteLevelSide(open(A, "rb").read()), op13.PieceSide(open(B, "rb").read()))
    assert al.a.splits and al.b.splits
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet").text.tolist() + [t for t in TEXTS if t]
    slow = Slow()
    for lo in range(0, len(docs), 25):
        part = docs[lo:lo + 25]
        for text, x, y in zip(part, *al.tokens(part)):
            g = slow.groups(text)
            assert [i for a, _ in g for i in a] == x.tolist() and [i for _, b in g for i in b] == y.tolist()
    al.a.splits = False
    whole = al.tokens(docs[:40])
    al.a.splits = True
    assert all((x == y).all() and len(x) == len(y) for side, other in zip(al.tokens(docs[:40]), whole) for x, y in zip(side, other))


def test_links_of_large_groups(monkeypatch):
    """A group of very many pairs is counted by its distinct ids, in blocks, to the same sums."""
    rng = np.random.default_rng(2)
    def frame(sizes):
        stop = np.cumsum(sizes)
        return pd.DataFrame({"doc": 0, "id": rng.integers(0, 9, len(sizes)), "start": stop - sizes, "stop": stop})
    a, b = frame(np.full(60, 4)), frame(np.full(80, 3))
    ends = op13.group_ends(a, b)
    assert ends.tolist() == list(range(12, 241, 12))
    ga, gb = (np.searchsorted(ends, x["stop"].to_numpy()) for x in (a, b))
    na, nb = (np.bincount(g) for g in (ga, gb))
    want = Counter(int(x) * 10 + int(y) for g in range(len(ends)) for x in a["id"][ga == g] for y in b["id"][gb == g])
    for large, block in ((4096, 1 << 20), (4096, 5), (3, 7), (0, 1)):
        monkeypatch.setattr(op13, "LARGE_GROUP", large)
        monkeypatch.setattr(op13, "BLOCK_LINKS", block)
        doc, key, n = op13.linked_pairs(a, b, ga, gb, na, nb, 10, 10)
        assert dict(zip(key.tolist(), n.tolist())) == want and len(key) == len(want) and not doc.any()
