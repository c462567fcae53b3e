"""Operators 1, 3, 8 and 10 against brute-force versions, with edge cases."""
import collections
import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from minpair.llm import op1_language_id as op1
from minpair.llm import op3_probminhash as op3
from minpair.llm import op8_bpe as op8
from minpair.llm import op10_toxicity as op10
from minpair.llm import queries as Q

RANKS = op8.load_ranks(public_tokenizers.path(Q.RANKS))
CODEC = op8.BytePairCodec(RANKS, public_tokenizers.PATTERN)


def brute_bpe(piece):
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        r = [(RANKS.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)]
        best, i = min(r)
        if best == 1 << 60:
            break
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return [RANKS[p] for p in parts]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_bpe_brute_force_and_round_trip(text):
    ids = CODEC.encode(text)
    want = [i for p in CODEC.find(text) for i in brute_bpe(p.encode())]
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert CODEC.decode(ids) == text.encode()


def test_bpe_memory_bound_changes_no_ids():
    text = " ".join(f"word{i % 97}x{i % 13}" for i in range(3000))
    small = op8.BytePairCodec(RANKS, public_tokenizers.PATTERN, cache_bytes=2000)
    assert small.encode(text) == CODEC.encode(text)
    assert small.pieces.bytes < 2000 + op8.ENTRY_BYTES + 8 * op8.CACHE_CHARS and small.pieces.old


def test_bpe_long_piece_and_tiktoken():
    import tiktoken
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    for t in ["ab" * 20000, "é" * 5000, "<|endoftext|> a\n\n b", "aaa " * 500]:
        assert np.frombuffer(CODEC.encode(t), "<u4").tolist() == enc.encode_ordinary(t)


def test_bpe_table(make_docs, edge_rows):
    out = Q.digests(op8.bpe_encode_decode(make_docs(edge_rows, extra=True), public_tokenizers.path(Q.RANKS), public_tokenizers.PATTERN)).collect()
    assert len(out) == len(edge_rows) and {r.n_tokens for r in out if r.doc_id in (1, 2)} == {0}
    assert op8.bpe_encode_decode(make_docs([]), public_tokenizers.path(Q.RANKS), public_tokenizers.PATTERN).count() == 0


def brute_jp(a, b):
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in set(a) | set(b)) for i in set(a) & set(b))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 20), st.integers(1, 5), min_size=1), st.dictionaries(st.integers(0, 20), st.integers(1, 5), min_size=1))
def test_probability_jaccard(a, b):
    def arrays(x):
        k = np.array(sorted(x), dtype=np.uint64)
        return k, np.array([x[int(i)] for i in k])
    assert abs(op3.probability_jaccard(*arrays(a), *arrays(b)) - brute_jp(a, b)) < 1e-9


def test_registers_estimate_similarity():
    rng = random.Random(4)
    a = [rng.getrandbits(62) for _ in range(300)]
    b = a[:240] + [rng.getrandbits(62) for _ in range(60)]
    flat, starts = np.array(a + b, dtype=np.uint64), np.array([0, 300, 600])
    d, h, w = op3.shingle_counts(flat, starts, 1)
    sig = op3.signatures(d, h, w, 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - 240 / 360) < 0.04


def shingles(t):
    w = t.split()
    return collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else {}


def brute_classes(rows):
    ids = [i for i, _ in rows]
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    s = {i: shingles(t or "") for i, t in rows}
    for x in range(len(ids)):
        for y in range(x):
            a, b = s[ids[x]], s[ids[y]]
            plain = len(set(a) & set(b)) / max(1, len(set(a) | set(b)))
            if a and b and max(brute_jp(a, b), plain) >= 0.8 - 1e-9:
                p, q = sorted((root(ids[x]), root(ids[y])))
                parent[q] = p
    return {i: root(i) for i in ids}


def near_rows(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, n = [], 0
    passage = " ".join(word() for _ in range(60))
    for _ in range(6):
        base = [word() for _ in range(rng.choice([8, 40, 120]))]
        for _ in range(rng.choice([1, 3, 30])):  # copies with edits, some in large groups
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                t[rng.randrange(len(t))] = word()
            rows.append((n, " ".join(t)))
            n += 1
    for _ in range(2):  # repeats itself: the two similarities differ
        base = [word() for _ in range(46)]
        rows.append((n, " ".join(base * 6)))
        base[rng.randrange(46)] = word()
        rows.append((n + 1, " ".join(base * 6)))
        n += 2
    for _ in range(15):  # unlike texts round one passage
        rows.append((n, passage + " " + " ".join(word() for _ in range(100))))
        n += 1
    return rows


def test_near_dedup_brute_force(make_docs):
    for seed in (1, 2):
        rows = near_rows(seed)
        got = {r.doc_id: r.group_id for r in op3.near_dedup(make_docs(rows, extra=True)).collect()}
        assert got == brute_classes(rows)


def template_rows(n=2000, planted=150, seed=3):
    """Texts round one template (mutual similarity 0.74), and pairs of 0.80 to 0.85 among them."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    template = [word() for _ in range(120)]
    rows = [(i, template + [word() for _ in range(20)]) for i in range(n)]
    for k in range(planted):
        same = 120 + rng.choice([6, 7, 8])
        rows[n - 1 - k] = (n - 1 - k, rows[k][1][:same] + [word() for _ in range(140 - same)])
    return [(i, " ".join(t)) for i, t in rows]


def plain_classes(rows):
    """Classes by the Jaccard of the distinct shingles alone (no text repeats itself)."""
    sets = [set(shingles(t)) for _, t in rows]
    times = collections.Counter(x for s in sets for x in s)
    place = {x: k for k, x in enumerate(x for x, n in times.items() if n > 1)}
    has = np.zeros((len(rows), len(place)), dtype=np.float32)
    for k, s in enumerate(sets):
        has[k, [place[x] for x in s if x in place]] = 1
    both, size = has @ has.T, np.array([len(s) for s in sets])
    label = np.arange(len(rows))
    for x, y in np.argwhere(both >= (0.8 - 1e-9) * (size[:, None] + size[None, :] - both)):
        label[label == max(label[x], label[y])] = min(label[x], label[y])
    return {i: rows[label[k]][0] for k, (i, _) in enumerate(rows)}


def test_near_dedup_pairs_round_a_template(make_docs):
    rows = template_rows()
    want = plain_classes(rows)
    assert sum(i != g for i, g in want.items()) >= 150
    got = {r.doc_id: r.group_id for r in op3.near_dedup(make_docs(rows)).collect()}
    assert got == want


def test_near_dedup_blocks(make_docs, monkeypatch):
    """Small blocks, so that buckets are dealt to many tasks."""
    for name, value in (("BLOCK_NODES", 16), ("BLOCK_WORDS", 4000), ("SLICE", 100)):
        monkeypatch.setattr(op3, name, value)
    rows = template_rows(150, 20, seed=5)
    assert {r.doc_id: r.group_id for r in op3.near_dedup(make_docs(rows)).collect()} == plain_classes(rows)


def test_block_links_brute_force():
    rng = random.Random(7)
    for _ in range(40):
        base = [rng.randrange(6) for _ in range(30)]
        texts = [base[:rng.randrange(20, 31)] + [rng.randrange(6) for _ in range(rng.randrange(6))] * rng.randrange(1, 4)
                 for _ in range(12)]
        flat = np.array([x for t in texts for x in t], dtype=np.uint64)
        starts = np.cumsum([0] + [len(t) for t in texts])
        found = op3.block_links(list(range(12)), np.arange(12), np.arange(12), np.arange(12), flat, starts, 0.8, 5)
        want = brute_classes([(i, " ".join(map(str, t))) for i, t in enumerate(texts)])
        label = list(range(12))
        for a, b in sorted(found):
            label = [min(label[a], label[b]) if v in (label[a], label[b]) else v for v in label]
        assert dict(enumerate(label)) == want


def test_near_dedup_unequal_repetition(make_docs):
    """A block ten times in one text and once in the other: plain Jaccard about 1, the other 0.5."""
    rng, rows = random.Random(9), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    for k in range(12):
        text, block = [word() for _ in range(200)], [word() for _ in range(100)]
        rows += [(2 * k, " ".join(text + block * 10)), (2 * k + 1, " ".join(text + block))]
    got = {r.doc_id: r.group_id for r in op3.near_dedup(make_docs(rows)).collect()}
    assert got == {i: i - i % 2 for i in range(24)}


def test_near_dedup_edges(make_docs, edge_rows):
    out = op3.near_dedup(make_docs(edge_rows, extra=True)).collect()
    assert len(out) == len(edge_rows)
    group = {r.doc_id: r.group_id for r in out}
    assert group[1] == 1 and group[2] == 2 and group[3] == 3  # no words: alone
    assert group[7] == 4 and group[5] == 5 and group[6] == 6 and group[None] is None
    assert op3.near_dedup(make_docs([])).count() == 0
    one = op3.near_dedup(make_docs([(1, "a b c d e f g h i j"), (1, "k l m n o p q r s t")])).collect()
    assert {r.group_id for r in one} == {1}


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
    return d[-1]


def test_levenshtein_automaton_brute_force():
    terms = [op10.Term(t, False) for t in ("idiot", "clown", "worthless", "bad", "disgusting")] + [op10.Term("lowei", True)]
    auto = op10.LexiconAutomaton(terms, max_states=60)  # small: it must start anew on the way
    rng = random.Random(2)
    for _ in range(4000):
        w = list(rng.choice(terms).text + rng.choice(["", "x", "schaft"]))
        for _ in range(rng.randrange(4)):
            p = rng.randrange(1, len(w) + 1)
            w[p - 1 + rng.randrange(2):p] = rng.choice(["", "a", "o", "li"])
            w = w or ["z"]
        w = "".join(w)
        # the first letter is never edited
        close = [edits(w[1:], t.text[1:]) for t in terms if not t.stem and w[0] == t.text[0] and edits(w[1:], t.text[1:]) <= t.distance]
        want = "stem" if w.startswith("lowei") else None if not close else "exact" if min(close) == 0 else "fuzzy"
        assert auto.match(w) == want, w


def test_context_separates_quotation():
    s = op10.Scorer([op10.Term("idiot", False)])
    f = dict(zip(op10.FEATURES, s.features('He said "you idiot" to them and left the room at once')))
    assert f["quoted"] > 0 and f["exact"] == 0
    f = dict(zip(op10.FEATURES, s.features("What an idoit you are, you IDIOT")))
    assert f["exact"] > 0 and f["quoted"] == 0


def test_toxicity(spark, make_docs, edge_rows):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = Q.op10_toxicity(spark, d).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.9 * len(got)
    empty = op10.fit(make_docs([]), labels, op10.training_fold())
    assert empty.terms == [] and op10.toxicity_scores(make_docs([]), empty).count() == 0
    out = op10.toxicity_scores(make_docs(edge_rows, extra=True), empty).collect()
    assert len(out) == len(edge_rows) and all(r.predicted == 0 for r in out)


def test_language_id(spark, make_docs, edge_rows):
    d = "/root/testdata/sf0.001"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    out = Q.op1_language_id(spark, d).collect()
    docs = [r for r in out if r.kind == "document"]
    assert len(docs) == len(truth) and sum(r.lang == truth[r.doc_id] for r in docs) >= 0.97 * len(docs)
    train = make_docs([(1, "the cat and the dog", "en", "s", 0), (2, "der hund und die katze", "de", "s", 0), (3, None, None, None, 0)])
    langs, model = op1.trigram_model(train)
    assert langs == ["de", "en"]
    got = op1.identify(op1.document_items(make_docs(edge_rows, extra=True)), langs, model).collect()
    assert len(got) == len(edge_rows) and all(r.lang in langs for r in got)
    assert op1.identify(op1.document_items(make_docs([])), langs, model).count() == 0
    none, empty = op1.trigram_model(make_docs([]))
    assert none == [] and op1.identify(op1.document_items(make_docs(edge_rows)), none, empty).count() == len(edge_rows)


def test_markup_breaks_a_tie(spark):
    langs, model = ["de", "en"], np.log(np.full((2, op1.BINS), 1 / op1.BINS)).astype(np.float32)
    model[0, :100] += 0.5
    rows = [(i, f"http://h{i % 3}.example.de/", f'<html lang="de"><script>x</script><p>{"wort " * 40}</p></html>') for i in range(12)]
    items = op1.page_items(spark.createDataFrame(rows + [(99, None, None)], "page_id long, url string, html string"))
    assert [r.declared for r in items.orderBy("id").collect()] == ["de"] * 12 + [None]
    out = op1.identify(items, langs, model).collect()
    assert len(out) == 13
