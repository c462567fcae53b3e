"""Language identification by Bayesian evidence fusion.

The posterior over languages of a page multiplies four kinds of evidence: the
character-trigram likelihood of its text, the language its markup declares,
the suffix of its address, and a prior of its host. Host priors are smoothed
hierarchically (host towards registered domain towards all pages) and come,
like the reliabilities of markup and suffix, from grouped aggregation over
the text posteriors of all pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minpair.llm.arrow import map_arrow
from minpair.llm.common import no_null, written
from minpair.llm.op6_line_dedup import host_of

#: Trigrams fall into this many bins; with the languages it bounds the model.
BINS = 1 << 14
MAX_LANGUAGES = 200
#: Trigrams overlap: a text's log likelihood counts by this share.
TEMPER = 0.3
#: Pseudo-pages of the parent in a smoothed prior, pseudo-count in a reliability.
KAPPA, ALPHA = 5.0, 0.5
_CHUNK = 2_000_000

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32  # A-Z
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32


def _bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column without nulls."""
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    off = np.frombuffer(col.buffers()[1], dtype=kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def _bins(data: np.ndarray, off: np.ndarray, lo: int, hi: int):
    """Bins of the byte trigrams of texts lo..hi and the text of each (trigrams
    stay inside a text; those of blanks only do not count)."""
    c = _FOLD[data[off[lo]:off[hi]]]
    doc = np.repeat(np.arange(lo, hi), np.diff(off[lo:hi + 1]))
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (c[:-2] << 16) | (c[1:-1] << 8) | c[2:]
    ok = (doc[:-2] == doc[2:]) & (code != 0x202020) & ~((c[:-2] == 32) & (c[1:-1] == 32))
    code, doc = code[ok], doc[:-2][ok]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(18)).astype(np.int64), doc


def _spans(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about _CHUNK bytes."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + _CHUNK, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def _folded(lang: Column, kept: list[str]) -> Column:
    """A label outside the kept ones becomes its primary subtag if that is kept, else ``other``."""
    primary = F.regexp_extract(lang, "^[^-_]*", 0)
    return F.when(lang.isin(kept), lang).when(primary.isin(kept), primary).otherwise("other")


def trigram_model(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages and their log P(bin), from every text with a language.

    Each task sums its counts, Spark adds them up; what reaches the driver is
    languages x bins numbers, whatever the size of the corpus. Beyond
    ``MAX_LANGUAGES`` labels the most frequent ones (ties: by name) stay, and
    the others count as their primary subtag, if that stays, or as ``other``.
    """
    d = docs.select(F.lower(F.col(lang_col).cast("string")).alias("lang"), no_null(text_col).alias("t")).filter(
        F.col("lang").isNotNull())
    sizes = d.groupBy("lang").count()
    if sizes.limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        d = d.withColumn("lang", _folded(F.col("lang"), [r.lang for r in sizes.orderBy(F.col("count").desc(), "lang")
                                                         .limit(MAX_LANGUAGES - 1).collect()]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            coded = b.column(0).dictionary_encode()
            names, of = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            data, off = _bytes(b.column(1))
            for lo, hi in _spans(off):
                bins, doc = _bins(data, off, lo, hi)
                table = np.bincount(of[doc] * BINS + bins, minlength=len(names) * BINS).reshape(len(names), BINS)
                for name, row in zip(names, table):
                    sums[name] = sums.get(name, 0) + row
        for name, row in sums.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                                              pa.array(row[at].astype(np.int64))], names=["lang", "bin", "n"])

    counts = map_arrow(d, count, "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    counts = written(counts)
    sums = counts.toArrow()
    coded = sums.column("lang").combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    langs = sorted(names)
    place = np.array([langs.index(x) for x in names], dtype=np.int64)
    table = np.full((len(langs), BINS), 0.5)
    if langs:
        table[place[coded.indices.to_numpy()], sums.column("bin").to_numpy()] += sums.column("n").to_numpy()
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def text_evidence(items: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """``items`` (.., t) with t replaced by ll: the log likelihood per language."""
    rest = [c for c in items.columns if c != "t"]
    d = items.select(*rest, "t")
    table = items.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema if f.name != "t") + ", ll array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for b in batches:
            n = b.num_rows
            data, off = _bytes(b.column(b.num_columns - 1))
            ll = np.zeros((n, len(t)))
            for lo, hi in _spans(off):
                bins, doc = _bins(data, off, lo, hi)
                for k in range(len(t)):
                    ll[lo:hi, k] = np.bincount(doc - lo, weights=t[k][bins], minlength=hi - lo)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(t)), pa.array(ll.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], flat], names=[*rest, "ll"])

    return map_arrow(d, run, schema)


def _normal(df: DataFrame, col: str, z: Column) -> DataFrame:
    """Adds ``col``: softmax of z, in steps so that no array is computed per element."""
    d = df.withColumn("_z", z).withColumn("_m", F.array_max("_z"))
    d = d.withColumn("_e", F.transform("_z", lambda x: F.exp(x - F.col("_m"))))
    d = d.withColumn("_s", F.aggregate("_e", F.lit(0.0), lambda a, x: a + x))
    return d.withColumn(col, F.transform("_e", lambda x: x / F.col("_s"))).drop("_z", "_m", "_e", "_s")


def page_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags go."""
    return F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>", " ")


def declared_language(html: Column) -> Column:
    """Primary subtag of the ``lang`` of the html element; null if none."""
    x = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)
    return F.when(x != "", F.lower(x))


def page_items(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as items for ``identify``: id, host, domain, suffix, declared, t."""
    h = host_of(url_col)
    return pages.select(
        F.col(id_col).alias("id"), h.alias("host"),
        F.coalesce(F.nullif(F.regexp_extract(h, r"([^.]+\.[^.]+)$", 1), F.lit("")), h).alias("domain"),
        F.nullif(F.regexp_extract(h, r"\.([a-z]+)$", 1), F.lit("")).alias("suffix"),
        declared_language(F.col(html_col)).alias("declared"), page_text(no_null(html_col)).alias("t"))


def document_items(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                   text_col: str = "text") -> DataFrame:
    """Documents as items: the source is the host; nothing is declared."""
    none = F.lit(None).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("host"),
                       F.col(source_col).cast("string").alias("domain"), none.alias("suffix"), none.alias("declared"),
                       no_null(text_col).alias("t"))


def identify(items: DataFrame, langs: list[str], model: np.ndarray, temper: float = TEMPER,
             kappa: float = KAPPA, alpha: float = ALPHA) -> DataFrame:
    """The columns of ``items`` but t, with lang, confidence and text_lang, one row per item.

    An item without text, markup, suffix and host has the overall prior; a
    missing kind of evidence counts for nothing. Ties go to the language
    first in order. Repeated rows count as pages of their own. Without any
    language to choose from lang is null.
    """
    n = len(langs)
    if not n:
        return items.drop("t").select("*", F.lit(None).cast("string").alias("lang"),
                                      F.lit(None).cast("double").alias("confidence"),
                                      F.lit(None).cast("string").alias("text_lang"))
    names = F.array(*[F.lit(x) for x in langs])
    e = text_evidence(items, langs, model).withColumn("ll", F.transform("ll", lambda x: x * temper))
    e = written(_normal(e, "r", F.col("ll")))  # r: what the text alone says
    sums = [F.sum(F.get("r", i)).alias(f"n{i}") for i in range(n)]

    def total(prefix="n"):
        return F.array(*[F.col(f"{prefix}{i}") for i in range(n)])

    def add(a):
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    # grouped aggregation, one row per host, then upwards on the hosts' rows
    hosts = written(e.groupBy("host", "domain").agg(*sums))
    domains = hosts.groupBy("domain").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(n)])
    overall = written(hosts.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0.0)).alias(f"n{i}") for i in range(n)]))
    g = overall.select(total().alias("g")).withColumn("gs", add(F.col("g")))
    g = g.select(F.transform("g", lambda x: (x + 1.0 / n) / (F.col("gs") + 1.0)).alias("p0"))
    d = domains.select(F.col("domain").alias("d_domain"), total().alias("d"))
    d = d.crossJoin(F.broadcast(g)).withColumn("ds", add(F.col("d")))  # g: one row
    d = d.select("d_domain", F.zip_with("d", "p0", lambda x, p: (x + kappa * p) / (F.col("ds") + kappa)).alias("p1"))
    h = hosts.select("host", "domain", total().alias("c"))
    h = written(h.join(d, F.col("domain").eqNullSafe(F.col("d_domain")))
                .select(F.col("host").alias("h_host"), F.col("domain").alias("h_domain"), "c", "p1"))
    # reliabilities: P(declared | lang) and P(suffix | lang)
    known = F.when(F.col("declared").isNull(), F.lit(None)).when(F.col("declared").isin(langs), F.col("declared")).otherwise("other")
    e = e.withColumn("declared_as", known)

    def reliability(col, out):
        t = e.filter(F.col(col).isNotNull()).groupBy(col).agg(*sums)
        t = written(t)
        every = t.agg(*[F.sum(f"n{i}").alias(f"s{i}") for i in range(n)], F.count(F.lit(1)).alias("v"))
        return t.crossJoin(F.broadcast(every)).select(  # every: one row
            F.col(col).alias(f"k_{col}"), F.array(*[F.log((F.col(f"n{i}") + alpha) / (F.col(f"s{i}") + alpha * (F.col("v") + 1)))
                                                    for i in range(n)]).alias(out))

    zero = F.array(*[F.lit(0.0)] * n)
    x = e.join(reliability("declared_as", "lm"), F.col("declared_as") == F.col("k_declared_as"), "left")
    x = x.join(reliability("suffix", "ls"), F.col("suffix") == F.col("k_suffix"), "left")
    x = x.join(h, F.col("host").eqNullSafe(F.col("h_host")) & F.col("domain").eqNullSafe(F.col("h_domain")), "left")
    # the item itself is not part of its host's evidence
    x = x.withColumn("c", F.zip_with("c", "r", lambda a, b: F.greatest(a - b, F.lit(0.0)))).withColumn("cs", add(F.col("c")))
    x = x.withColumn("prior", F.zip_with("c", "p1", lambda a, p: F.log((a + kappa * p) / (F.col("cs") + kappa))))
    for col in ("lm", "ls"):
        x = x.withColumn("prior", F.zip_with("prior", F.coalesce(col, zero), lambda a, b: a + b))
    x = _normal(x, "post", F.zip_with("prior", "ll", lambda a, b: a + b))
    top = F.array_max("post")
    rest = [c for c in items.columns if c != "t"]
    return x.select(*rest, F.get(names, F.array_position("post", top).cast("int") - 1).alias("lang"),
                    top.alias("confidence"),
                    F.get(names, F.array_position("r", F.array_max("r")).cast("int") - 1).alias("text_lang"))
