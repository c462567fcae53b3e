"""The registered queries of this subpackage, production parameters, whole tables.

``ORACLES`` holds DuckDB SQL where SQL can express the query; the learned
ones (1, 4, 7, 10), the sketch (3) and the codec (8) are tested against
brute-force versions in tests/llm.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from minpair.llm import op1_language_id as op1
from minpair.llm import op2_mixing as op2
from minpair.llm import op3_probminhash as op3
from minpair.llm import op4_quality_rules as op4
from minpair.llm import op5_secret_scan as op5
from minpair.llm import op6_line_dedup as op6
from minpair.llm import op7_quality_classifier as op7
from minpair.llm import op8_bpe as op8
from minpair.llm import op9_exact_dedup as op9
from minpair.llm import op10_toxicity as op10
from minpair.llm import op11_spelling_groups as op11
from minpair.llm import op12_substring_dedup as op12
from minpair.llm import op13_token_alignment as op13
from minpair.llm.common import crc_fold, read

RANKS = "byte_bpe_multi_50k.tiktoken"
#: The two sides of the alignment.
SIDE_A, SIDE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"

#: Target weights of the mix: by domain, then by language within it; sources share equally.
DOMAIN_WEIGHTS = {("d0",): 4.0, ("d1",): 3.0, ("d2",): 2.0, ("d3",): 1.0}
LANGUAGE_WEIGHTS = {(d, "en"): 2.0 for d in ("d0", "d1", "d2", "d3")}
WEIGHTS = DOMAIN_WEIGHTS | LANGUAGE_WEIGHTS
FRACTION, MAX_EPOCHS = 0.5, 2


def domain_of(source):
    """Domain of a source: its number modulo 4 (other if it has none)."""
    n = F.regexp_extract(F.coalesce(source.cast("string"), F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(n == "", "other").otherwise(F.concat(F.lit("d"), (F.try_to_number(n, F.lit("999999999")) % 4).cast("int").cast("string")))


def levels():
    return [domain_of(F.col("source")), F.col("lang"), F.col("source")]


def op1_language_id(spark, sf_dir):
    docs, pages = read(spark, sf_dir, "documents"), read(spark, sf_dir, "pages")
    langs, model = op1.trigram_model(docs)
    items = (op1.document_items(docs).withColumn("kind", F.lit("document"))
             .unionByName(op1.page_items(pages).withColumn("kind", F.lit("page"))))
    out = op1.identify(items, langs, model)
    return out.select("kind", F.when(F.col("kind") == "document", F.col("id")).alias("doc_id"),
                      F.when(F.col("kind") == "page", F.col("id")).alias("page_id"),
                      "lang", F.round("confidence", 6).alias("confidence"), "text_lang", "declared", "host")


def op2_mixing(spark, sf_dir):
    out = op2.mix(read(spark, sf_dir, "documents"), levels(), WEIGHTS, FRACTION, MAX_EPOCHS)
    return out.select("doc_id", F.col("k0").alias("domain"), F.col("k1").alias("lang"),
                      F.col("k2").alias("source"), "n_tokens", "copies")


def op3_probminhash(spark, sf_dir):
    return op3.near_dedup(read(spark, sf_dir, "documents"))


def op4_decision_list(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return op4.quality_rules(docs, op4.fit(docs, read(spark, sf_dir, "labels")))


def op5_blob_ledger(spark, sf_dir):
    found, _ = op5.secret_scan(read(spark, sf_dir, "documents"))
    base = op5.span_text("spans", first=len(op5.BASE_RULES))
    counts = [op5.span_count("spans", i).alias(f"n_{r.kind}") for i, r in enumerate(op5.BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"),
                        op5.span_text("spans").alias("spans"))


def op6_line_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = op6.line_dedup(docs, F.col("source"), dropped_col="n_dropped")
    return out.select("doc_id", "source", "n_dropped", "text")


def op7_rule_ensemble(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = op7.fit(docs, read(spark, sf_dir, "labels"), op7.training_fold())
    out = op7.quality_scores(docs, model, ["doc_id"])
    return out.select("doc_id", F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
                      "score", "predicted")


def digests(encoded, id_col="doc_id"):
    """Contract columns of an encoded table."""
    return encoded.select(id_col, (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
                          F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_rank_queue_bpe(spark, sf_dir):
    return digests(op8.bpe_encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS),
                                         public_tokenizers.PATTERN))


def op9_exact_dedup(spark, sf_dir):
    return op9.exact_dedup(read(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = op10.fit(docs, read(spark, sf_dir, "labels"), op10.training_fold())
    out = op10.toxicity_scores(docs, model)
    return out.select("doc_id", F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
                      "score", "predicted", *[f"f_{f}" for f in op10.FEATURES])


def op11_spelling_groups(spark, sf_dir):
    return op11.spelling_groups(read(spark, sf_dir, "documents"))


def op12_substring_dedup(spark, sf_dir):
    out = op12.substring_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op13_token_alignment(spark, sf_dir):
    a, b = public_tokenizers.path(SIDE_A), public_tokenizers.path(SIDE_B)
    out = op13.align(read(spark, sf_dir, "documents"), a, b)
    sha = F.when(F.col("n_groups") == 0, "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    out = op13.with_pair_counts(out.withColumn("groups_sha256", sha).drop("groups"), op13.piece_count(b))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_mixing, op3_probminhash, op4_decision_list, op5_blob_ledger, op6_line_dedup,
    op7_rule_ensemble, op8_rank_queue_bpe, op9_exact_dedup, op10_toxicity,
    op11_spelling_groups, op12_substring_dedup, op13_token_alignment)}

# ---------------------------------------------------------------------------
# DuckDB SQL
# ---------------------------------------------------------------------------

_CASE = "CASE {} END"


def _water_sql(name: str, src: str, family: list[str]) -> str:
    part = f"partition by {', '.join(family)}" if family else ""
    return f"""{name}_a as (
  select *, coalesce(sum(c) over ({part} order by c / w, k rows between unbounded preceding and 1 preceding), 0) as before,
         sum(w) over ({part} order by c / w, k rows between current row and unbounded following) as rest from {src}),
{name}_b as (select *, c * rest <= (b - before) * w as full_ from {name}_a),
{name}_c as (select *, sum(case when full_ then c else 0 end) over ({part}) as used,
             sum(case when full_ then 0 else w end) over ({part}) as open_ from {name}_b),
{name} as (select * exclude (b, before, rest, full_, used, open_),
  case when full_ then c else least(c, greatest(0, coalesce((b - used) * w / nullif(open_, 0), 0))) end as alloc from {name}_c)"""


OP2_SQL = f"""with d as (
  select doc_id, case when regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' then 'other'
           else 'd' || cast(cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) as bigint) % 4 as varchar) end as domain,
         lang, source,
         cast(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) as bigint) as n_tokens
  from documents),
leaf as (select domain, lang, source, sum(n_tokens) as supply, cast(sum(n_tokens) as double) * {MAX_EPOCHS} as c from d group by 1, 2, 3),
n1 as (select domain, domain as k, sum(c) as c,
         {_CASE.format(' '.join(f"when domain = '{p[0]}' then {w}" for p, w in DOMAIN_WEIGHTS.items()) + ' else 1.0')} as w,
         (select floor(cast(sum(supply) as double) * {FRACTION}) from leaf) as b from leaf group by 1),
{_water_sql('a1', 'n1', [])},
n2 as (select l.domain, l.lang, l.lang as k, sum(l.c) as c,
         case when l.lang = 'en' and l.domain <> 'other' then 2.0 else 1.0 end as w, any_value(a1.alloc) as b
       from leaf l join a1 on l.domain = a1.domain group by 1, 2),
{_water_sql('a2', 'n2', ['domain'])},
n3 as (select l.domain, l.lang, l.source, l.source as k, l.c, l.supply, cast(1.0 as double) as w, a2.alloc as b
       from leaf l join a2 on l.domain = a2.domain and l.lang is not distinct from a2.lang),
{_water_sql('a3', 'n3', ['domain', 'lang'])},
p as (select domain, lang, source, supply, cast(floor(alloc + 1e-6) as bigint) as budget,
        cast(coalesce(floor(cast(floor(alloc + 1e-6) as bigint) // nullif(supply, 0)), 0) as bigint) as whole from a3),
r as (select d.*, p.whole, p.budget - p.whole * p.supply as left_,
        cast('0x' || substr(md5('{op2.SEED}:' || p.whole || ':' || coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as h
      from d join p on d.domain = p.domain and d.lang is not distinct from p.lang and d.source is not distinct from p.source),
s as (select *, sum(n_tokens) over (partition by domain, lang, source order by h) as cum from r)
select doc_id, domain, lang, source, n_tokens,
       cast(whole + case when whole < {MAX_EPOCHS} and cum <= left_ then 1 else 0 end as integer) as copies from s"""


def _spans_sql(i: int, r: op5.SecretRule) -> str:
    q = r.pattern.replace("'", "''")
    return f"""h{i} as (
  select doc_id, k, len(m[k]) as n, len(g[k]) as gn,
         sum(len(p[k])) over w + coalesce(sum(len(m[k])) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) as start_
  from (select doc_id, regexp_extract_all(t, '{q}', 0) as m, regexp_extract_all(t, '{q}', {r.group}) as g,
               string_split_regex(t, '{q}') as p, unnest(range(1, len(regexp_extract_all(t, '{q}', 0)) + 1)) as k from d)
  window w as (partition by doc_id order by k))"""


OP5_SQL = f"""with d as (select doc_id, coalesce(text, '') as t from documents),
{', '.join(_spans_sql(i, r) for i, r in enumerate(op5.RULES))},
spans as ({' union all '.join(f"select doc_id, cast(start_ as bigint) as s, {i} as k, cast(start_ + n as bigint) as e, '{r.kind}' as kind from h{i} where gn >= {r.least}" for i, r in enumerate(op5.RULES))}),
g as (select doc_id, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
        string_agg(kind || ':' || s || ':' || e, ',' order by s, k) filter (k < 3) as base,
        string_agg(kind || ':' || s || ':' || e, ',' order by s, k) as spans from spans group by 1)
select d.doc_id, cast(coalesce(n_assign, 0) as bigint) as n_assign, cast(coalesce(n_access, 0) as bigint) as n_access,
       cast(coalesce(n_hex, 0) as bigint) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g on d.doc_id = g.doc_id"""

OP6_SQL = """with l as (
  select doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
t as (select source, count(*) as host_pages from documents group by 1),
c as (select source, line, count(distinct doc_id) as pages from l where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by 1, 2),
b as (select c.source, c.line from c join t on c.source is not distinct from t.source
      where pages >= 2 and pages > 0.1::double * host_pages),
k as (select l.doc_id, string_agg(l.line, chr(10) order by l.i) filter (b.line is null) as kept,
        count(b.line) as n_dropped
      from l left join b on l.source is not distinct from b.source and l.line = b.line group by 1)
select d.doc_id, d.source, cast(k.n_dropped as bigint) as n_dropped,
       case when d.text is null then null else coalesce(k.kept, '') end as text
from documents d join k on d.doc_id = k.doc_id"""

OP9_SQL = """with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents),
g as (select x, max(doc_id) as keep_id, count(*) as group_size from d group by 1)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, sha256(d.x) as text_sha256 from d join g on d.x = g.x"""

# crc32 by its table (reflected polynomial 0xEDB88320), one byte a step; near words by equal deletions
OP11_SQL = """with recursive tab as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as tab),
r as (select doc_id, run, count(*) as c from (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as run from documents)
  where length(run) >= 5 group by 1, 2),
x as (select run, c, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run)) as x from r),
h as (select run, c, xor(list_reduce(list_transform(range(0, len(x), 2), lambda i: cast('0x' || substr(x, i + 1, 2) as bigint)),
        lambda s, b: xor(s >> 8, tab[xor(s, b) % 256 + 1]), 4294967295), 4294967295) as h from x, tab),
v as (select word, cast(sum(c) as bigint) as n from (
  select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, c from h)
  where length(word) >= 5 group by 1 having sum(c) >= 3),
del as (select word, n, length(word) as l, i, substr(word, 1, i - 1) || substr(word, i + 1) as d from (select word, n, unnest(range(1, length(word) + 1)) as i from v)),
near as (select a.word, b.word as near, b.n as near_n from del a join del b on a.l = b.l and a.i = b.i and a.d = b.d and a.word <> b.word
  union all select distinct del.word, v.word, v.n from del join v on del.d = v.word
  union all select distinct v.word, del.word, del.n from del join v on del.d = v.word),
best as (select word, near, near_n, count(*) over (partition by word) as n_near from near
  qualify row_number() over (partition by word order by near_n desc, near) = 1),
f as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when near_n >= 2 * v.n then near end as form, case when near_n >= 2 * v.n then near_n end as form_n
  from v left join best on v.word = best.word),
chain as (select word, word as root from f union all select chain.word, f.form from chain join f on chain.root = f.word where f.form is not null),
root as (select chain.word, chain.root from chain join f on chain.root = f.word where f.form is null)
select f.word, f.form, root.root, f.n, cast(f.n_near as bigint) as n_near, f.form_n from f join root on f.word = root.word"""

OP12_SQL = """with w as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, w, unnest(range(1, len(w) - 48)) as i from w where len(w) >= 50),
h as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from s),
f as (select h, min(doc_id) as first from h group by 1),
c as (select distinct doc_id, unnest(range(i, i + 50)) as p from h join f on h.h = f.h and f.first < h.doc_id),
g as (select doc_id, list(p) as ps from c group by 1),
k as (select w.doc_id, len(w) as n, coalesce(len(ps), 0) as gone,
        case when ps is null then w else list_filter(w, lambda x, i: not list_contains(ps, i)) end as kept from w left join g on w.doc_id = g.doc_id)
select doc_id, cast(n as bigint) as n_words, cast(gone as bigint) as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from k"""

ORACLES = {"op12_substring_dedup": OP12_SQL, "op11_spelling_groups": OP11_SQL, "op2_mixing": OP2_SQL, "op5_blob_ledger": OP5_SQL, "op6_line_dedup": OP6_SQL, "op9_exact_dedup": OP9_SQL}
