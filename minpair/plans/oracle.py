"""DuckDB SQL for the correctness check: each text computes, independently of
the Spark code, what one registered query returns (same column names).

Tables ``conversations documents embeddings events lineitem ...`` are views.
The fixture definitions are shared CTE snippets below.
"""

from __future__ import annotations

from minpair.sources.dims import SUITE67_PARADIGMS, T_CRITICAL_090, SUITE23_PARADIGMS
from minpair.functions.text import PHENOMENON_ABBREVIATIONS, TITLE_ABBREVIATIONS


def _str_list(items) -> str:
    return "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in items) + "]"


SUITE23_NAMES = _str_list([p for p, _ in SUITE23_PARADIGMS])

FX1 = """fx1 as (
  select concat('p', cast(conv_id % 23 as varchar)) as paradigm,
         cast(row_number() over (partition by conv_id % 23 order by conv_id, turn) - 1 as bigint) as line_no,
         replace(text, chr(10), ' ') as sentence, conv_id, turn
  from conversations)"""

FX2 = f"""fx2 as (
  select model, corpora, rep, concat(model, '/', corpora, '/', cast(rep as varchar)) as path,
         scoring_method, paradigm, accuracy
  from (
    select event_type as model,
           concat('c', cast(user_id % 3 as varchar)) as corpora,
           cast(event_id % 4 as int) as rep,
           case when cast(floor(event_id / 4) as bigint) % 2 = 0 then 'mlm' else 'holistic' end as scoring_method,
           {SUITE23_NAMES}[cast(cast(floor(event_id / 8) as bigint) % 23 as int) + 1] as paradigm,
           max(least(value, 100.0)) as accuracy
    from events group by 1, 2, 3, 4, 5))"""

FX3 = """fx3 as (
  select cast(floor(vec_id / 8) as bigint) as sent_id, cast(vec_id % 8 as int) as pos,
         cast(4 + cast(floor(vec_id / 8) as bigint) % 5 as int) as valid_length, label,
         list_transform(embedding, lambda v: cast(v as double)) as logits
  from embeddings)"""

FX4 = """fx4 as (
  select concat('p', cast(l_suppkey % 67 as varchar)) as paradigm,
         cast(row_number() over (partition by l_suppkey % 67
              order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as bigint) as line_no,
         l_extendedprice as score
  from lineitem)"""

FX5 = """fx5 as (
  select cast(conv_id as bigint) * 1000000000 + turn as sent_id, lower(replace(text, chr(10), ' ')) as sentence from conversations
  union all select -1, '')"""

FX6 = """fx6 as (
  select concat('param_', lpad(cast(doc_id % 10 as varchar), 3, '0')) as param_name,
         concat('/runs/param_', lpad(cast(doc_id % 10 as varchar), 3, '0'), '/', source, '/',
                cast(doc_id as varchar), '/saves/') as path,
         lang, source, doc_id
  from documents)"""

# FX7: training lines + pairs, and the count model (lam = 0.5).
def _sep(unit: str) -> str:
    return "''" if unit == "char" else "' '"


def model_ctes(unit: str = "char", prefix: str = "") -> str:
    """CTEs train, tri (l,t,r,c_ltr), ctx (l,r,c_lr), uni (t,c_t), tot (n, v),
    each name preceded by ``prefix``."""
    p = prefix
    return f"""{p}train as (
  select line as sentence from (select unnest(string_split(lower(text), chr(10))) as line from documents)
  where line <> ''),
{p}train_tok as (
  select ['<s>'] || string_split(sentence, {_sep(unit)}) || ['</s>'] as a from {p}train),
{p}tri as (
  select a[i] as l, a[i + 1] as t, a[i + 2] as r, count(*) as c_ltr
  from (select a, unnest(range(1, len(a) - 1)) as i from {p}train_tok) group by 1, 2, 3),
{p}ctx as (select l, r, sum(c_ltr) as c_lr from {p}tri group by 1, 2),
{p}uni as (select t, sum(c_ltr) as c_t from {p}tri group by 1),
{p}tot as (select cast(sum(c_t) as double) as n, cast(count(*) + 1 as double) as v from {p}uni)"""


FX7_TRAIN = model_ctes("char")

FX7_PAIRS = FX1 + """,
pairs as (
  select paradigm, 2 * line_no as line_no, lower(sentence) as sentence from fx1
  union all
  select paradigm, 2 * line_no + 1,
         concat(substr(s, 1, k - 1), substr(s, k + 1, 1), substr(s, k, 1), substr(s, k + 2))
  from (select paradigm, line_no, lower(sentence) as s, cast(floor(length(lower(sentence)) / 2) as int) as k from fx1))"""


def logprob_sql(prefix: str = "") -> str:
    p = prefix
    return f"""ln(0.5 * coalesce(cast({p}tri.c_ltr as double) / {p}ctx.c_lr, 0.0)
               + 0.5 * (cast(coalesce({p}uni.c_t, 0) as double) + 1.0) / ({p}tot.n + {p}tot.v))"""


LOGPROB_SQL = logprob_sql()


def count_model_token_scores(source: str, keys: str, max_tokens: int | None = None,
                             unit: str = "char", prefix: str = "") -> str:
    """CTEs q_tok (keys, pos, l, t, r) and q_lp (keys, pos, ..., logprob) for
    sentences in CTE ``source`` (columns keys + sentence); names preceded by
    ``prefix``, model CTEs with the same prefix."""
    sep, p = _sep(unit), prefix
    guard = f"and len(string_split(sentence, {sep})) + 2 <= {max_tokens}" if max_tokens else ""
    return f"""{p}q_tok as (
  select {keys}, i - 1 as pos, a[i] as l, a[i + 1] as t, a[i + 2] as r
  from (select {keys}, a, unnest(range(1, len(a) - 1)) as i
        from (select {keys}, ['<s>'] || string_split(sentence, {sep}) || ['</s>'] as a
              from {source} where sentence <> '' {guard}))),
{p}q_lp as (
  select q.*, {logprob_sql(p)} as logprob
  from {p}q_tok q
  left join {p}tri on q.l = {p}tri.l and q.t = {p}tri.t and q.r = {p}tri.r
  left join {p}ctx on q.l = {p}ctx.l and q.r = {p}ctx.r
  left join {p}uni on q.t = {p}uni.t
  cross join {p}tot)"""


def _score_parts_sql(x: str, agg: str) -> str:
    big = f"(({x}) * 1e6)"
    return f"({agg}(round({big})) / 1e6 + {agg}(round(({big} - round({big})) * 1e9)) / 1e15)"


def score_sum_sql(x: str) -> str:
    """Sum of token scores in two whole parts, exact in any order."""
    return _score_parts_sql(x, "sum")


def score_mean_sql(x: str) -> str:
    return _score_parts_sql(x, "avg")


def pair_accuracy_sql(source: str, keys: str = "", method: str = "mlm") -> str:
    """Accuracy per (keys, paradigm) from CTE ``source`` (keys, paradigm, line_no, score)."""
    k = f"{keys}, " if keys else ""
    op = ">" if method == "mlm" else "<"
    return f"""pr as (
  select {k}paradigm, line_no // 2 as pair_id,
         max(case when line_no % 2 = 0 then score end) as good,
         max(case when line_no % 2 = 1 then score end) as bad,
         count(case when line_no % 2 = 0 then 1 end) as ng,
         count(case when line_no % 2 = 1 then 1 end) as nb
  from {source} group by all),
acc as (
  select {k}paradigm, cast(count(case when ng > 0 and nb > 0 then 1 end) as bigint) as n_pairs,
         cast(count(case when ng > 0 and nb > 0 and not isnan(good) and not isnan(bad)
                          and good {op} bad then 1 end) as bigint) as n_correct
  from pr group by all)"""


def flagship_sql(method: str = "mlm") -> str:
    if method == "mlm":
        score = f"""scores as (
  select p.paradigm, p.line_no, coalesce(s.score, 0.0) as score
  from pairs p left join (select paradigm, line_no, {score_sum_sql('logprob')} as score from q_lp group by 1, 2) s
    on p.paradigm = s.paradigm and p.line_no = s.line_no)"""
    else:
        score = f"""scores as (
  select p.paradigm, p.line_no, s.score
  from pairs p left join (select paradigm, line_no, {score_mean_sql('-logprob')} as score from q_lp group by 1, 2) s
    on p.paradigm = s.paradigm and p.line_no = s.line_no)"""
    return f"""with {FX7_TRAIN},
{FX7_PAIRS},
{count_model_token_scores('pairs', 'paradigm, line_no')},
{score},
{pair_accuracy_sql('scores', method=method)}
select paradigm, n_pairs, n_correct,
       round(cast(n_correct as double) / nullif(cast(n_pairs as double), 0) * 100.0, 4) as accuracy
from acc"""
