"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their DuckDB oracles.

Each query reads whole driver tables through a fixture (``sources.fixtures``)
and applies one operator of the library. Its oracle is an independent SQL
text over the same tables with the same output column names. Final doubles
are rounded to 4 decimals in both, arrays are emitted as joined strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from minpair.functions import arrays as A
from minpair.functions import text as TX
from minpair.functions.numeric import exact_avg
from minpair.operators import accuracy as ACC
from minpair.operators import batches as BT
from minpair.operators import count_model as CM
from minpair.operators import lines as LN
from minpair.operators import results as RS
from minpair.operators import scoring as SC
from minpair.operators import summaries as SM
from minpair.operators import tokens as TK
from minpair.plans import evaluate as EV
from minpair.plans import flagship as fl
from minpair.plans import oracle as sql
from minpair.plans.oracle import FX1, FX2, FX3, FX4
from minpair.plans.oracle import FX5, FX6, LOGPROB_SQL, count_model_token_scores, model_ctes
from minpair.sources import fixtures as fx
from minpair.sources import registry as RG
from minpair.sources import sinks as SK
from minpair.sources import suites as SU
from minpair.sources.dims import SUITE67_PARADIGMS
from minpair.sources.dims import T_CRITICAL_090, SUITE23_PARADIGMS
from minpair.sources.registry import CORPORA_LABELS, PRETRAINED_MODELS
from minpair.sources.tables import read_table
from minpair.streaming import results as SR
from minpair.streaming import scores as SS

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

SUITE23 = [p for p, _ in SUITE23_PARADIGMS]
KEYS = RS.KEYS
KEYS_SQL = ", ".join(KEYS)


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def r4(c):
    return F.round(c, 4)


def arr_str(c, sep: str = " "):
    return F.array_join(F.col(c).cast("array<string>") if isinstance(c, str) else c.cast("array<string>"), sep)


# ---------------------------------------------------------------------------
# Flagship (FX7): count model fitted on documents, pairs from conversations
# ---------------------------------------------------------------------------

@register("flagship_mlm_accuracy", sql.flagship_sql("mlm"))
def q_flagship(spark, sf_dir):
    return fl.flagship(spark, sf_dir, "mlm")


@register("flagship_holistic_accuracy", sql.flagship_sql("holistic"))
def q_flagship_holistic(spark, sf_dir):
    return fl.flagship(spark, sf_dir, "holistic")


# ---------------------------------------------------------------------------
# Pair accuracy (FX4)
# ---------------------------------------------------------------------------

def _acc_sql(method: str) -> str:
    return f"""with {FX4},
{sql.pair_accuracy_sql('fx4', method=method)}
select paradigm, n_pairs, n_correct,
       round(cast(n_correct as double) / nullif(cast(n_pairs as double), 0) * 100.0, 4) as accuracy
from acc"""


@register("pair_accuracy_mlm", _acc_sql("mlm"))
def q_pair_acc_mlm(spark, sf_dir):
    return ACC.pair_accuracy(fx.pair_scores(spark, sf_dir), "mlm")


@register("pair_accuracy_holistic", _acc_sql("holistic"))
def q_pair_acc_hol(spark, sf_dir):
    return ACC.pair_accuracy(fx.pair_scores(spark, sf_dir), "holistic")


# ---------------------------------------------------------------------------
# Results table and summaries (FX2)
# ---------------------------------------------------------------------------

ZDIM_SQL = "zdim as (select * from (values " + ", ".join(
    f"('{p}', '{ph}', {i})" for i, (p, ph) in enumerate(SUITE23_PARADIGMS)) + ") t(paradigm, phenomenon, paradigm_index))"


# exact-decimal mean, as functions.numeric.exact_avg
XAVG = "cast(avg(cast({} as decimal(38,10))) as double)"


def _wide_sql(overall_decimals: int | None = 2) -> str:
    cells = ",\n       ".join(f"max(case when paradigm = '{p}' then accuracy end) as \"{p}\"" for p in SUITE23)
    ov = XAVG.format("accuracy")
    if overall_decimals is not None:
        sc = float(10 ** overall_decimals)
        ov = f"round_even({ov} * {sc}, 0) / {sc}"
    return f"""wide as (
select {KEYS_SQL},
       {cells},
       {ov} as overall
from fx2 group by {KEYS_SQL})"""


def fx2_wide(spark, sf_dir, overall_decimals=2):
    return RS.results_wide(fx.results_long(spark, sf_dir), SUITE23, overall_decimals=overall_decimals)


@register("results_wide", f"with {FX2},\n{_wide_sql()}\nselect * from wide")
def q_results_wide(spark, sf_dir):
    return fx2_wide(spark, sf_dir)


@register("overall_accuracy", f"""with {FX2}
select {KEYS_SQL}, round({XAVG.format('accuracy')}, 4) as overall, count(accuracy) as n_paradigms
from fx2 group by all""")
def q_overall(spark, sf_dir):
    return ACC.overall_accuracy(fx.results_long(spark, sf_dir), KEYS)


@register("filter_method", f"with {FX2}\nselect * from fx2 where scoring_method = 'holistic'")
def q_filter_method(spark, sf_dir):
    return fx.results_long(spark, sf_dir).where(F.col("scoring_method") == "holistic")


@register("results_keys", f"with {FX2},\n{_wide_sql()}\nselect {KEYS_SQL} from wide")
def q_results_keys(spark, sf_dir):
    return fx2_wide(spark, sf_dir).select(*KEYS)


@register("results_unpivot", f"""with {FX2},
{_wide_sql()}
select {KEYS_SQL}, paradigm, accuracy from wide
unpivot include nulls (accuracy for paradigm in ({', '.join('"' + p + '"' for p in SUITE23)}))""")
def q_unpivot(spark, sf_dir):
    return RS.results_unpivot(fx2_wide(spark, sf_dir), SUITE23)


def _old_new(spark, sf_dir):
    long = fx.results_long(spark, sf_dir)
    old = long.where(F.col("rep") < 2)
    new = long.where(F.col("rep") >= 1).withColumn("accuracy", F.least(F.col("accuracy") + 1.0, F.lit(100.0)))
    return old, new


@register("results_dedup", f"""with {FX2},
u as (select *, 0 as src from fx2 where rep < 2
      union all
      select model, corpora, rep, path, scoring_method, paradigm, least(accuracy + 1.0, 100.0), 1 from fx2 where rep >= 1)
select {KEYS_SQL}, paradigm, accuracy from (
  select *, row_number() over (partition by {KEYS_SQL}, paradigm order by src) as rn from u) where rn = 1""")
def q_dedup(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return RS.results_dedup(old, new, KEYS + ["paradigm"])


_OLD_COLS, _NEW_COLS = SUITE23[:12], SUITE23[8:]


def _part_wide_sql(name, where, cols, adj):
    cells = ", ".join(f"max(case when paradigm = '{p}' then {adj} end) as \"{p}\"" for p in cols)
    return f"{name} as (select {KEYS_SQL}, {cells} from fx2 where {where} group by {KEYS_SQL})"


@register("results_union", f"""with {FX2},
{_part_wide_sql('o', 'rep < 2', _OLD_COLS, 'accuracy')},
{_part_wide_sql('n', 'rep >= 1', _NEW_COLS, 'least(accuracy + 1.0, 100.0)')}
select * from o union all by name select * from n""")
def q_union(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    o = old.groupBy(*KEYS).pivot("paradigm", _OLD_COLS).agg(F.max("accuracy"))
    n = new.groupBy(*KEYS).pivot("paradigm", _NEW_COLS).agg(F.max("accuracy"))
    return RS.results_union([o, n])


@register("method_pivot", f"""with {FX2},
{_wide_sql()}
select concat(model, '+', corpora) as group_name,
       case when starts_with(concat(model, '+', corpora), 'view') then path else cast(rep as varchar) end as idx,
       max(case when scoring_method = 'holistic' then overall end) as holistic,
       max(case when scoring_method = 'mlm' then overall end) as mlm
from wide group by 1, 2""")
def q_method_pivot(spark, sf_dir):
    return RS.method_pivot(fx2_wide(spark, sf_dir), "view")


@register("phenomenon_join", f"""with {FX2}, {ZDIM_SQL}
select {KEYS_SQL}, fx2.paradigm, phenomenon, accuracy from fx2 join zdim using (paradigm)""")
def q_ph_join(spark, sf_dir):
    return RS.phenomenon_join(fx.results_long(spark, sf_dir)).select(*KEYS, "paradigm", "phenomenon", "accuracy")


@register("unscored_pairs_anti", f"""with {FX2},
runs as (select distinct model, corpora, rep, path from fx2),
req as (select runs.*, m.scoring_method, z.paradigm from runs,
        (values ('mlm'), ('holistic')) m(scoring_method),
        (select distinct paradigm from fx2) z)
select * from req anti join fx2 using ({KEYS_SQL}, paradigm)""")
def q_unscored(spark, sf_dir):
    long = fx.results_long(spark, sf_dir)
    runs = long.select("model", "corpora", "rep", "path").distinct()
    paradigms = long.select("paradigm").distinct()
    grid = ACC.evaluation_grid(runs, ["mlm", "holistic"], paradigms)
    return RS.unscored(grid, long, KEYS + ["paradigm"])


def _ph_acc_sql():
    return f"""ph as (
  select {KEYS_SQL}, phenomenon, round_even({XAVG.format('accuracy')} * 10.0, 0) / 10.0 as accuracy
  from fx2 join zdim using (paradigm) group by all)"""


@register("phenomenon_accuracy", f"with {FX2}, {ZDIM_SQL},\n{_ph_acc_sql()}\nselect * from ph")
def q_ph_acc(spark, sf_dir):
    return SM.phenomenon_accuracy(fx.results_long(spark, sf_dir))


def _ph_reps_sql(how: str) -> str:
    agg = XAVG.format("accuracy") if how == "avg" else "max(accuracy)"
    counts: dict[str, int] = {}
    for _, p in SUITE23_PARADIGMS:
        counts[p] = counts.get(p, 0) + 1
    wsql = "(values " + ", ".join(f"('{k}', {float(v)})" for k, v in counts.items()) + ") w(phenomenon, w)"
    return f"""with {FX2}, {ZDIM_SQL},
{_ph_acc_sql()},
per as (select model, corpora, scoring_method, phenomenon, {agg} as value from ph group by all)
select model, corpora, scoring_method,
       round_even(cast(sum(cast(value as decimal(38,10)) * cast(case when value is not null then w end as decimal(20,0))) as double)
                  / cast(sum(case when value is not null then w end) as double) * 10.0, 0) / 10.0 as overall
from per join {wsql} using (phenomenon) group by all"""


@register("phenomenon_mean_over_reps", _ph_reps_sql("avg"))
def q_ph_mean(spark, sf_dir):
    return SM.phenomenon_over_reps(fx.results_long(spark, sf_dir), how="mean")


@register("phenomenon_max_over_reps", _ph_reps_sql("max"))
def q_ph_max(spark, sf_dir):
    return SM.phenomenon_over_reps(fx.results_long(spark, sf_dir), how="max")


def _rhe(x: str, d: int) -> str:
    return f"round_even(({x}) * {float(10 ** d)}, 0) / {float(10 ** d)}"


@register("replication_summary", f"""with {FX2},
{_wide_sql()}
select model, corpora, scoring_method, {_rhe('min(overall)', 1)} as min, {_rhe('max(overall)', 1)} as max,
       {_rhe(XAVG.format('overall'), 1)} as mean, count(overall) as count
from wide group by all""")
def q_rep_summary(spark, sf_dir):
    return SM.replication_summary(fx2_wide(spark, sf_dir))


@register("replication_rollup", f"""with {FX2},
{_wide_sql()}
select model, corpora, scoring_method, round(sum(overall), 4) as sum_overall, count(overall) as count,
       cast(grouping(model, corpora, scoring_method) as bigint) as level
from wide group by rollup (model, corpora, scoring_method)""")
def q_rollup(spark, sf_dir):
    return SM.replication_rollup(fx2_wide(spark, sf_dir))


@register("best_replication", f"""with {FX2},
{_wide_sql()}
select model, corpora, scoring_method, overall as best_overall, rep as best_rep, path as best_path from (
  select *, row_number() over (partition by model, corpora, scoring_method
                               order by overall desc nulls last, rep desc, path desc) as rn from wide)
where rn = 1""")
def q_best_rep(spark, sf_dir):
    return SM.best_replication(fx2_wide(spark, sf_dir))


@register("group_names", f"with {FX2}\nselect distinct concat(model, '+', corpora) as group_name from fx2")
def q_group_names(spark, sf_dir):
    return SM.group_names(fx.results_long(spark, sf_dir))


RM_SQL = """rm as (
  select concat(model, '+', corpora) as group_name, rep, path,
         cast(avg(cast(accuracy as decimal(38,10))) as double) as accuracy
  from fx2 where scoring_method = 'holistic' group by all)"""

TCRIT_SQL = "tc as (select * from (values " + ", ".join(
    f"({k}, {v})" for k, v in T_CRITICAL_090) + ") t(df, t))"


def _moe_sql(src: str, value: str, keys: str, rounded: bool = True) -> str:
    mean, margin = "s.mean", "case when s.n > 1 then s.sd / sqrt(s.n) * tc.t end"
    if rounded:
        mean, margin = f"round({mean}, 4)", f"round({margin}, 4)"
    return f"""select {', '.join('s.' + k.strip() for k in keys.split(','))}, {mean} as accuracy, s.n, {margin} as margin
from (select {keys}, cast(avg(cast({value} as decimal(38,10))) as double) as mean, count({value}) as n, stddev_samp({value}) as sd
      from {src} group by all) s
left join tc on tc.df = s.n - 1"""


@register("rep_means", f"with {FX2}, {RM_SQL}\nselect group_name, rep, path, round(accuracy, 4) as accuracy from rm")
def q_rep_means(spark, sf_dir):
    r = SM.rep_means(fx.results_long(spark, sf_dir), "holistic")
    return r.withColumn("accuracy", r4(F.col("accuracy")))


def _r4_cols(df, cols):
    for c in cols:
        df = df.withColumn(c, r4(F.col(c)))
    return df


@register("margin_of_error_reps", f"with {FX2}, {RM_SQL}, {TCRIT_SQL}\n" + _moe_sql("rm", "accuracy", "group_name"))
def q_moe_reps(spark, sf_dir):
    return _r4_cols(SM.margin_of_error_reps(fx.results_long(spark, sf_dir), "holistic"), ["accuracy", "margin"])


@register("paradigm_mean_moe", f"""with {FX2}, {TCRIT_SQL},
f as (select concat(model, '+', corpora) as group_name, paradigm, accuracy from fx2 where scoring_method = 'holistic')
""" + _moe_sql("f", "accuracy", "group_name, paradigm"))
def q_par_moe(spark, sf_dir):
    return _r4_cols(SM.paradigm_mean_moe(fx.results_long(spark, sf_dir), "holistic"), ["accuracy", "margin"])


PM_SQL = """pm as (
  select concat(model, '+', corpora) as group_name, paradigm,
         cast(avg(cast(accuracy as decimal(38,10))) as double) as paradigm_accuracy
  from fx2 where scoring_method = 'holistic' group by all)"""


@register("margin_of_error_paradigms", f"with {FX2}, {PM_SQL}, {TCRIT_SQL}\n"
          + _moe_sql("pm", "paradigm_accuracy", "group_name"))
def q_moe_par(spark, sf_dir):
    return _r4_cols(SM.margin_of_error_paradigms(fx.results_long(spark, sf_dir), "holistic"), ["accuracy", "margin"])


@register("box_stats", f"""with {FX2}, {PM_SQL},
q as (select group_name, count(paradigm_accuracy) as n, cast(avg(cast(paradigm_accuracy as decimal(38,10))) as double) as mean,
             quantile_cont(paradigm_accuracy, 0.25) as q1, quantile_cont(paradigm_accuracy, 0.5) as median,
             quantile_cont(paradigm_accuracy, 0.75) as q3 from pm group by all),
w as (select q.*, min(case when x >= q1 - 1.5 * (q3 - q1) then x end) as lo,
                  max(case when x <= q3 + 1.5 * (q3 - q1) then x end) as hi
      from q join (select group_name, paradigm_accuracy as x from pm) using (group_name)
      group by all)
select group_name, n, round(mean, 4) as mean, round(q1, 4) as q1, round(median, 4) as median, round(q3, 4) as q3,
       round(case when lo is null or lo > q1 then q1 else lo end, 4) as whislo,
       round(case when hi is null or hi < q3 then q3 else hi end, 4) as whishi, cast(50.0 as double) as chance
from w""")
def q_box(spark, sf_dir):
    return _r4_cols(SM.box_stats(fx.results_long(spark, sf_dir), "holistic"),
                    ["mean", "q1", "median", "q3", "whislo", "whishi"])


@register("report_lines", f"""with {FX2}, {RM_SQL}, {TCRIT_SQL},
m as ({_moe_sql("rm", "accuracy", "group_name", rounded=False)})
select group_name,
  concat(case when length(group_name) >= 64 then group_name else rpad(group_name, 64, '.') end,
         'accuracy=', printf('%.2f', {_rhe('accuracy', 2)}),
         ' n=', lpad(cast(n as varchar), 2, ' '),
         ' margin-of-error=', lpad(coalesce(printf('%.2f', {_rhe('margin', 2)}), 'nan'), 8, ' ')) as line
from m""")
def q_report(spark, sf_dir):
    return SM.report_lines(fx.results_long(spark, sf_dir), "holistic")


@register("phenomenon_paradigms", f"""with {FX2}, {ZDIM_SQL}
select phenomenon, array_to_string(list_sort(list(paradigm)), ', ') as paradigms, count(*) as n_paradigms
from (select distinct paradigm from fx2) join zdim using (paradigm) group by all""")
def q_ph_paradigms(spark, sf_dir):
    return SM.phenomenon_paradigms(fx.results_long(spark, sf_dir))


@register("round_half_even", f"""with {FX2}
select {KEYS_SQL}, paradigm, {_rhe('accuracy / 8.0', 1)} as acc1, {_rhe('accuracy / 8.0', 2)} as acc2,
       {_rhe('accuracy / 8.0', 3)} as acc3 from fx2""")
def q_rhe(spark, sf_dir):
    long = fx.results_long(spark, sf_dir)
    x = F.col("accuracy") / 8.0
    return long.select(*KEYS, "paradigm", TX.round_half_even(x, 1).alias("acc1"),
                       TX.round_half_even(x, 2).alias("acc2"), TX.round_half_even(x, 3).alias("acc3"))


def _names_sql(expr: str, alias: str) -> str:
    return f"""with {FX2}, {ZDIM_SQL}
select distinct paradigm, phenomenon, {expr} as {alias}
from (select distinct paradigm from fx2) join zdim using (paradigm)"""


def _names(spark, sf_dir):
    return RS.phenomenon_join(fx.results_long(spark, sf_dir).select("paradigm").distinct())


def _chain_sql(col: str, pairs) -> str:
    out = col
    for a, b in pairs:
        out = f"replace({out}, '{a}', '{b}')"
    return out


@register("shorten_phenomenon", _names_sql(_chain_sql("phenomenon", TX.PHENOMENON_ABBREVIATIONS), "short"))
def q_shorten_ph(spark, sf_dir):
    return _names(spark, sf_dir).select("paradigm", "phenomenon", TX.shorten_phenomenon("phenomenon").alias("short"))


@register("paradigm_title", _names_sql(
    _chain_sql("replace(concat(phenomenon, chr(10), paradigm), '_', ' ')", TX.TITLE_ABBREVIATIONS), "title"))
def q_title(spark, sf_dir):
    return _names(spark, sf_dir).select("paradigm", "phenomenon", TX.paradigm_title("phenomenon", "paradigm").alias("title"))


@register("paradigm_label", _names_sql("ltrim(ltrim(replace(paradigm, '_', ' '), phenomenon), '-')", "label"))
def q_label(spark, sf_dir):
    return _names(spark, sf_dir).select("paradigm", "phenomenon", TX.paradigm_label("paradigm", "phenomenon").alias("label"))


# ---------------------------------------------------------------------------
# Array scoring on logits (FX3)
# ---------------------------------------------------------------------------

LSE = "(list_max(logits) + ln(list_sum(list_transform(logits, lambda v: exp(v - list_max(logits))))))"


@register("label_gather", f"with {FX3}\nselect sent_id, pos, label, round(logits[label + 1], 4) as label_logit from fx3")
def q_label_gather(spark, sf_dir):
    d = fx.logits(spark, sf_dir)
    return d.select("sent_id", "pos", "label", r4(A.label_gather("logits", "label")).alias("label_logit"))


@register("log_softmax", f"""with {FX3}
select sent_id, pos, round({LSE}, 4) as log_norm, round(logits[label + 1] - {LSE}, 4) as label_logprob,
       round(list_sum(list_transform(logits, lambda v: v - {LSE})), 4) as logprob_sum
from fx3""")
def q_log_softmax(spark, sf_dir):
    d = fx.logits(spark, sf_dir).withColumn("lsm", A.log_softmax("logits"))
    return d.select("sent_id", "pos", r4(A.log_norm("logits")).alias("log_norm"),
                    r4(A.label_gather("lsm", "label")).alias("label_logprob"),
                    r4(F.aggregate("lsm", F.lit(0.0), lambda a, v: a + v)).alias("logprob_sum"))


@register("token_cross_entropy", f"with {FX3}\nselect sent_id, pos, round({LSE} - logits[label + 1], 4) as ce from fx3")
def q_token_ce(spark, sf_dir):
    d = fx.logits(spark, sf_dir)
    return d.select("sent_id", "pos", r4(A.token_cross_entropy("logits", "label")).alias("ce"))


@register("holistic_scores", f"""with {FX3}
select sent_id, round(avg({LSE} - logits[label + 1]), 4) as score from fx3 where pos < valid_length group by sent_id""")
def q_holistic_scores(spark, sf_dir):
    from minpair.operators.scoring import holistic_from_token_loss
    d = fx.logits(spark, sf_dir).withColumn("ce", A.token_cross_entropy("logits", "label"))
    s = holistic_from_token_loss(d, ["sent_id"])
    return s.withColumn("score", r4(F.col("score")))


@register("argmax_predictions", f"""with {FX3}
select sent_id, pos, label, cast(list_position(logits, list_max(logits)) - 1 as int) as predicted from fx3""")
def q_argmax(spark, sf_dir):
    d = fx.logits(spark, sf_dir)
    return d.select("sent_id", "pos", "label", A.argmax("logits").alias("predicted"))


@register("topk_tokens", f"""with {FX3}
select sent_id, pos, array_to_string(list_transform(list_slice(list_sort(
         list_transform(logits, lambda v, i: {{'neg': -v, 'i': i - 1}})), 1, 5), lambda s: s.i), ',') as top5
from fx3""")
def q_topk(spark, sf_dir):
    d = fx.logits(spark, sf_dir)
    return d.select("sent_id", "pos", arr_str(A.topk_indices("logits", 5), ",").alias("top5"))


@register("attention_mask", f"""with {FX3}
select sent_id, valid_length,
       array_to_string(list_transform(range(8), lambda i: case when i < valid_length then 1 else 0 end), '') as mask
from (select distinct sent_id, valid_length from fx3)""")
def q_attention(spark, sf_dir):
    from minpair.operators.batches import attention_mask
    d = fx.logits(spark, sf_dir).select("sent_id", "valid_length").distinct()
    m = F.transform(attention_mask("valid_length", 8), lambda b: F.when(b, "1").otherwise("0"))
    return d.select("sent_id", "valid_length", F.array_join(m, "").alias("mask"))


# ---------------------------------------------------------------------------
# Suite lines (FX1)
# ---------------------------------------------------------------------------

@register("lower_case_lines", f"with {FX1}\nselect paradigm, line_no, lower(sentence) as sentence from fx1")
def q_lower(spark, sf_dir):
    s = fx.suite_lines(spark, sf_dir)
    return s.select("paradigm", "line_no", TX.lower_case_lines("sentence", True).alias("sentence"))


@register("word_counts", f"""with {FX1}
select paradigm, line_no, cast(len(string_split(sentence, ' ')) as int) as n_words,
       cast(max(len(string_split(sentence, ' '))) over (partition by paradigm) as int) as max_words from fx1""")
def q_word_counts(spark, sf_dir):
    w = LN.word_counts(fx.suite_lines(spark, sf_dir))
    mx = w.groupBy("paradigm").agg(F.max("n_words").alias("max_words"))
    return w.join(mx, "paradigm").select("paradigm", "line_no", "n_words", "max_words")


@register("fixed_batches", f"""with {FX1}
select paradigm, cast(floor(line_no / 10) as bigint) as batch_id, count(*) as n_lines,
       min(line_no) as first_line, max(line_no) as last_line from fx1 group by all""")
def q_fixed_batches(spark, sf_dir):
    b = LN.fixed_batches(fx.suite_lines(spark, sf_dir))
    return b.groupBy("paradigm", "batch_id").agg(F.count(F.lit(1)).alias("n_lines"),
                                                 F.min("line_no").alias("first_line"),
                                                 F.max("line_no").alias("last_line"))


@register("swap_pair_order", f"""with {FX1}
select paradigm, xor(line_no, 1) as line_no, sentence from (
  select *, count(*) over (partition by paradigm) as n from fx1) where line_no < n - n % 2""")
def q_swap(spark, sf_dir):
    return LN.swap_pair_order(fx.suite_lines(spark, sf_dir).select("paradigm", "line_no", "sentence"))


@register("swap_invariants", f"""with {FX1},
sw as (select paradigm, sentence from (select *, count(*) over (partition by paradigm) as n from fx1)
       where line_no < n - n % 2),
b as (select paradigm, count(*) as n_before, count(distinct sentence) as distinct_before from fx1 group by 1),
a as (select paradigm, count(*) as n_after, count(distinct sentence) as distinct_after from sw group by 1),
mi as (select paradigm, count(*) as n_missing from (select paradigm, sentence from fx1 except all select * from sw) group by 1),
ex as (select paradigm, count(*) as n_extra from (select * from sw except all select paradigm, sentence from fx1) group by 1)
select paradigm, coalesce(n_before, 0) as n_before, coalesce(n_after, 0) as n_after,
       coalesce(distinct_before, 0) as distinct_before, coalesce(distinct_after, 0) as distinct_after,
       coalesce(n_missing, 0) as n_missing, coalesce(n_extra, 0) as n_extra
from b full join a using (paradigm) left join mi using (paradigm) left join ex using (paradigm)""")
def q_swap_inv(spark, sf_dir):
    s = fx.suite_lines(spark, sf_dir).select("paradigm", "line_no", "sentence")
    return LN.swap_invariants(s, LN.swap_pair_order(s))


@register("line_count_violations", f"""with {FX1}
select paradigm, count(*) as n_lines, cast(4000 as bigint) as expected_lines, count(*) % 2 = 1 as odd
from fx1 group by 1""")
def q_violations(spark, sf_dir):
    return LN.line_count_violations(fx.suite_lines(spark, sf_dir), 4000)


# ---------------------------------------------------------------------------
# Tokens, vocabulary, masking, batches (FX5, word tokens)
# ---------------------------------------------------------------------------


VOCAB_SQL = f"""{FX5},
v_tok as (select sent_id, unnest(string_split(sentence, ' ')) as token,
                 unnest(generate_series(0, len(string_split(sentence, ' ')) - 1)) as pos
          from fx5 where sentence <> ''),
vocab as (
  select token, cast(row_number() over (order by count(*) desc, token) + 4 as bigint) as token_id,
         count(*) as count from v_tok group by token
  union all
  select * from (values ('<s>', 0, 0), ('<pad>', 1, 0), ('</s>', 2, 0), ('<unk>', 3, 0), ('<mask>', 4, 0))
    r(token, token_id, count)),
enc_t as (select t.sent_id, list(coalesce(v.token_id, 3) order by t.pos) as ids
          from v_tok t left join vocab v using (token) group by t.sent_id),
enc as (select f.sent_id, f.sentence, [0::bigint] || coalesce(e.ids, []::bigint[]) || [2::bigint] as ids
        from fx5 f left join enc_t e using (sent_id))"""


def fx5_encoded(spark, sf_dir):
    s = fx.sentences(spark, sf_dir)
    vocab = TK.vocab_build(s, unit="word")
    return s, vocab, TK.encode(s, vocab, ["sent_id"])


@register("vocab_build", f"with {VOCAB_SQL}\nselect token, token_id, count from vocab")
def q_vocab(spark, sf_dir):
    return TK.vocab_build(fx.sentences(spark, sf_dir), unit="word").table


@register("encode_tokens", f"""with {VOCAB_SQL}
select sent_id, array_to_string(ids, ' ') as token_ids, cast(len(ids) as int) as n_ids from enc""")
def q_encode(spark, sf_dir):
    _, _, enc = fx5_encoded(spark, sf_dir)
    return enc.select("sent_id", arr_str("token_ids").alias("token_ids"), F.size("token_ids").alias("n_ids"))


@register("decode_tokens", f"""with {VOCAB_SQL}
select sent_id, array_to_string(list(token order by pos), ' ') as decoded from (
  select sent_id, unnest(ids) as token_id, unnest(generate_series(0, len(ids) - 1)) as pos from enc)
join vocab using (token_id) group by sent_id""")
def q_decode(spark, sf_dir):
    _, vocab, enc = fx5_encoded(spark, sf_dir)
    d = TK.decode(enc, vocab, ["sent_id"])
    return d.groupBy("sent_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(
        F.struct("pos", "token"))), lambda s: s["token"]), " ").alias("decoded"))


@register("masked_copies", f"""with {VOCAB_SQL}
select sent_id, cast(i - 1 as int) as mask_pos, ids[i] as label,
       array_to_string(list_transform(ids, lambda x, j: case when j = i then 4 else x end), ' ') as token_ids,
       cast(len(ids) as int) as valid_length, 1 as normalization
from (select sent_id, ids, unnest(range(2, len(ids))) as i from enc)""")
def q_masked(spark, sf_dir):
    _, _, enc = fx5_encoded(spark, sf_dir)
    m = TK.masked_copies(enc, ["sent_id"])
    return m.select("sent_id", "mask_pos", "label", arr_str("token_ids").alias("token_ids"),
                    "valid_length", "normalization")


@register("maskable_positions", f"""with {VOCAB_SQL}
select sent_id, cast(i - 1 as int) as pos, ids[i] as token_id
from (select sent_id, ids, unnest(range(2, len(ids))) as i from enc)""")
def q_maskable(spark, sf_dir):
    _, _, enc = fx5_encoded(spark, sf_dir)
    return TK.maskable_positions(enc, ["sent_id"])


@register("length_guard", f"""with {VOCAB_SQL}
select sent_id, cast(len(ids) as int) as n_ids, len(ids) <= 40 as kept from enc""")
def q_length_guard(spark, sf_dir):
    _, _, enc = fx5_encoded(spark, sf_dir)
    return TK.length_guard(enc, 40).select("sent_id", "n_ids", "kept")


@register("true_token_lengths", f"""with {VOCAB_SQL}
select sent_id, cast(len(ids) - 2 as int) as n_tokens from enc where len(ids) > 2""")
def q_true_len(spark, sf_dir):
    _, _, enc = fx5_encoded(spark, sf_dir)
    return TK.true_token_lengths(enc, ["sent_id"])


def _pad_sql(round_to=None):
    width = "max(len(ids)) over (partition by floor(sent_id / 10))"
    if round_to:
        width = f"cast(ceil({width} / {round_to}) * {round_to} as int)"
    return f"""with {VOCAB_SQL}
select sent_id, cast(floor(sent_id / 10) as bigint) as batch_id, cast(len(ids) as int) as valid_length,
       array_to_string(list_resize(ids, {width}, 1), ' ') as padded from enc"""


def _padded(spark, sf_dir, round_to=None):
    _, _, enc = fx5_encoded(spark, sf_dir)
    b = enc.withColumn("batch_id", F.floor(F.col("sent_id") / 10).cast("long"))
    return BT.pad_batch(b, "batch_id", "token_ids", pad_val=1, round_to=round_to)


@register("pad_batch", _pad_sql())
def q_pad(spark, sf_dir):
    return _padded(spark, sf_dir).select("sent_id", "batch_id", "valid_length", arr_str("padded").alias("padded"))


@register("pad_round_to", _pad_sql(8))
def q_pad8(spark, sf_dir):
    return _padded(spark, sf_dir, 8).select("sent_id", "batch_id", "valid_length", arr_str("padded").alias("padded"))


@register("stack_batch", f"""with p as ({_pad_sql()})
select batch_id, array_to_string(list(padded order by sent_id), '|') as stacked, count(*) as n_rows,
       min(len(string_split(padded, ' '))) = max(len(string_split(padded, ' '))) as shape_ok
from p group by batch_id""")
def q_stack(spark, sf_dir):
    s = BT.stack(_padded(spark, sf_dir), "batch_id", "sent_id", "padded")
    return s.select("batch_id", F.array_join(F.transform("stacked", lambda r: F.array_join(r.cast("array<string>"), " ")), "|").alias("stacked"),
                    "n_rows", "shape_ok")


@register("batch_fields", f"""with p as ({_pad_sql()}),
s as ({f"with {VOCAB_SQL} select sent_id, sentence, cast(len(ids) as int) as n_ids from enc"})
select batch_id, array_to_string(list(padded order by sent_id), '|') as token_ids,
       array_to_string(list(n_ids order by sent_id), ' ') as n_ids,
       array_to_string(list(sentence order by sent_id), ' || ') as sentence
from p join s using (sent_id) group by batch_id""")
def q_batch_fields(spark, sf_dir):
    s, _, enc = fx5_encoded(spark, sf_dir)
    b = (enc.join(s, "sent_id").withColumn("batch_id", F.floor(F.col("sent_id") / 10).cast("long"))
            .withColumn("n_ids", F.size("token_ids")))
    out = BT.batch_fields(b, "batch_id", "sent_id", {"token_ids": "pad", "n_ids": "stack", "sentence": "list"},
                          pad_val=1)
    return out.select("batch_id",
                      F.array_join(F.transform("token_ids", lambda r: F.array_join(r.cast("array<string>"), " ")), "|").alias("token_ids"),
                      arr_str("n_ids").alias("n_ids"), F.array_join("sentence", " || ").alias("sentence"))


@register("batch_list", f"""with {FX5}
select cast(floor(sent_id / 10) as bigint) as batch_id,
       array_to_string(list(sentence order by sent_id), ' || ') as sentences from fx5 group by 1""")
def q_batch_list(spark, sf_dir):
    s = fx.sentences(spark, sf_dir).withColumn("batch_id", F.floor(F.col("sent_id") / 10).cast("long"))
    out = BT.batch_fields(s, "batch_id", "sent_id", {"sentence": "list"})
    return out.select("batch_id", F.array_join("sentence", " || ").alias("sentences"))


@register("pad_inner_axis", f"""with {VOCAB_SQL},
w as (select sent_id, cast(floor(sent_id / 10) as bigint) as batch_id, ids, max(len(ids)) over (partition by floor(sent_id / 10)) as n from enc)
select sent_id, batch_id,
       array_to_string(ids || list_transform(range(n - len(ids)), lambda x: 1), ' ') || ' | '
       || array_to_string(ids[2:] || list_transform(range(n - len(ids) + 1), lambda x: 1), ' ') as padded from w""")
def q_pad_inner(spark, sf_dir):
    _, _, enc = fx5_encoded(spark, sf_dir)
    b = (enc.withColumn("batch_id", F.floor(F.col("sent_id") / 10).cast("long"))
            .withColumn("sample", F.array("token_ids", F.slice("token_ids", F.lit(2), F.size("token_ids")))))
    p = BT.pad_inner_axis(b, "batch_id", "sample", pad_val=1)
    return p.select("sent_id", "batch_id", F.array_join(F.transform(
        "padded", lambda r: F.array_join(r.cast("array<string>"), " ")), " | ").alias("padded"))


BUCKET_SQL = f"""e as (select sent_id, cast(len(ids) as int) as n_ids from enc),
lim as (select min(n_ids) as lo, max(n_ids) as hi from e),
b as (select e.*, least(floor((n_ids - lo) / w), 9) as bucket, lo, w from e, lim,
      (select greatest(1, ceil((hi - lo + 1) / 10)) as w from lim) ww),
bb as (select sent_id, n_ids, cast(bucket as int) as bucket,
              cast(greatest(floor((lo + 10 * w - 1) / (lo + (bucket + 1) * w - 1) * 1.0 * 500), 500) as bigint) as bucket_batch_size,
              cast(((sent_id % 8) + 8) % 8 as int) as shard
       from b),
bt as (select *, cast(floor((row_number() over (partition by bucket, shard order by sent_id) - 1) / bucket_batch_size) as bigint) as batch_in_shard
       from bb)"""


def _buckets(spark, sf_dir):
    _, _, enc = fx5_encoded(spark, sf_dir)
    e = enc.select("sent_id", F.size("token_ids").alias("n_ids"))
    return BT.bucketed_batches(e, "n_ids", ["sent_id"], shard=F.pmod(F.col("sent_id"), F.lit(8)).cast("int"))


@register("bucketed_batches", f"""with {VOCAB_SQL}, {BUCKET_SQL}
select sent_id, n_ids, bucket, bucket_batch_size, shard, batch_in_shard from bt""")
def q_buckets(spark, sf_dir):
    return _buckets(spark, sf_dir).select("sent_id", "n_ids", "bucket", "bucket_batch_size", "shard", "batch_in_shard")


@register("bucket_plan", f"""with {VOCAB_SQL}, {BUCKET_SQL}
select cast(bucket as int) as bucket, cast(lo + (bucket + 1) * w - 1 as bigint) as upper_length,
       cast(greatest(floor((lo + 10 * w - 1) / (lo + (bucket + 1) * w - 1) * 500), 500) as bigint) as bucket_batch_size,
       count(*) as n_rows, min(n_ids) as shortest, max(n_ids) as longest, cast(ceil(count(*) / 1000.0) as int) as shards
from b group by bucket, lo, w""")
def q_bucket_plan(spark, sf_dir):
    _, _, enc = fx5_encoded(spark, sf_dir)
    hist = BT.length_histogram(enc.select(F.size("token_ids").alias("n_ids")), "n_ids")
    return BT.bucket_plan(hist, shard_rows=1000)


@register("bucket_stats", f"""with {VOCAB_SQL}, {BUCKET_SQL},
pb as (select bucket, shard, batch_in_shard, count(*) as n, max(n_ids) as mx, sum(n_ids) as tot from bt group by all)
select bucket, cast(sum(n) as bigint) as n_rows, count(*) as n_batches, round(1.0 - sum(tot) / sum(n * mx), 4) as padding_share
from pb group by bucket""")
def q_bucket_stats(spark, sf_dir):
    s = BT.bucket_stats(_buckets(spark, sf_dir), "n_ids")
    return s.withColumn("padding_share", r4(F.col("padding_share")))


# ---------------------------------------------------------------------------
# Count model: fit, token scores, sentence scores (FX7 char, FX5 word)
# ---------------------------------------------------------------------------

def word_model(spark, sf_dir):
    return CM.fit(fx.training_lines(spark, sf_dir), "sentence", "word")


@register("count_mlm_fit", f"with {model_ctes('char')}\nselect l, t, r, c_ltr from tri")
def q_fit(spark, sf_dir):
    return fl.fitted_model(spark, sf_dir).trigrams.select("l", "t", "r", "c_ltr")


@register("count_mlm_token_scores", f"""with {model_ctes('char')},
{sql.FX7_PAIRS},
{count_model_token_scores('pairs', 'paradigm, line_no')}
select paradigm, line_no, cast(pos as int) as pos, t, round(logprob, 4) as logprob from q_lp""")
def q_tok_scores(spark, sf_dir):
    m = fl.fitted_model(spark, sf_dir)
    return CM.token_logprobs(m, fx.minimal_pairs(spark, sf_dir), "sentence", ["paradigm", "line_no"],
                             outer=False, fields=("pos", "t"), decimals=4)


@register("mlm_scores", f"""with {model_ctes('char')},
{sql.FX7_PAIRS},
{count_model_token_scores('pairs', 'paradigm, line_no')}
select p.paradigm, p.line_no, round(coalesce(s.score, 0.0), 4) as score
from pairs p left join (select paradigm, line_no, {sql.score_sum_sql('logprob')} as score from q_lp group by 1, 2) s
  on p.paradigm = s.paradigm and p.line_no = s.line_no""")
def q_mlm_scores(spark, sf_dir):
    s = fl.flagship_scores(spark, sf_dir, "mlm")
    return s.withColumn("score", r4(F.col("score")))


@register("paradigm_accuracy", f"""with {model_ctes('char')},
{sql.FX7_PAIRS},
{count_model_token_scores('pairs', 'paradigm, line_no', None)},
s as (select p.paradigm, p.line_no,
             coalesce({sql.score_sum_sql('q.logprob')}, 0.0) as mlm,
             {sql.score_mean_sql('-q.logprob')} as holistic
      from pairs p left join q_lp q on p.paradigm = q.paradigm and p.line_no = q.line_no group by 1, 2),
scores as (select 'mlm' as scoring_method, paradigm, line_no, mlm as score from s
           union all select 'holistic', paradigm, line_no, holistic from s),
pr as (select scoring_method, paradigm, line_no // 2 as pair_id,
              max(case when line_no % 2 = 0 then score end) as good, max(case when line_no % 2 = 1 then score end) as bad, count(*) as n
       from scores group by all)
select scoring_method, paradigm, count(case when n = 2 then 1 end) as n_pairs,
       count(case when n = 2 and not isnan(good) and not isnan(bad) and
             ((scoring_method = 'mlm' and good > bad) or
              (scoring_method = 'holistic' and good < bad)) then 1 end) as n_correct,
       round(cast(count(case when n = 2 and not isnan(good) and not isnan(bad) and
             ((scoring_method = 'mlm' and good > bad) or
              (scoring_method = 'holistic' and good < bad)) then 1 end) as double)
             / nullif(cast(count(case when n = 2 then 1 end) as double), 0) * 100.0, 4) as accuracy
from pr group by all""")
def q_paradigm_acc(spark, sf_dir):
    m = fl.fitted_model(spark, sf_dir)
    scores = SC.both_scores(m, fx.minimal_pairs(spark, sf_dir), ["paradigm", "line_no"])
    return ACC.pair_accuracy(scores, "scoring_method", keys=["scoring_method"])


@register("pll_with_zero_default", f"""with {model_ctes('word')}, {FX5},
{count_model_token_scores('fx5', 'sent_id', unit='word')}
select f.sent_id, round(coalesce(s.score, 0.0), 4) as score
from fx5 f left join (select sent_id, {sql.score_sum_sql('logprob')} as score from q_lp group by 1) s using (sent_id)""")
def q_pll_zero(spark, sf_dir):
    s = SC.mlm_scores(word_model(spark, sf_dir), fx.sentences(spark, sf_dir), ["sent_id"])
    return s.withColumn("score", r4(F.col("score")))


@register("fill_mask_count", f"""with {model_ctes('word')}, {FX5},
pos as (select sent_id, i - 1 as pos, a[i] as l, a[i + 2] as r
        from (select sent_id, a, unnest(range(1, len(a) - 1)) as i
              from (select sent_id, ['<s>'] || string_split(sentence, ' ') || ['</s>'] as a from fx5 where sentence <> ''))),
top_uni as (select t from uni order by c_t desc, t limit 5),
cand as (select distinct sent_id, pos, l, r, t from (
           select p.sent_id, p.pos, p.l, p.r, tri.t from pos p join tri on p.l = tri.l and p.r = tri.r
           union all select p.sent_id, p.pos, p.l, p.r, u.t from pos p, top_uni u)),
sc as (select c.sent_id, c.pos, c.t, {LOGPROB_SQL} as logprob
       from cand c left join tri on c.l = tri.l and c.t = tri.t and c.r = tri.r
       left join ctx on c.l = ctx.l and c.r = ctx.r left join uni on c.t = uni.t cross join tot)
select sent_id, cast(pos as int) as pos, cast(rank as int) as rank, token, round(logprob, 4) as logprob from (
  select sent_id, pos, t as token, logprob,
         row_number() over (partition by sent_id, pos order by logprob desc, t) as rank from sc)
where rank <= 5""")
def q_fill_mask(spark, sf_dir):
    f = CM.fill_mask(word_model(spark, sf_dir), fx.sentences(spark, sf_dir), "sentence", ["sent_id"], 5)
    return f.withColumn("logprob", r4(F.col("logprob")))


# ---------------------------------------------------------------------------
# Pluggable scorer through mapInPandas (FX3)
# ---------------------------------------------------------------------------

@register("pandas_scorer", f"""with {FX3}
select sent_id, pos, round(logits[label + 1] - {LSE}, 4) as logprob from fx3""")
def q_pandas_scorer(spark, sf_dir):
    from minpair.operators.scorer import LogitsScorer, run_scorer
    out = run_scorer(fx.logits(spark, sf_dir), LogitsScorer(), ["sent_id", "pos"])
    return out.withColumn("logprob", r4(F.col("logprob")))


# A model DuckDB can follow: 64 labels (id modulo 64), logits from the sum of the
# (masked) ids, the position and the label.
TOY_SQL = """lg as (select *, list_transform(range(64), lambda v: ((s * 31 + pos * 17 + v * v * 7) % 101) / 10.0) as z from src),
tok as (select sent_id, pos, z[cast(label % 64 as int) + 1] - ln(list_sum(list_transform(z, lambda x: exp(x)))) as lp from lg)"""


@register("scorer_mlm_scores", f"""with {VOCAB_SQL},
src as (select sent_id, i - 1 as pos, ids[i] as label, list_sum(ids) - ids[i] + 4 as s
        from (select sent_id, ids, unnest(range(2, len(ids))) as i from enc)),
{TOY_SQL}
select enc.sent_id, round(coalesce({sql.score_sum_sql('lp')}, 0.0), 4) as score from enc left join tok on enc.sent_id = tok.sent_id group by 1""")
def q_scorer_mlm(spark, sf_dir):
    from minpair.operators.scorer import ToyModel, scorer_mlm_scores
    _, _, enc = fx5_encoded(spark, sf_dir)
    return scorer_mlm_scores(enc, ToyModel(), ["sent_id"]).withColumn("score", r4(F.col("score")))


@register("scorer_holistic_scores", f"""with {VOCAB_SQL},
src as (select sent_id, i - 1 as pos, ids[i] as label, list_sum(ids) as s
        from (select sent_id, ids, unnest(range(1, len(ids) + 1)) as i from enc)),
{TOY_SQL}
select sent_id, round({sql.score_mean_sql('-lp')}, 4) as score from tok group by 1""")
def q_scorer_holistic(spark, sf_dir):
    from minpair.operators.scorer import ToyModel, scorer_holistic_scores
    _, _, enc = fx5_encoded(spark, sf_dir)
    return scorer_holistic_scores(enc, ToyModel(), ["sent_id"]).withColumn("score", r4(F.col("score")))


# ---------------------------------------------------------------------------
# Registry and runs (FX6)
# ---------------------------------------------------------------------------


def _sql_val(v):
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, list):
        return "[" + ", ".join(_sql_val(x) for x in v) + "]"
    return str(v)


PARAMS_SQL = "par as (select * from (values " + ", ".join(
    "(" + ", ".join(_sql_val(x) for x in row) + ")" for row in fx.RUN_PARAMS) + \
    ") t(param_name, corpora, training_order, consecutive_masking))"


def _label_case(c="corpora", o="training_order", m="consecutive_masking") -> str:
    parts = []
    for arr, order, label in CORPORA_LABELS:
        cond = f"{c} = {_sql_val(arr)}"
        if order is not None:
            cond += f" and {o} = '{order}' and {m}"
        parts.append(f"when {cond} then '{label}'")
    return "case " + " ".join(parts) + " end"


SAVES_RE = "^/runs/param_[0-9]{3,}/(.+/)?saves/$"

REGISTRY_SQL = f"""{FX6}, {PARAMS_SQL},
pre as (select * from (values {', '.join('(' + ', '.join(_sql_val(x) for x in r) + ')' for r in PRETRAINED_MODELS)})
        t(name, corpora, rep, path, case_sensitive, trained_on_lower_cased_data)),
lab as (select param_name, {_label_case()} as corpora from par),
tr as (select '{RG.TRAINED_MODEL_NAME}' as name, lab.corpora,
              cast(row_number() over (partition by fx6.param_name order by path) - 1 as int) as rep, path,
              false as case_sensitive, true as trained_on_lower_cased_data
       from fx6 left join lab using (param_name) where regexp_matches(path, '{SAVES_RE}')),
ck as (select doc_id, concat('RoBERTa-base-', case when doc_id % 3 = 0 then 'AO-CHILDES'
              when doc_id % 3 = 1 then 'Wikipedia-1' else source end) as dir_name from documents),
cv as (select 'RoBERTa-base' as name, case when contains(dir_name, 'AO-CHILDES') then 'AO-CHILDES' else 'Wikipedia-1' end as corpora,
              cast(doc_id % 10 as int) as rep, concat('/fairseq/', dir_name, '/checkpoint_last_', cast(doc_id % 10 as varchar), '.pt') as path,
              true as case_sensitive, true as trained_on_lower_cased_data
       from ck where contains(dir_name, 'AO-CHILDES') or contains(dir_name, 'Wikipedia-1')),
reg as (select * from pre union all select * from tr union all select * from cv)"""


def registry(spark, sf_dir):
    return RG.registry_union(RG.pretrained_registry(spark),
                             RG.trained_registry(fx.runs(spark, sf_dir), fx.run_params(spark)),
                             RG.checkpoint_registry(fx.checkpoint_files(spark, sf_dir).withColumnRenamed("ckpt_path", "path"),
                                                    strict=False))


@register("param_name", """select doc_id, concat('param_', case when doc_id < 1000 then right(concat('00', cast(doc_id as varchar)), 3)
       else cast(doc_id as varchar) end) as param_name from (select doc_id * 7 as doc_id from documents)""")
def q_param_name(spark, sf_dir):
    ids = read_table(spark, sf_dir, "documents", (F.col("doc_id") * 7).alias("doc_id"))
    return ids.select("doc_id", TX.param_name("doc_id").alias("param_name"))


@register("runs_scan", f"with {FX6}\nselect param_name, path from fx6 where regexp_matches(path, '{SAVES_RE}')")
def q_runs_scan(spark, sf_dir):
    return RG.saved_runs(fx.runs(spark, sf_dir)).select("param_name", "path")


@register("replication_numbers", f"""with {FX6}
select param_name, path, cast(row_number() over (partition by param_name order by path) - 1 as bigint) as rep from fx6""")
def q_rep_numbers(spark, sf_dir):
    return RG.replication_numbers(fx.runs(spark, sf_dir).select("param_name", "path"))


@register("select_runs", f"""with {FX6}
select param_name, path from fx6 where param_name in ('param_001', 'param_003', 'param_007')""")
def q_select_runs(spark, sf_dir):
    return RG.select_runs(fx.runs(spark, sf_dir), ["param_001", "param_003", "param_007"]).select("param_name", "path")


@register("shorten_path", f"""with {FX6},
ck as (select doc_id, concat('/fairseq/RoBERTa-base-', case when doc_id % 3 = 0 then 'AO-CHILDES'
              when doc_id % 3 = 1 then 'Wikipedia-1' else source end,
              '/checkpoint_last_', cast(doc_id % 10 as varchar), '.pt') as ckpt_path from documents),
p as (select doc_id, path as p from fx6 union all select doc_id, ckpt_path from ck)
select doc_id, p as path,
       case when starts_with(regexp_extract(p, '([^/]*)/?$', 1), 'checkpoint')
            then (case when starts_with(p, '/fairseq/') then regexp_replace(substr(p, 10), '/$', '') else p end)
            else (case when starts_with(p, '/runs/') then regexp_replace(substr(p, 7), '/$', '') else p end) end as short_path
from p""")
def q_shorten_path(spark, sf_dir):
    runs = fx.runs(spark, sf_dir).select("doc_id", "path")
    ck = fx.checkpoint_files(spark, sf_dir).select("doc_id", F.col("ckpt_path").alias("path"))
    p = runs.unionByName(ck)
    return p.select("doc_id", "path", TX.shorten_path("path", "/fairseq", "/runs").alias("short_path"))


@register("corpora_label", f"""with {FX6}, {PARAMS_SQL}
select param_name, {_label_case()} as corpora from (select distinct param_name from fx6) join par using (param_name)""")
def q_corpora_label(spark, sf_dir):
    names = fx.runs(spark, sf_dir).select("param_name").distinct()
    p = fx.run_params(spark)
    j = names.join(F.broadcast(p), "param_name")
    return j.select("param_name", RG.corpora_label(F.col("corpora"), F.col("training_order"),
                                                   F.col("consecutive_masking")).alias("corpora"))


@register("checkpoint_label", """select doc_id, case when contains(dir_name, 'AO-CHILDES') then 'AO-CHILDES'
       when contains(dir_name, 'Wikipedia-1') then 'Wikipedia-1' end as corpora,
       cast(regexp_extract(file_name, '(\\d)\\.pt$', 1) as int) as rep
from (select doc_id, concat('RoBERTa-base-', case when doc_id % 3 = 0 then 'AO-CHILDES'
              when doc_id % 3 = 1 then 'Wikipedia-1' else source end) as dir_name,
             concat('checkpoint_last_', cast(doc_id % 10 as varchar), '.pt') as file_name from documents)""")
def q_ckpt_label(spark, sf_dir):
    c = fx.checkpoint_files(spark, sf_dir)
    return c.select("doc_id", RG.checkpoint_label(F.col("dir_name")).alias("corpora"),
                    RG.checkpoint_rep(F.col("file_name")).alias("rep"))


@register("registry_union", f"with {REGISTRY_SQL}\nselect * from reg")
def q_registry(spark, sf_dir):
    return registry(spark, sf_dir)


@register("lower_case_flag", f"""with {REGISTRY_SQL}
select name, corpora, rep, path, case_sensitive and trained_on_lower_cased_data as lower_case from reg""")
def q_lower_flag(spark, sf_dir):
    return RG.lower_case_flag(registry(spark, sf_dir)).select("name", "corpora", "rep", "path", "lower_case")


@register("evaluation_grid", f"""with {REGISTRY_SQL}, {FX1}
select name, corpora, rep, path, m.scoring_method, z.paradigm
from reg, (values ('holistic'), ('mlm')) m(scoring_method), (select distinct paradigm from fx1) z""")
def q_grid(spark, sf_dir):
    reg = registry(spark, sf_dir).select("name", "corpora", "rep", "path")
    paradigms = fx.suite_lines(spark, sf_dir).select("paradigm").distinct()
    return ACC.evaluation_grid(reg, ["holistic", "mlm"], paradigms)


# ---------------------------------------------------------------------------
# Sources and sinks (files under the session's checkpoint directory)
# ---------------------------------------------------------------------------


def _written_suite(spark, sf_dir):
    path = SK.scratch_path(spark, "suite-text")
    SU.write_suite_text(fx.suite_lines(spark, sf_dir).select("paradigm", "line_no", "sentence"), path)
    return path


@register("scan_corpus", f"""with {FX1}
select paradigm, line_no, regexp_replace(sentence, '^\\s+|\\s+$', '', 'g') as sentence from fx1""")
def q_scan_corpus(spark, sf_dir):
    return SU.scan_corpus(spark, _written_suite(spark, sf_dir))


@register("scan_suite", f"""with {FX1}
select paradigm, line_no, sentence from fx1
union all select paradigm, max(line_no) + 1, '' from fx1 group by paradigm""")
def q_scan_suite(spark, sf_dir):
    # the text writer ends files with a newline: as written, the last line is empty
    return SU.scan_suite(spark, _written_suite(spark, sf_dir), strict=False)


@register("paradigm_catalog", f"with {FX1}\nselect paradigm, count(*) as n_files from (select distinct paradigm from fx1) group by 1")
def q_catalog(spark, sf_dir):
    c = SU.paradigm_catalog(spark, _written_suite(spark, sf_dir))
    return c.groupBy("paradigm").agg(F.count(F.lit(1)).alias("n_files"))


@register("reordered_suite", f"""with {FX1}
select paradigm, xor(line_no, 1) as line_no, sentence from (
  select *, count(*) over (partition by paradigm) as n from fx1) where line_no < n - n % 2""")
def q_reordered(spark, sf_dir):
    path = SK.scratch_path(spark, "suite-table")
    swapped = LN.swap_pair_order(fx.suite_lines(spark, sf_dir).select("paradigm", "line_no", "sentence"))
    SU.write_suite_table(swapped, path)
    return SU.read_suite_table(spark, path).select("paradigm", "line_no", "sentence")


@register("results_csv_roundtrip", f"with {FX2},\n{_wide_sql()}\nselect * from wide")
def q_csv(spark, sf_dir):
    from pyspark.sql import types as T
    wide = fx2_wide(spark, sf_dir)
    path = SK.scratch_path(spark, "results-csv")
    SK.write_results_csv(wide, path)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in wide.schema.fields])
    return SK.read_results_csv(spark, path, schema)


@register("scored_sentence_lines", f"""with {model_ctes('char')},
{sql.FX7_PAIRS},
{count_model_token_scores('pairs', 'paradigm, line_no', None)}
select printf('%s %.4f', p.sentence, round_even(s.score * 10000.0, 0) / 10000.0) as value
from pairs p join (select paradigm, line_no, {sql.score_mean_sql('-logprob')} as score from q_lp group by 1, 2) s
  on p.paradigm = s.paradigm and p.line_no = s.line_no""")
def q_scored_lines(spark, sf_dir):
    m = fl.fitted_model(spark, sf_dir)
    hol = SC.holistic_scores(m, fx.minimal_pairs(spark, sf_dir), ["paradigm", "line_no", "sentence"])
    path = SK.scratch_path(spark, "scored-lines")
    SK.write_lines(SK.scored_sentence_lines(hol), path)
    return spark.read.text(path)


def _params_with_runs(spark, sf_dir):
    counts = fx.runs(spark, sf_dir).groupBy("param_name").agg(F.count(F.lit(1)).alias("n_runs"))
    return counts.join(F.broadcast(fx.run_params(spark)), "param_name")


@register("params_json")
def q_params_json(spark, sf_dir):
    path = SK.scratch_path(spark, "params-json")
    SK.write_params_json(_params_with_runs(spark, sf_dir), path)
    return spark.read.text(path).select(F.col("value").alias("json"))


@register("params_source", f"""with {FX6}, {PARAMS_SQL}
select param_name, count(*) as n_runs, any_value(training_order) as training_order,
       any_value(consecutive_masking) as consecutive_masking, any_value(array_to_string(corpora, '+')) as corpora
from fx6 join par using (param_name) group by param_name""")
def q_params_source(spark, sf_dir):
    from pyspark.sql import types as T
    path = SK.scratch_path(spark, "params-json")
    SK.write_params_json(_params_with_runs(spark, sf_dir), path)
    schema = T.StructType([T.StructField("n_runs", T.LongType()), T.StructField("corpora", T.ArrayType(T.StringType())),
                           T.StructField("training_order", T.StringType()),
                           T.StructField("consecutive_masking", T.BooleanType()),
                           T.StructField("param_name", T.StringType())])
    p = SK.read_params_json(spark, path, schema)
    return p.select("param_name", "n_runs", "training_order", "consecutive_masking",
                    F.array_join("corpora", "+").alias("corpora"))


# ---------------------------------------------------------------------------
# Structured Streaming (availableNow over files landed under the checkpoint dir)
# ---------------------------------------------------------------------------


@register("stream_results_dedup", f"""with {FX2}
select {KEYS_SQL}, paradigm, case when rep < 2 then accuracy else least(accuracy + 1.0, 100.0) end as accuracy from fx2""")
def q_stream_dedup(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    landing = SK.scratch_path(spark, "results-landing")
    old.write.mode("append").parquet(landing)
    new.write.mode("append").parquet(landing)
    sink, ck = SK.scratch_path(spark, "results-sink"), SK.scratch_path(spark, "results-ckpt")
    q = SR.results_dedup_stream(spark, landing, old.schema, sink, ck, max_files_per_trigger=4)
    SR.run_to_completion(q)
    return SR.read_sink(spark, sink).select(*KEYS, "paradigm", "accuracy")


def _land_by_position(toks: DataFrame, landing: str) -> None:
    """Token scores arrive position by position. Files hold a shuffle partition's worth of rows,
    not one task's share of a position: a stream reads few files of that size a micro-batch,
    so its batches follow the bytes, not tasks times positions."""
    toks.hint("rebalance", F.col("pos")).write.mode("append").partitionBy("pos").parquet(landing)


@register("stream_sentence_scores", f"""with {FX3}
select sent_id, round(sum(logits[label + 1] - {LSE}), 4) as score, count(*) as n_tokens from fx3 group by sent_id""")
def q_stream_scores(spark, sf_dir):
    d = fx.logits(spark, sf_dir)
    toks = d.select("sent_id", "pos", (A.label_gather(A.log_softmax("logits"), "label")).alias("logprob"))
    landing = SK.scratch_path(spark, "tokens-landing")
    # token scores arrive position by position, as a scorer would emit batches
    _land_by_position(toks, landing)
    sink, ck = SK.scratch_path(spark, "scores-sink"), SK.scratch_path(spark, "scores-ckpt")
    schema = toks.schema
    q = SS.sentence_score_stream(spark, landing, schema, sink, ck, ["sent_id"], max_files_per_trigger=2)
    SR.run_to_completion(q)
    s = SS.current_scores(spark, sink, ["sent_id"])
    return s.select("sent_id", r4(F.col("score")).alias("score"), "n_tokens")


@register("stream_complete_scores", f"""with {FX3}
select sent_id, round({sql.score_sum_sql(f"(logits[label + 1] - {LSE})")}, 4) as score, count(*) as n_tokens, true as complete
from fx3 group by sent_id""")
def q_stream_complete(spark, sf_dir):
    d = fx.logits(spark, sf_dir)
    n = F.count(F.lit(1)).over(Window.partitionBy("sent_id"))  # eight positions at most
    toks = d.select("sent_id", "pos", A.label_gather(A.log_softmax("logits"), "label").alias("logprob"), n.alias("n_expected"))
    landing = SK.scratch_path(spark, "tokens-landing")
    _land_by_position(toks, landing)
    sink, ck = SK.scratch_path(spark, "complete-sink"), SK.scratch_path(spark, "complete-ckpt")
    q = SS.complete_score_stream(spark, landing, toks.schema, sink, ck, ["sent_id"], max_files_per_trigger=8)
    SR.run_to_completion(q)
    return SR.read_sink(spark, sink).withColumn("score", r4(F.col("score")))


@register("scorer_fill_mask", f"""with {VOCAB_SQL},
src as (select sent_id, i - 1 as pos, ids[i] as label, list_sum(ids) as s
        from (select sent_id, ids, unnest(range(1, len(ids) + 1)) as i from enc)),
lg as (select sent_id, pos, list_transform(range(64), lambda v: ((s * 31 + pos * 17 + v * v * 7) % 101) / 10.0) as z from src),
sc as (select sent_id, pos, ln(list_sum(list_transform(z, lambda x: exp(x)))) as lse, unnest(z) as x, unnest(range(64)) as label from lg)
select sent_id, cast(pos as int) as pos, cast(row_number() over (partition by sent_id, pos order by x desc, label) as int) as rank,
       cast(label as int) as label, round(x - lse, 4) as logprob
from sc qualify row_number() over (partition by sent_id, pos order by x desc, label) <= 5""")
def q_scorer_fill_mask(spark, sf_dir):
    from minpair.operators.scorer import ToyModel, scorer_fill_mask
    _, _, enc = fx5_encoded(spark, sf_dir)
    return scorer_fill_mask(enc, ToyModel(), ["sent_id"]).withColumn("logprob", r4(F.col("logprob")))


# ---------------------------------------------------------------------------
# Pseudo-log-likelihood per document (word tokens, whole texts)
# ---------------------------------------------------------------------------

@register("document_pll", f"""with {model_ctes('word')},
lines as (select doc_id, line as sentence from (
            select doc_id, unnest(string_split(lower(text), chr(10))) as line from documents) where line <> ''),
{count_model_token_scores('lines', 'doc_id', None, 'word')}
select d.doc_id, coalesce(s.n_tokens, 0) as n_tokens, round(coalesce(s.pll, 0.0), 4) as pll
from documents d left join (select doc_id, count(*) as n_tokens, sum(logprob) as pll from q_lp group by 1) s
  using (doc_id)""")
def q_document_pll(spark, sf_dir):
    from minpair.sources.tables import read_table
    lines = fx.training_lines(spark, sf_dir)
    model = CM.fit(lines, "sentence", "word")
    # every token has a log P; no column of the token itself is asked for
    toks = CM.token_logprobs(model, lines, "sentence", ["doc_id"], outer=False, fields=())
    per_doc = toks.groupBy("doc_id").agg(F.count("logprob").alias("n_tokens"), F.sum("logprob").alias("pll"))
    docs = read_table(spark, sf_dir, "documents", "doc_id")
    return docs.join(per_doc, "doc_id", "left").select(
        "doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
        r4(F.coalesce("pll", F.lit(0.0))).alias("pll"))


# ---------------------------------------------------------------------------
# All models x both methods x all paradigms in one plan (score-everything entry)
# ---------------------------------------------------------------------------


FX1_PARADIGMS = [f"p{i}" for i in range(fx.N_SUITE_PARADIGMS)]


# A user's model (the toy one) over the words of the lines themselves, both methods
USER_MODEL_SQL = """u_tok as (select paradigm, line_no, unnest(string_split(sentence, ' ')) as token,
                 unnest(range(len(string_split(sentence, ' ')))) as pos from pairs where sentence <> ''),
u_vocab as (select token, row_number() over (order by count(*) desc, token) + 4 as token_id from u_tok group by token),
u_ids as (select paradigm, line_no, list(token_id order by pos) as ids from u_tok join u_vocab using (token) group by 1, 2),
u_enc as (select p.paradigm, p.line_no, [0::bigint] || coalesce(u.ids, []::bigint[]) || [2::bigint] as ids
          from pairs p left join u_ids u on p.paradigm = u.paradigm and p.line_no = u.line_no),
u_src as (select 'mlm' as method, paradigm, line_no, i - 1 as pos, ids[i] as label, list_sum(ids) - ids[i] + 4 as s
          from (select *, unnest(range(2, len(ids))) as i from u_enc)
          union all
          select 'holistic', paradigm, line_no, i - 1, ids[i], list_sum(ids) from (select *, unnest(range(1, len(ids) + 1)) as i from u_enc)),
u_lg as (select *, list_transform(range(64), lambda v: ((s * 31 + pos * 17 + v * v * 7) % 101) / 10.0) as z from u_src),
u_lp as (select method, paradigm, line_no, z[cast(label % 64 as int) + 1] - ln(list_sum(list_transform(z, lambda x: exp(x)))) as lp from u_lg),
u_scores as (
  select 'toy' as model, 'documents' as corpora, 0 as rep, 'user/toy' as path, m.method as scoring_method, e.paradigm, e.line_no,
         case when m.method = 'mlm' then coalesce({0}, 0.0) else {1} end as score
  from u_enc e cross join (values ('mlm'), ('holistic')) m(method)
  left join u_lp l on l.method = m.method and l.paradigm = e.paradigm and l.line_no = e.line_no group by m.method, e.paradigm, e.line_no)""".format(
    sql.score_sum_sql("lp"), sql.score_mean_sql("-lp"))


def _eval_sql() -> str:
    parts = []
    for prefix, unit, name in (("c_", "char", "count-char"), ("w_", "word", "count-word")):
        parts.append(model_ctes(unit, prefix))
        parts.append(count_model_token_scores("pairs", "paradigm, line_no", None, unit, prefix))
        sep = "''" if unit == "char" else "' '"
        parts.append(f"""{prefix}s as (
  select p.paradigm, p.line_no,
         coalesce({sql.score_sum_sql('q.logprob')}, 0.0) as mlm,
         {sql.score_mean_sql('-q.logprob')} as holistic
  from pairs p left join {prefix}q_lp q on p.paradigm = q.paradigm and p.line_no = q.line_no
  group by p.paradigm, p.line_no, p.sentence),
{prefix}scores as (
  select '{name}' as model, 'documents' as corpora, 0 as rep, 'count/{unit}' as path, 'mlm' as scoring_method,
         paradigm, line_no, mlm as score from {prefix}s
  union all
  select '{name}', 'documents', 0, 'count/{unit}', 'holistic', paradigm, line_no, holistic from {prefix}s)""")
    cells = ",\n       ".join(f"round_even(max(case when paradigm = '{p}' then accuracy end) * 100.0, 0) / 100.0 as \"{p}\"" for p in FX1_PARADIGMS)
    return f"""with {FX1},
pairs as (
  select paradigm, 2 * line_no as line_no, lower(sentence) as sentence from fx1
  union all
  select paradigm, 2 * line_no + 1,
         concat(substr(s, 1, k - 1), substr(s, k + 1, 1), substr(s, k, 1), substr(s, k + 2))
  from (select paradigm, line_no, lower(sentence) as s, cast(floor(length(lower(sentence)) / 2) as int) as k from fx1)),
{','.join(parts)},
{USER_MODEL_SQL},
scores as (select * from c_scores union all select * from w_scores union all select * from u_scores),
pr as (select model, corpora, rep, path, scoring_method, paradigm, line_no // 2 as pair_id,
              max(case when line_no % 2 = 0 then score end) as good, max(case when line_no % 2 = 1 then score end) as bad, count(*) as n
       from scores group by all),
acc as (select model, corpora, rep, path, scoring_method, paradigm,
               cast(count(case when n = 2 and not isnan(good) and not isnan(bad) and
                     ((scoring_method = 'mlm' and good > bad) or
                      (scoring_method = 'holistic' and good < bad)) then 1 end) as double)
                     / nullif(cast(count(case when n = 2 then 1 end) as double), 0) * 100.0 as accuracy
        from pr group by all)
select model, corpora, rep, path, scoring_method,
       {cells},
       round_even(cast(avg(cast(accuracy as decimal(38,10))) as double) * 100.0, 0) / 100.0 as overall
from acc group by model, corpora, rep, path, scoring_method"""


@register("evaluate_models", _eval_sql())
def q_evaluate(spark, sf_dir):
    from minpair.operators.scorer import ToyModel
    lines = fx.minimal_pairs(spark, sf_dir)
    train = fx.training_lines(spark, sf_dir)
    models = [EV.ScoredModel("count-char", "documents", 0, "count/char", CM.fit(train, "sentence", "char")),
              EV.ScoredModel("count-word", "documents", 0, "count/word", CM.fit(train, "sentence", "word")),
              EV.ScoredModel("toy", "documents", 0, "user/toy", EV.UserModel(ToyModel(), TK.vocab_build(lines, unit="word")))]
    return EV.evaluate(models, lines, FX1_PARADIGMS)


# ---------------------------------------------------------------------------
# The 67-paradigm suite: FX4 paradigm i is the suite's i-th file
# ---------------------------------------------------------------------------


SUITE67 = [p for p, _ in SUITE67_PARADIGMS]
BDIM_SQL = "bdim as (select * from (values " + ", ".join(
    f"('{p}', '{ph}')" for p, ph in SUITE67_PARADIGMS) + ") t(paradigm, phenomenon))"


@register("suite67_phenomenon_accuracy", f"""with {FX4},
{sql.pair_accuracy_sql('fx4', method='mlm')},
named as (select {sql._str_list(SUITE67)}[cast(substr(paradigm, 2) as int) + 1] as paradigm,
                 round(cast(n_correct as double) / nullif(cast(n_pairs as double), 0) * 100.0, 4) as accuracy from acc),
{BDIM_SQL}
select phenomenon, count(*) as n_paradigms,
       round_even(cast(avg(cast(accuracy as decimal(38,10))) as double) * 10.0, 0) / 10.0 as accuracy
from named join bdim using (paradigm) group by phenomenon""")
def q_suite67_ph(spark, sf_dir):
    acc = ACC.pair_accuracy(fx.pair_scores(spark, sf_dir), "mlm")
    names = F.array(*[F.lit(p) for p in SUITE67])
    idx = F.substring("paradigm", 2, 10).cast("int")
    named = acc.select(F.element_at(names, idx + 1).alias("paradigm"), "accuracy")
    j = RS.phenomenon_join(named, "suite67")
    return j.groupBy("phenomenon").agg(F.count(F.lit(1)).alias("n_paradigms"),
                                       TX.round_half_even(exact_avg("accuracy"), 1).alias("accuracy"))
