"""Score every model with both methods on every paradigm, in one plan.

The original loops over models, methods and paradigm files and appends one
wide row per (model, method). Here each model contributes one branch that
scores all lines once for both methods (``both_scores``); the branches are
unioned with the model's registry keys as columns, and pair accuracy,
the long results table and the wide table with ``overall`` are computed for
all of them together. A registry row can hold a count model or a user's own
(``UserModel``): its branch encodes the lines by its vocabulary and scores
both methods in one pass of the workers that hold the model.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minpair.functions.numeric import score_mean, score_sum
from minpair.functions.text import lower_case_lines, round_half_even
from minpair.operators.accuracy import pair_accuracy
from minpair.operators import count_model as cm
from minpair.operators.count_model import CountModel
from minpair.operators.results import KEYS, results_wide
from minpair.operators.scorer import TokenModel, scorer_scores
from minpair.operators.scoring import both_scores
from minpair.operators.tokens import Vocabulary, encode


@dataclass
class UserModel:
    """A user's model over the ids of ``vocab``; ``profile`` is the ResourceProfile of the
    stage that runs it (None: that of the session)."""
    scorer: TokenModel
    vocab: Vocabulary
    profile: object | None = None


@dataclass
class ScoredModel:
    """A registry row (name, corpora, rep, path, lower_case) with its model."""
    name: str
    corpora: str
    rep: int
    path: str
    model: CountModel | UserModel
    lower_case: bool = False


def _branch_scores(m: ScoredModel, lines: DataFrame, text_col: str, max_tokens) -> DataFrame:
    src = lines.select("paradigm", "line_no", lower_case_lines(text_col, m.lower_case).alias(text_col))
    s = both_scores(m.model, src, ["paradigm", "line_no"], text_col, max_tokens)
    return s.select(F.lit(m.name).alias("model"), F.lit(m.corpora).alias("corpora"),
                    F.lit(int(m.rep)).alias("rep"), F.lit(m.path).alias("path"),
                    "scoring_method", "paradigm", "line_no", "score")


def _user_scores(m: ScoredModel, lines: DataFrame, text_col: str, max_tokens) -> DataFrame:
    """Each model is a branch, so a stage of its own: its tasks load no other model."""
    at = ["paradigm", "line_no"]
    src = lines.select(*at, lower_case_lines(text_col, m.lower_case).alias(text_col))
    s = scorer_scores(encode(src, m.model.vocab, at, text_col), m.model.scorer, at, max_ids=max_tokens, profile=m.model.profile)
    sides = F.array(*[F.struct(F.lit(x).alias("scoring_method"), F.nanvl(F.col(x), F.lit(None).cast("double")).alias("score"))
                      for x in ("mlm", "holistic")])
    return s.select(F.lit(m.name).alias("model"), F.lit(m.corpora).alias("corpora"), F.lit(int(m.rep)).alias("rep"),
                    F.lit(m.path).alias("path"), *at, F.inline(sides)).select(
        "model", "corpora", "rep", "path", "scoring_method", *at, "score")


def _shared_scores(group: list[ScoredModel], lines: DataFrame, text_col: str, max_tokens) -> DataFrame:
    """Models with one token unit and lower-casing choice: the lines are
    tokenised once, each token row is tagged with every model's index, and
    all models' tables are looked up by (model, l, t, r) and (model, t)."""
    m0 = group[0]
    src = lines.select("paradigm", "line_no", lower_case_lines(text_col, m0.lower_case).alias(text_col))
    toks = cm.token_contexts(src, text_col, m0.model.unit, keep=["paradigm", "line_no"], outer=True)
    toks = toks.select("*", F.explode(F.array(*[F.lit(i) for i in range(len(group))])).alias("_m"))
    tri = group[0].model.trigrams.select(F.lit(0).alias("_m"), "l", "t", "r", F.col("logprob").alias("_seen"))
    uni = group[0].model.unigrams.select(F.lit(0).alias("_m"), "t", F.col("unseen_logprob").alias("_unseen"))
    for i, m in enumerate(group[1:], start=1):
        tri = tri.unionByName(m.model.trigrams.select(F.lit(i).alias("_m"), "l", "t", "r", F.col("logprob").alias("_seen")))
        uni = uni.unionByName(m.model.unigrams.select(F.lit(i).alias("_m"), "t", F.col("unseen_logprob").alias("_unseen")))
    # broadcast only if all models together stay under the checked bounds
    if sum(m.model.n_trigrams for m in group) <= cm.max_rows(tri):
        tri = F.broadcast(tri)
    if sum(m.model.n_types for m in group) <= cm.max_types(uni):
        uni = F.broadcast(uni)
    unknown = F.element_at(F.array(*[F.lit(m.model.unknown_logprob()) for m in group]), F.col("_m") + 1)
    j = toks.join(tri, ["_m", "l", "t", "r"], "left").join(uni, ["_m", "t"], "left")
    lp = F.when(F.col("t").isNotNull(), F.coalesce("_seen", "_unseen", unknown))
    agg = j.groupBy("_m", "paradigm", "line_no").agg(score_sum(lp).alias("_sum"), score_mean(-lp).alias("_mean"),
                                                     F.count("t").alias("_n"))
    ok = F.lit(True) if max_tokens is None else (F.col("_n") + 2 <= F.lit(int(max_tokens)))
    mlm = F.when(ok, F.coalesce(F.col("_sum"), F.lit(0.0)))
    sides = F.array(F.struct(F.lit("mlm").alias("scoring_method"), mlm.alias("score")),
                    F.struct(F.lit("holistic").alias("scoring_method"), F.col("_mean").alias("score")))

    def key(field, cast=None):
        vals = [getattr(m, field) for m in group]
        arr = F.array(*[F.lit(v) for v in vals])
        c = F.element_at(arr, F.col("_m") + 1)
        return c.cast(cast) if cast else c

    return agg.select(key("name").alias("model"), key("corpora").alias("corpora"), key("rep", "int").alias("rep"),
                      key("path").alias("path"), "paradigm", "line_no", F.inline(sides)).select(
        "model", "corpora", "rep", "path", "scoring_method", "paradigm", "line_no", "score")


def results_long(models: list[ScoredModel], lines: DataFrame, text_col: str = "sentence",
                 max_tokens: int | None = None) -> DataFrame:
    """(model, corpora, rep, path, scoring_method, paradigm, accuracy) for
    every model, both methods and every paradigm of ``lines``
    (paradigm, line_no, sentence). Models sharing a token unit and
    lower-casing choice share one tokenisation of the lines."""
    groups: dict[tuple, list[ScoredModel]] = {}
    own = [m for m in models if isinstance(m.model, UserModel)]
    for m in models:
        if isinstance(m.model, UserModel):
            continue
        groups.setdefault((m.model.unit, bool(m.lower_case)), []).append(m)
    branches = [(_branch_scores(g[0], lines, text_col, max_tokens) if len(g) == 1
                 else _shared_scores(g, lines, text_col, max_tokens)) for g in groups.values()]
    branches += [_user_scores(m, lines, text_col, max_tokens) for m in own]
    scores = branches[0]
    for b in branches[1:]:
        scores = scores.unionByName(b)
    # unrounded: what is averaged over paradigms is rounded once, at the end
    acc = pair_accuracy(scores, "scoring_method", keys=KEYS, decimals=None)
    return acc.select(*KEYS, "paradigm", "accuracy")


def evaluate(models: list[ScoredModel], lines: DataFrame, paradigms: list[str],
             previous: DataFrame | None = None, max_tokens: int | None = None) -> DataFrame:
    """The wide results table (one row per model and method, a column per
    paradigm and ``overall``, the mean of the unrounded ones; all rounded to 2
    decimals half-even). A result row
    (model, corpora, rep, path, method) already in ``previous`` (long form)
    wins whole over a new one: no cell of the new row is mixed in."""
    long = results_long(models, lines, max_tokens=max_tokens)
    if previous is not None:
        have = previous.select(*[F.col(k).alias(f"_{k}") for k in KEYS]).distinct()
        same = F.lit(True)
        for k in KEYS:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        long = previous.select(*long.columns).unionByName(long.join(have, same, "left_anti"))
    wide = results_wide(long, paradigms, overall_decimals=2)
    return wide.select(*[round_half_even(f"`{c}`", 2).alias(c) if c in paradigms else F.col(c) for c in wide.columns])
