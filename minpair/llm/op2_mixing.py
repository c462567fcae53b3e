"""Mixing sources to target weights by hierarchical budgeting.

The rows form a tree, one level per column of ``levels`` (domain, language,
source). A token budget flows from the root: each node shares its budget
among its children by weight; what a child cannot use (its documents times
``max_epochs`` are too few) goes to its siblings first, and only what the
whole family cannot use goes to the ancestors' other children. Each leaf
takes whole epochs of its documents and then the token-prefix of one more
epoch in a seeded order.

The tree tables have one row per node. The prefix is found without ever
ordering a whole leaf: documents fall into 4096 slices of their seeded hash,
the slice where the budget runs out is cut into 4096 again, and only the
last slice is ordered by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minpair.llm.common import no_null, words, written

SEED = 7
_BITS = 12


def word_tokens(text_col: str = "text") -> Column:
    return F.size(words(no_null(text_col))).cast("long")


def _water_fill(nodes: DataFrame, family: list[str], budget: Column) -> DataFrame:
    """``nodes`` (weight w, capacity c) with alloc: each family's budget split by
    weight, no node above its capacity, the rest to the unfilled by weight.

    In order of c / w the filled nodes come first; a node is filled if the
    level that its elders leave reaches it. Families are as large as a node
    has children.
    """
    order = [F.try_divide(F.col("c"), F.col("w")).asc_nulls_last(), *[F.col(x) for x in nodes.columns if x.startswith("k")]]
    by = Window.partitionBy(*family)
    run = by.orderBy(*order)
    n = (nodes.withColumn("budget", budget)
         .withColumn("before", F.coalesce(F.sum("c").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("rest", F.sum("w").over(run.rowsBetween(0, Window.unboundedFollowing))))
    n = n.withColumn("full", F.col("c") * F.col("rest") <= (F.col("budget") - F.col("before")) * F.col("w"))
    n = (n.withColumn("used", F.sum(F.when(F.col("full"), F.col("c")).otherwise(0.0)).over(by))
         .withColumn("open", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(by)))
    share = F.try_divide((F.col("budget") - F.col("used")) * F.col("w"), F.col("open"))
    return n.withColumn("alloc", F.when(F.col("full"), F.col("c")).otherwise(
        F.least(F.col("c"), F.greatest(F.coalesce(share, F.lit(0.0)), F.lit(0.0))))).drop(
        "budget", "before", "rest", "full", "used", "open")


def _weight(keys: list[Column], weights: dict[tuple, float]) -> Column:
    """Weight of a node by its path; paths not named have weight 1."""
    out = None
    for path, w in sorted(weights.items()):
        if len(path) != len(keys):
            continue
        c = F.lit(True)
        for k, v in zip(keys, path):
            c = c & k.eqNullSafe(F.lit(v))
        out = F.when(c, F.lit(float(w))) if out is None else out.when(c, F.lit(float(w)))
    return F.lit(1.0) if out is None else out.otherwise(1.0)


def leaf_budgets(leaves: DataFrame, n_levels: int, weights: dict[tuple, float], fraction: float,
                 max_epochs: int) -> DataFrame:
    """``leaves`` (k0..kn, supply) with their budget in tokens (long)."""
    keys = [f"k{i}" for i in range(n_levels)]
    cap = leaves.withColumn("c", F.col("supply").cast("double") * max_epochs)
    total = cap.agg(F.sum("supply").alias("s")).select(
        F.floor(F.coalesce(F.col("s"), F.lit(0)).cast("double") * fraction).cast("double").alias("b"))
    alloc = None
    for depth in range(1, n_levels + 1):
        own = keys[:depth]
        n = (cap.groupBy(*own).agg(F.sum("c").alias("c"))
             .withColumn("w", _weight([F.col(x) for x in own], weights)))
        if alloc is None:
            n = _water_fill(n.crossJoin(F.broadcast(total)), [], F.col("b")).drop("b")  # one row
        else:
            up = alloc.select(*[F.col(x).alias(f"u_{x}") for x in own[:-1]], F.col("alloc").alias("b"))
            on = F.lit(True)
            for x in own[:-1]:
                on = on & F.col(x).eqNullSafe(F.col(f"u_{x}"))
            n = _water_fill(n.join(up, on).drop(*[f"u_{x}" for x in own[:-1]]), own[:-1], F.col("b")).drop("b")
        alloc = n.select(*own, "alloc")
    up = alloc.select(*[F.col(x).alias(f"u_{x}") for x in keys], "alloc")
    on = F.lit(True)
    for x in keys:
        on = on & F.col(x).eqNullSafe(F.col(f"u_{x}"))
    # a hair is added so that a sum of shares does not lose a token to rounding
    return leaves.join(up, on).select(*keys, "supply", F.floor(F.col("alloc") + 1e-6).cast("long").alias("budget"))


def _slice_of(h: Column, level: int) -> Column:
    return F.shiftright(h, 60 - _BITS * (level + 1)).bitwiseAND((1 << _BITS) - 1)


def _boundary(rows: DataFrame, level: int) -> DataFrame:
    """Per leaf, the first slice whose tokens pass what is left, and what is left before it."""
    s = rows.groupBy("leaf", "left", _slice_of(F.col("h"), level).alias("s")).agg(F.sum("tokens").alias("t"))
    w = Window.partitionBy("leaf").orderBy("s")
    s = s.withColumn("cum", F.sum("t").over(w))
    return (s.filter(F.col("cum") > F.col("left")).groupBy("leaf")
            .agg(F.min(F.struct("s", (F.col("left") - F.col("cum") + F.col("t")).alias("left"))).alias("m"))
            .select(F.col("leaf").alias("b_leaf"), F.col("m.s").alias("b_s"), F.col("m.left").alias("b_left")))


def mix(docs: DataFrame, levels: list[Column], weights: dict[tuple, float] | None = None,
        fraction: float = 0.5, max_epochs: int = 2, seed: int = SEED, id_col: str = "doc_id",
        tokens: Column | None = None) -> DataFrame:
    """One row per input row: id, k0..kn (its path), n_tokens, copies.

    ``weights`` maps a path (tuple of level values from the root) to its
    weight among its siblings, 1 unless named. The budget is ``fraction`` of
    all tokens. ``copies`` is how often the mix takes the row: the whole
    epochs of its leaf, and one more if it lies in the token-prefix, that is
    if the tokens of the leaf up to and including it, in the order of
    md5(seed:epoch:id), stay within what is left. Rows that share an id are
    taken or left together. Null levels are values of their own; null or
    empty texts have no tokens and are taken where the prefix reaches them; an empty
    table gives an empty result.
    """
    keys = [f"k{i}" for i in range(len(levels))]
    tokens = word_tokens() if tokens is None else tokens
    rows = written(docs.select(F.col(id_col).alias("id"), *[c.alias(k) for c, k in zip(levels, keys)],
                               tokens.alias("tokens")))
    leaves = written(rows.groupBy(*keys).agg(F.sum("tokens").alias("supply")))
    plan = leaf_budgets(leaves, len(keys), weights or {}, fraction, max_epochs)
    whole = F.coalesce(F.floor(F.try_divide(F.col("budget"), F.col("supply"))), F.lit(0)).cast("long")
    plan = plan.select(*[F.col(k).alias(f"u_{k}") for k in keys], "supply", whole.alias("whole"),
                       (F.col("budget") - whole * F.col("supply")).alias("left"),
                       F.md5(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})).alias("leaf"))
    plan = written(plan)
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"u_{k}"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"),
                                             F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary")),
                           1, 15), 16, 10).cast("long")
    all_rows = rows.join(plan, on).select("id", *keys, "tokens", "whole", "left", "leaf").withColumn("h", h)
    all_rows = written(all_rows)
    open_rows = all_rows.select("leaf", "left", "h", "tokens")
    b0 = written(_boundary(open_rows, 0))
    inner = (open_rows.join(b0, (F.col("leaf") == F.col("b_leaf")) & (_slice_of(F.col("h"), 0) == F.col("b_s")))
             .select("leaf", F.col("b_left").alias("left"), "h", "tokens"))
    b1 = written(_boundary(inner, 1))
    last = (inner.join(b1, (F.col("leaf") == F.col("b_leaf")) & (_slice_of(F.col("h"), 1) == F.col("b_s")))
            .select("leaf", F.col("b_s").alias("s1"), F.col("b_left").alias("left"), "h", "tokens"))
    # the row at which the budget runs out, per leaf: its hash is the first not taken
    run = last.groupBy("leaf", "left", "h").agg(F.sum("tokens").alias("t"))
    run = run.withColumn("cum", F.sum("t").over(Window.partitionBy("leaf").orderBy("h")))
    stop = (run.filter(F.col("cum") > F.col("left")).groupBy("leaf").agg(F.min("h").alias("stop"))
            .select(F.col("leaf").alias("b_leaf"), "stop"))
    stop = written(stop)
    out = all_rows.join(stop, F.col("leaf") == F.col("b_leaf"), "left")
    more = F.when(F.col("stop").isNull() | (F.col("h") < F.col("stop")), 1).otherwise(0)
    # no further epoch for a leaf that has had them all
    copies = F.when(F.col("whole") >= max_epochs, F.col("whole")).otherwise(F.col("whole") + more)
    return out.select(F.col("id").alias(id_col), *keys, F.col("tokens").alias("n_tokens"),
                      copies.cast("int").alias("copies"))
