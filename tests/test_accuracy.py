"""Pair accuracy goldens and null/NaN rules."""
import math

import pytest
from hypothesis import given, settings, strategies as st

from minpair.operators.accuracy import evaluation_grid, overall_accuracy, pair_accuracy


def _scores(spark, values, paradigm="p"):
    rows = [(paradigm, i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "paradigm string, line_no long, score double")


def _acc(spark, values, method):
    r = pair_accuracy(_scores(spark, values), method).collect()
    return r[0]["accuracy"] if r else None


def test_goldens(spark):
    assert _acc(spark, [2, 1, 1, 2], "mlm") == 50.0
    assert _acc(spark, [2, 1, 1, 2], "holistic") == 50.0
    assert _acc(spark, [1, 1], "mlm") == 0.0            # tie is wrong
    assert _acc(spark, [2, 1, 3, 1, 9], "mlm") == 100.0  # trailing line ignored
    assert _acc(spark, [float("nan"), 1.0], "mlm") == 0.0  # NaN good side: wrong
    assert _acc(spark, [1.0, float("nan")], "mlm") == 0.0  # NaN bad side: wrong (Spark NaN > x is true)
    assert _acc(spark, [None, 1.0], "mlm") == 0.0


def test_no_pairs_is_null(spark):
    r = pair_accuracy(_scores(spark, [1.0]), "mlm").collect()
    assert [(x.n_pairs, x.n_correct, x.accuracy) for x in r] == [(0, 0, None)]  # the paradigm stays, without a value
    df = _scores(spark, [1.0, 2.0]).where("line_no > 5")
    assert pair_accuracy(df, "mlm").collect() == []


def test_unknown_method_rejected(spark):
    with pytest.raises(ValueError):
        pair_accuracy(_scores(spark, [1, 2]), "perplexity")


def test_method_column(spark):
    rows = [("mlm", "p", 0, 2.0), ("mlm", "p", 1, 1.0), ("holistic", "p", 0, 2.0), ("holistic", "p", 1, 1.0)]
    df = spark.createDataFrame(rows, "scoring_method string, paradigm string, line_no long, score double")
    out = {r["scoring_method"]: r["accuracy"] for r in
           pair_accuracy(df, "scoring_method", keys=["scoring_method"]).collect()}
    assert out == {"mlm": 100.0, "holistic": 0.0}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=5), min_size=2, max_size=30))
def test_swapped_accuracy_property(spark, xs):
    """Swapping the sides of every pair: acc(swapped) = 100 - acc - tie share."""
    n = len(xs) // 2 * 2
    xs = [float(x) for x in xs[:n]]
    swapped = []
    for i in range(0, n, 2):
        swapped += [xs[i + 1], xs[i]]
    a, b = _acc(spark, xs, "mlm"), _acc(spark, swapped, "mlm")
    ties = sum(xs[i] == xs[i + 1] for i in range(0, n, 2)) / (n // 2) * 100
    assert math.isclose(a + b + ties, 100.0, abs_tol=1e-3)


def test_overall_skips_null(spark):
    df = spark.createDataFrame([("m", 50.0), ("m", None), ("m", 70.0)], "model string, accuracy double")
    r = overall_accuracy(df, ["model"]).collect()[0]
    assert r["overall"] == 60.0 and r["n_paradigms"] == 2


def test_evaluation_grid(spark):
    models = spark.createDataFrame([("a",), ("b",)], "name string")
    paradigms = spark.createDataFrame([("x",), ("y",), ("z",)], "paradigm string")
    g = evaluation_grid(models, ["mlm", "holistic"], paradigms)
    assert g.count() == 12
    with pytest.raises(ValueError):
        evaluation_grid(models, ["bogus"], paradigms)


def test_long_wide_long_identity(spark):
    from minpair.operators.results import KEYS, results_unpivot, results_wide
    rows = [("m", "c", 0, "m/c/0", "mlm", p, float(i)) for i, p in enumerate(["a", "b", "c"])]
    rows += [("m", "c", 1, "m/c/1", "mlm", "a", 7.0)]
    long = spark.createDataFrame(rows, "model string, corpora string, rep int, path string, "
                                       "scoring_method string, paradigm string, accuracy double")
    back = results_unpivot(results_wide(long, ["a", "b", "c"]), ["a", "b", "c"]).where("accuracy is not null")
    assert sorted(map(tuple, back.select(*KEYS, "paradigm", "accuracy").collect())) == sorted(rows)


def test_small_differences_and_ties(spark):
    assert _acc(spark, [1.0 + 1e-9, 1.0, 1.0, 1.0], "mlm") == 50.0
    assert _acc(spark, [1.0, 1.0 + 1e-9, 1.0, 1.0], "holistic") == 50.0


def test_ties_stay_ties_over_any_partitioning(spark):
    """Both sides of a pair hold the same token scores in other orders: no order of
    summing may make one of them win."""
    import random
    from minpair.operators.scoring import pll_from_tokens
    rng = random.Random(7)
    rows = []
    for pair in range(40):
        lps = [-rng.random() * 12 for _ in range(60)]
        for side in (0, 1):
            rng.shuffle(lps)
            rows += [("p", 2 * pair + side, lp) for lp in lps]
    toks = spark.createDataFrame(rows, "paradigm string, line_no long, logprob double")
    for n in (1, 3, 7):
        s = pll_from_tokens(toks.repartition(n, "logprob"), ["paradigm", "line_no"])
        r = pair_accuracy(s, "mlm").first()
        assert (r["n_pairs"], r["n_correct"]) == (40, 0)
        assert pair_accuracy(s, "holistic").first()["n_correct"] == 0
    more = toks.unionByName(spark.createDataFrame([("p", 2 * i, 1e-9) for i in range(40)], toks.schema))
    assert pair_accuracy(pll_from_tokens(more, ["paradigm", "line_no"]), "mlm").first()["n_correct"] == 40
