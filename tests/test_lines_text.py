"""Suite lines, string functions and rounding goldens."""
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from minpair.functions import text as TX
from minpair.operators import lines as LN


def _lines(spark, sentences, paradigm="p"):
    return spark.createDataFrame([(paradigm, i, s) for i, s in enumerate(sentences)],
                                 "paradigm string, line_no long, sentence string")


def _ordered(df):
    return [r["sentence"] for r in df.orderBy("line_no").collect()]


def test_swap_golden(spark):
    out = LN.swap_pair_order(_lines(spark, ["b1", "g1", "b2", "g2", "x"]))
    assert _ordered(out) == ["g1", "b1", "g2", "b2"]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=3), min_size=0, max_size=12))
def test_swap_is_involution_on_even(spark, xs):
    xs = xs[: len(xs) // 2 * 2]
    if not xs:
        return
    df = _lines(spark, xs)
    twice = LN.swap_pair_order(LN.swap_pair_order(df))
    assert _ordered(twice) == xs


def test_swap_invariants(spark):
    df = _lines(spark, ["a", "b", "c", "d"])
    r = LN.swap_invariants(df, LN.swap_pair_order(df)).collect()[0]
    assert (r["n_before"], r["n_after"], r["n_missing"], r["n_extra"]) == (4, 4, 0, 0)


def test_violations_and_batches(spark):
    df = _lines(spark, [str(i) for i in range(25)])
    v = LN.line_count_violations(df, 4000).collect()[0]
    assert v["n_lines"] == 25 and v["odd"]
    b = LN.fixed_batches(df).groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [r["count"] for r in b] == [10, 10, 5]


def test_text_goldens(spark):
    row = spark.range(1).select(
        TX.round_half_even(F.lit(0.125), 2).alias("a"),
        TX.round_half_even(F.lit(0.25), 1).alias("b"),
        TX.round_half_even(F.lit(72.125), 2).alias("c"),
        TX.paradigm_label(F.lit("anaphor_gender_agreement"), F.lit("anaphor agreement")).alias("d"),
        TX.paradigm_label(F.lit("anaphor_gender_agreement"), F.lit("anaphor"), mode="prefix").alias("e"),
        TX.shorten_phenomenon(F.lit("determiner-noun agreement")).alias("f"),
        TX.strip_whitespace(F.lit("\t a b \n")).alias("g"),
        TX.swap_middle_chars(F.lit("abcd")).alias("h"),
        TX.swap_middle_chars(F.lit("abcde")).alias("h5"),
        TX.swap_middle_chars(F.lit("a")).alias("h1"),
        TX.group_name(F.lit("m"), F.lit(None).cast("string")).alias("i"),
    ).collect()[0]
    assert (row["a"], row["b"], row["c"]) == (0.12, 0.2, 72.12)
    assert row["d"] == "der agreement"
    assert row["e"] == "gender agreement"
    assert row["f"] == "det. noun agr."
    assert row["g"] == "a b"
    assert row["h"] == "acbd" and row["h5"] == "acbde" and row["h1"] == "a"
    assert row["i"] is None


def test_report_line_matches_python(spark):
    name, acc, n, h = "model-x+corpus-y", 73.641, 3, 1.2345
    expected = "model-x+corpus-y" + "." * 48 + "accuracy=73.64 n= 3 margin-of-error=    1.23"
    got = spark.range(1).select(TX.report_line(F.lit(name), TX.round_half_even(F.lit(acc), 2), F.lit(n),
                                               TX.round_half_even(F.lit(h), 2)).alias("x")).collect()[0]["x"]
    assert got == expected
    nan_line = spark.range(1).select(TX.report_line(F.lit(name), F.lit(70.0), F.lit(1),
                                                    F.lit(None).cast("double")).alias("x")).collect()[0]["x"]
    assert nan_line.endswith("margin-of-error=     nan")
    wide = spark.range(1).select(TX.fixed(F.lit(1234567.89), 8, 2).alias("x"), TX.param_name(F.lit(1001)).alias("p"),
                                 TX.param_name(F.lit(7)).alias("q"), TX.strip_whitespace(F.lit("\u00a0\u2003a b\u3000")).alias("s")).collect()[0]
    assert (wide["x"], wide["p"], wide["q"], wide["s"]) == ("1234567.89", "param_1001", "param_007", "a b")


def test_shorten_path(spark):
    df = spark.createDataFrame([("/fairseq/m/checkpoint_last_1.pt",), ("/runs/param_001/x/saves/",), ("/other/y",)], "p string")
    out = [r[0] for r in df.select(TX.shorten_path("p", "/fairseq", "/runs")).collect()]
    assert out == ["m/checkpoint_last_1.pt", "param_001/x/saves", "/other/y"]
