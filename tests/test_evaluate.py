"""End-to-end evaluation plan on a small hand-made suite."""
from minpair.operators import count_model as CM
from minpair.plans.evaluate import ScoredModel, evaluate, results_long


def test_evaluate_wide_and_previous_wins(spark):
    train = spark.createDataFrame([("the cat sat",), ("the dog sat",), ("a cat ran",)], "sentence string")
    model = CM.fit(train, "sentence", "word")
    lines = spark.createDataFrame([("p1", 0, "the cat sat"), ("p1", 1, "cat the sat"),
                                   ("p2", 0, "the dog sat"), ("p2", 1, "dog sat the")],
                                  "paradigm string, line_no long, sentence string")
    m = ScoredModel("count-word", "toy", 0, "toy/0", model)
    long = {(r["scoring_method"], r["paradigm"]): r["accuracy"] for r in results_long([m], lines).collect()}
    assert long[("mlm", "p1")] == 100.0 and long[("mlm", "p2")] == 100.0
    wide = evaluate([m], lines, ["p1", "p2"]).collect()
    assert {r["scoring_method"] for r in wide} == {"mlm", "holistic"}
    prev = spark.createDataFrame([("count-word", "toy", 0, "toy/0", "mlm", "p1", 12.5)],
                                 "model string, corpora string, rep int, path string, scoring_method string, "
                                 "paradigm string, accuracy double")
    again = {r["scoring_method"]: r for r in evaluate([m], lines, ["p1", "p2"], previous=prev).collect()}
    assert again["mlm"]["p1"] == 12.5 and again["mlm"]["p2"] is None  # the old row wins whole
    assert again["mlm"]["overall"] == 12.5 and again["holistic"]["p2"] is not None


def test_shared_tokenisation_matches_separate_branches(spark):
    a = CM.fit(spark.createDataFrame([("the cat sat",), ("a dog ran",)], "sentence string"), "sentence", "word")
    b = CM.fit(spark.createDataFrame([("the dog sat",), ("the cat ran far",)], "sentence string"), "sentence", "word")
    lines = spark.createDataFrame([("p1", 0, "the cat sat"), ("p1", 1, "cat the sat"),
                                   ("p2", 0, "a dog ran"), ("p2", 1, "dog ran a"), ("p2", 2, "zz top")],
                                  "paradigm string, line_no long, sentence string")
    ma, mb = ScoredModel("A", "ca", 0, "a/0", a), ScoredModel("B", "cb", 1, "b/1", b)
    shared = sorted(map(tuple, results_long([ma, mb], lines).collect()))
    separate = sorted([tuple(r) for r in results_long([ma], lines).collect()]
                      + [tuple(r) for r in results_long([mb], lines).collect()])
    assert shared == separate
