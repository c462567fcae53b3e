"""The minimum end-to-end slice: "how often does the model prefer the good
sentence, per paradigm?"

fit the count model on every document line -> score both sides of every
character-swap pair from the conversations by pseudo-log-likelihood -> pair
accuracy per paradigm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from minpair.operators import count_model
from minpair.operators.accuracy import pair_accuracy
from minpair.operators.scoring import holistic_scores, mlm_scores
from minpair.sources import fixtures


def fitted_model(spark: SparkSession, sf_dir: str, unit: str = "char", lam: float = 0.5):
    return count_model.fit(fixtures.training_lines(spark, sf_dir), "sentence", unit, lam)


def flagship_scores(spark: SparkSession, sf_dir: str, method: str = "mlm", unit: str = "char",
                    model=None) -> DataFrame:
    """(paradigm, line_no, score) for every line of the FX7 pairs."""
    model = model or fitted_model(spark, sf_dir, unit)
    lines = fixtures.minimal_pairs(spark, sf_dir)
    if method == "mlm":
        return mlm_scores(model, lines, ["paradigm", "line_no"])
    return holistic_scores(model, lines, ["paradigm", "line_no"])


def flagship(spark: SparkSession, sf_dir: str, method: str = "mlm", unit: str = "char",
             model=None) -> DataFrame:
    """(paradigm, n_pairs, n_correct, accuracy)."""
    scores = flagship_scores(spark, sf_dir, method, unit, model)
    return pair_accuracy(scores, method)
