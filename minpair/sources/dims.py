"""Small fixed dimension tables: paradigm -> phenomenon, and t critical values.

These are bounded (67 + 23 + 34 rows), so joining them by broadcast is safe at
any data size.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES: must equal the published test-suite layout for results to line
# up. Paradigm file names and their phenomenon, in written order.
# ---------------------------------------------------------------------------
SUITE67_PARADIGMS = [
    ("anaphor_gender_agreement", "anaphor agreement"),
    ("anaphor_number_agreement", "anaphor agreement"),
    ("animate_subject_passive", "argument structure"),
    ("animate_subject_trans", "argument structure"),
    ("causative", "argument structure"),
    ("drop_argument", "argument structure"),
    ("inchoative", "argument structure"),
    ("intransitive", "argument structure"),
    ("passive_1", "argument structure"),
    ("passive_2", "argument structure"),
    ("transitive", "argument structure"),
    ("principle_A_c_command", "binding"),
    ("principle_A_case_1", "binding"),
    ("principle_A_case_2", "binding"),
    ("principle_A_domain_1", "binding"),
    ("principle_A_domain_2", "binding"),
    ("principle_A_domain_3", "binding"),
    ("principle_A_reconstruction", "binding"),
    ("existential_there_object_raising", "control/raising"),
    ("existential_there_subject_raising", "control/raising"),
    ("expletive_it_object_raising", "control/raising"),
    ("tough_vs_raising_1", "control/raising"),
    ("tough_vs_raising_2", "control/raising"),
    ("determiner_noun_agreement_1", "determiner-noun agreement"),
    ("determiner_noun_agreement_2", "determiner-noun agreement"),
    ("determiner_noun_agreement_irregular_1", "determiner-noun agreement"),
    ("determiner_noun_agreement_irregular_2", "determiner-noun agreement"),
    ("determiner_noun_agreement_with_adjective_1", "determiner-noun agreement"),
    ("determiner_noun_agreement_with_adj_2", "determiner-noun agreement"),
    ("determiner_noun_agreement_with_adj_irregular_1", "determiner-noun agreement"),
    ("determiner_noun_agreement_with_adj_irregular_2", "determiner-noun agreement"),
    ("ellipsis_n_bar_1", "ellipsis"),
    ("ellipsis_n_bar_2", "ellipsis"),
    ("wh_questions_object_gap", "filler-gap"),
    ("wh_questions_subject_gap", "filler-gap"),
    ("wh_questions_subject_gap_long_distance", "filler-gap"),
    ("wh_vs_that_no_gap", "filler-gap"),
    ("wh_vs_that_no_gap_long_distance", "filler-gap"),
    ("wh_vs_that_with_gap", "filler-gap"),
    ("wh_vs_that_with_gap_long_distance", "filler-gap"),
    ("irregular_past_participle_adjectives", "irregular forms"),
    ("irregular_past_participle_verbs", "irregular forms"),
    ("distractor_agreement_relational_noun", "subject-verb agreement"),
    ("distractor_agreement_relative_clause", "subject-verb agreement"),
    ("irregular_plural_subject_verb_agreement_1", "subject-verb agreement"),
    ("irregular_plural_subject_verb_agreement_2", "subject-verb agreement"),
    ("regular_plural_subject_verb_agreement_1", "subject-verb agreement"),
    ("regular_plural_subject_verb_agreement_2", "subject-verb agreement"),
    ("existential_there_quantifiers_1", "quantifiers"),
    ("existential_there_quantifiers_2", "quantifiers"),
    ("superlative_quantifiers_1", "quantifiers"),
    ("superlative_quantifiers_2", "quantifiers"),
    ("matrix_question_npi_licensor_present", "npi licensing"),
    ("npi_present_1", "npi licensing"),
    ("npi_present_2", "npi licensing"),
    ("only_npi_licensor_present", "npi licensing"),
    ("only_npi_scope", "npi licensing"),
    ("sentential_negation_npi_licensor_present", "npi licensing"),
    ("sentential_negation_npi_scope", "npi licensing"),
    ("adjunct_island", "island effects"),
    ("complex_NP_island", "island effects"),
    ("coordinate_structure_constraint_complex_left_branch", "island effects"),
    ("coordinate_structure_constraint_object_extraction", "island effects"),
    ("left_branch_island_echo_question", "island effects"),
    ("left_branch_island_simple_question", "island effects"),
    ("sentential_subject_island", "island effects"),
    ("wh_island", "island effects"),
]

SUITE23_PARADIGMS = [
    ("anaphor_agreement-pronoun_gender", "anaphor agreement"),
    ("argument_structure-dropped_argument", "argument structure"),
    ("argument_structure-swapped_arguments", "argument structure"),
    ("argument_structure-transitive", "argument structure"),
    ("binding-principle_a", "binding"),
    ("case-subjective_pronoun", "case"),
    ("local_attractor-in_question_with_aux", "local_attractor"),
    ("agreement_determiner_noun-across_1_adjective", "determiner-noun agreement"),
    ("agreement_determiner_noun-between_neighbors", "determiner-noun agreement"),
    ("ellipsis-n_bar", "ellipsis"),
    ("filler-gap-wh_question_object", "filler-gap"),
    ("filler-gap-wh_question_subject", "filler-gap"),
    ("irregular-verb", "irregular"),
    ("agreement_subject_verb-across_prepositional_phrase", "subject-verb agreement"),
    ("agreement_subject_verb-across_relative_clause", "subject-verb agreement"),
    ("agreement_subject_verb-in_question_with_aux", "subject-verb agreement"),
    ("agreement_subject_verb-in_simple_question", "subject-verb agreement"),
    ("quantifiers-existential_there", "quantifiers"),
    ("quantifiers-superlative", "quantifiers"),
    ("npi_licensing-matrix_question", "npi licensing"),
    ("npi_licensing-only_npi_licensor", "npi licensing"),
    ("island-effects-adjunct_island", "island effects"),
    ("island-effects-coordinate_structure_constraint", "island effects"),
]

# FIXED VALUES: expected sentences per paradigm file.
EXPECTED_LINES = {"suite67": 2000, "suite23": 4000}

# FIXED VALUES: two-sided Student t critical values at confidence 0.90
# (upper 0.95 quantile), by degrees of freedom.
T_CRITICAL_090 = [
    (1, 6.313752), (2, 2.919986), (3, 2.353363), (4, 2.131847), (5, 2.015048),
    (6, 1.943180), (7, 1.894579), (8, 1.859548), (9, 1.833113), (10, 1.812461),
    (11, 1.795885), (12, 1.782288), (13, 1.770933), (14, 1.761310), (15, 1.753050),
    (16, 1.745884), (17, 1.739607), (18, 1.734064), (19, 1.729133), (20, 1.724718),
    (21, 1.720743), (22, 1.717144), (23, 1.713872), (24, 1.710882), (25, 1.708141),
    (26, 1.705618), (27, 1.703288), (28, 1.701131), (29, 1.699127), (30, 1.697261),
    (40, 1.683851), (60, 1.670649), (66, 1.668271), (120, 1.657651),
]

SUITES = {"suite67": SUITE67_PARADIGMS, "suite23": SUITE23_PARADIGMS}

PHENOMENON_SCHEMA = T.StructType([
    T.StructField("suite", T.StringType(), False),
    T.StructField("paradigm_index", T.IntegerType(), False),
    T.StructField("paradigm", T.StringType(), False),
    T.StructField("phenomenon", T.StringType(), False),
])


def suite_paradigms(suite: str) -> list[tuple[str, str]]:
    if suite not in SUITES:
        raise ValueError(f"unknown test suite {suite!r}; expected one of {sorted(SUITES)}")
    return SUITES[suite]


def phenomena(spark: SparkSession, suite: str | None = None) -> DataFrame:
    """``(suite, paradigm_index, paradigm, phenomenon)`` for one or both suites."""
    names = [suite] if suite else sorted(SUITES)
    rows = [(s, i, p, ph) for s in names for i, (p, ph) in enumerate(suite_paradigms(s))]
    return spark.createDataFrame(rows, PHENOMENON_SCHEMA)


def t_critical(spark: SparkSession) -> DataFrame:
    """``(df int, t double)`` for confidence 0.90."""
    return spark.createDataFrame(T_CRITICAL_090, "df int, t double")


def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t by bisection on its distribution function, which
    for an integer df is a finite trigonometric sum."""
    def upper(t):  # P(T <= t), t >= 0
        a = math.atan(t / math.sqrt(df))
        c, term, total = math.cos(a), 1.0, 0.0
        if df % 2:
            term = c
            for k in range(3, df + 1, 2):
                total += term
                term *= c * c * (k - 1) / k
            return 0.5 + (a + math.sin(a) * total) / math.pi
        for k in range(2, df + 1, 2):
            total += term
            term *= c * c * (k - 1) / k
        return 0.5 + math.sin(a) * total / 2

    lo, hi = 0.0, 1.0
    while upper(hi) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if upper(mid) < p else (lo, mid)
    return (lo + hi) / 2


def _t_expansion(z: float, df) -> "F.Column":
    """Cornish-Fisher expansion of the t quantile in 1/df (error under 1e-7 beyond df 100)."""
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96,
             (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    n = df.cast("double")
    return F.lit(z) + F.lit(terms[0]) / n + F.lit(terms[1]) / (n * n) + F.lit(terms[2]) / (n * n * n)


#: Degrees of freedom up to which the quantile is computed exactly.
T_EXACT_DF = 120


def t_critical_expr(df_col, confidence: float = 0.90) -> "F.Column":
    """Two-sided t critical value of a degrees-of-freedom column for any df >= 1
    and any confidence, to 6 decimals: a literal map up to ``T_EXACT_DF``, the
    expansion beyond. No join; NULL below 1."""
    p = 0.5 + confidence / 2
    flat = []
    for k in range(1, T_EXACT_DF + 1):
        flat += [F.lit(k), F.lit(round(t_quantile(p, k), 6))]
    z = NormalDist().inv_cdf(p)
    return F.when(df_col > T_EXACT_DF, F.round(_t_expansion(z, df_col), 6)).otherwise(
        F.try_element_at(F.create_map(*flat), df_col.cast("int")))
