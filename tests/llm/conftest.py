import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or full rows; ``extra`` adds columns whose names
    clash with the operators' own."""

    def make(rows, extra=False):
        full = [r if len(r) == 5 else (r[0], r[1], "en", "src1", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for c in ("h", "id", "t", "n", "keep_id", "score", "host", "words", "k0", "label", "kept"):
                df = df.selectExpr("*", f"'x' as {c}")
        return df

    return make


EDGE = [(1, None), (2, ""), (3, "  \n\t"), (4, "a b c d e f g"), (4, "a b c d e f g"), (None, "lone words here"),
        (5, "very " * 30000), (6, "x" * 200000), (7, "a b c d e f g")]


@pytest.fixture(scope="session")
def edge_rows():
    return EDGE
