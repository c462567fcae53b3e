"""Driver contract, and every registered query against its DuckDB oracle
on the smallest scale."""
import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and set(df.columns) == {"paradigm", "n_pairs", "n_correct", "accuracy"}


def test_oracles_are_subset():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def con(smoke_dir):
    from check_oracles import duck
    return duck(smoke_dir)


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, con, smoke_dir, name):
    from check_oracles import compare
    status, detail = compare(spark, con, smoke_dir, name)
    assert status in ("OK", "ROWS-ONLY"), detail
