"""Every registered query with an oracle equals DuckDB on sf0.001 (the
driver repeats this at sf0.01); queries without one still run."""

import re

import pytest

import __spark_entry__ as entry
from oracle_compare import compare, duck

from paths import SF0001

SQL = entry.oracle_sql()
QUERIES = entry.queries()
# the queries of the training-data package have their own brute-force tests
OWN_TESTS = {n for n in QUERIES if n == "pipeline" or re.match(r"op\d+_", n)}


@pytest.fixture(scope="module")
def con():
    return duck(SF0001)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_duckdb(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], SQL[name], SF0001)
    assert r["cols"], r
    assert r["rows"] == r["oracle_rows"], r
    assert r["values"], r


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - OWN_TESTS))
def test_rows_only_query_runs(spark, name):
    df = QUERIES[name](spark, SF0001)
    assert df.count() >= 1
