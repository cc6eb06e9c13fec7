"""Every registered query with oracle SQL agrees with DuckDB (sf0.001)."""

import pytest

import __spark_entry__ as E
from tests.harness import compare, duck

SF = "/root/testdata/sf0.001"
KEYS = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_contract_shapes():
    qs, sqls = E.queries(), E.oracle_sql()
    assert set(sqls) <= set(qs) and len(qs) >= 100


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "publisher" in df.columns


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF)
    r = compare(df, con, E.oracle_sql()[key])
    assert r["cols_match"] and r["rows_match"] and r["values_match"], r
