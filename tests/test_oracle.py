"""Every registered query against its DuckDB oracle on sf0.001 (the driver does the
same on sf0.01; ``python tests/oracle_check.py`` runs that locally)."""

import pytest

import __spark_entry__ as E
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES = E.queries()
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    res = compare(spark, key, QUERIES[key], SQL.get(key), SF, con)
    assert res["status"] in ("match", "rows-only"), res
    assert res["rows"] > 0


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["vec_id", "logits"]
    assert df.count() == 500
