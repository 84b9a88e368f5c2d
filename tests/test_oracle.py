"""Every registered query against its DuckDB equivalent; queries without one must return rows."""

import os

import pytest

import __spark_entry__ as e
from tests.compare import compare, duck

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = e.queries(), e.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    assert compare(spark, SF, QUERIES[name], ORACLES[name], con) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).columns
    QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()


def test_entry(spark):
    assert e.entry(spark).count() > 0
    assert e.entry(spark).columns == ["section", "item", "n"]
