"""Every query against its SQL on the smallest tables, and the shape of the registry."""

import pytest

import __spark_entry__ as entry_points
from compare import differences, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    out = entry_points.entry(spark)
    assert out.columns == ["key", "n"] and out.count() == 20


def test_sql_belongs_to_queries():
    assert set(ORACLES) <= set(QUERIES)
