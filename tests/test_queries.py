"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import compare
import pytest

import __spark_entry__ as entry_point
from tidegauge.plans.oracle import ORACLE
from tidegauge.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    found = QUERIES[name](spark, SF_DIR).toArrow()
    assert found.num_rows > 0
    assert compare.same(found, duck.sql(ORACLE[name]).to_arrow_table()) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_entry_lists_all_queries():
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(ORACLE) <= set(entry_point.oracle_sql())
