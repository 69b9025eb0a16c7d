"""Every registered query against its SQL, on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from freshet.catalog import ORACLES, QUERIES
from tests.oracle import compare



@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, duck, small_dir, name):
    assert compare(spark, duck, queries()[name], oracle_sql()[name], small_dir) == ""


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_every_query_of_the_catalog_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    rows = entry(spark).collect()
    assert [r["flood_event"] for r in rows] == [0, 1]
