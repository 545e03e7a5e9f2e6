"""Every registered query with SQL against DuckDB, on the smallest data."""

import pytest
from compare import connect, difference

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
CHECKS = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(queries())


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_sql(spark, con, name):
    assert difference(spark, con, FOLDER, queries()[name], CHECKS[name]) == ""


def test_entry(spark):
    assert entry(spark).count() > 0
