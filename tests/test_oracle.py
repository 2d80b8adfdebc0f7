"""Every query against its SQL on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle_compare import connect, spark_result, sql_result
from presswork.plans.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def sql():
    with connect(SF_DIR) as connection:
        yield connection


def test_every_query_has_sql():
    assert set(QUERIES) <= set(queries())
    assert set(QUERIES) <= set(oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_query(name, spark, sql):
    columns, rows = spark_result(queries()[name](spark, SF_DIR))
    expected_columns, expected_rows = sql_result(sql, oracle_sql()[name])
    assert columns == expected_columns
    assert rows == expected_rows


def test_entry_gives_rows(spark):
    assert entry(spark).count() > 0
