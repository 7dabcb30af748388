"""Every query that has SQL gives what the SQL gives, on the smallest tables."""

import os

import oracle
import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    columns, rows = oracle.rows_of_spark(QUERIES[name](spark, SF_DIR))
    want_columns, want = oracle.rows_of_sql(con, SQL[name])
    assert columns == want_columns and rows == want
