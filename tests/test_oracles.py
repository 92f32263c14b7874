"""Every named query against its SQL in DuckDB, on whole tables."""

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.LLM_QUERIES)))
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, FOLDER).toArrow()
    assert got.num_rows > 0
    sql = entry.oracle_sql().get(name)
    if sql:
        assert compare(got, con.sql(sql).to_arrow_table()) is None


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
