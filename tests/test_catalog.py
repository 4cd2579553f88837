"""Every registered query next to its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check_sql import connect, difference

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert len(got.columns) > 0
    if name in SQL:
        assert difference(got, con.execute(SQL[name]).df()) == ""


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 200
