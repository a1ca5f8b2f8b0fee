"""Each registered query against its SQL on the smallest tables."""

import __spark_entry__ as entry
import pytest
from compare import connect, differences

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 11


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert differences(entry.queries()[name](spark, FOLDER), con, SQL[name]) == []
