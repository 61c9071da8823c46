"""Every query with SQL gives the rows that the SQL gives on the same tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, rows


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    ours = entry.queries()[name](spark, sf_dir).toPandas()
    theirs = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_has_rows_and_a_schema(spark, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    assert df.columns
    assert df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
