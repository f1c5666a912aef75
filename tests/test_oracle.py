"""Every registered query against its SQL at two scales, value for value."""

import pytest

import __spark_entry__ as registry
from compare import TEST_DATA, spark_rows, sql_rows, tables

QUERIES = {name: registry.queries()[name] for name in registry.REPORTS}
SQL = registry.oracle_sql()


def test_every_query_has_sql():
    assert set(QUERIES) <= set(SQL)
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01"])
def folder(request):
    return f"{TEST_DATA}/{request.param}"


@pytest.fixture(scope="module")
def connection(folder):
    return tables(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, folder, connection, name):
    frame = QUERIES[name](spark, folder)
    columns, expected = sql_rows(connection, SQL[name])
    assert sorted(frame.columns) == columns
    actual = spark_rows(frame)
    assert len(actual) == len(expected)
    assert actual == expected
    assert actual


def test_entry(spark):
    assert registry.entry(spark).columns == ["store", "day", "the_hour", "item_name", "cups_sold"]
