"""Every operator's query that SQL can express, against that SQL; and the registry."""

import pytest

import __spark_entry__ as registry
from compare import TEST_DATA, spark_rows, sql_rows, tables
from tillbook.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, name, folder):
    path = f"{TEST_DATA}/{folder}"
    frame = QUERIES[name](spark, path)
    columns, expected = sql_rows(tables(path), SQL[name])
    assert sorted(frame.columns) == columns
    actual = spark_rows(frame)
    assert actual == expected
    assert actual


def test_all_are_registered():
    assert set(QUERIES) <= set(registry.queries())
    assert set(SQL) <= set(registry.oracle_sql())
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")}) == list(range(1, 14))
