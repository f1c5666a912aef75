"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import glob
import os

import duckdb

TEST_DATA = "/root/testdata"


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        source = path if os.path.isfile(path) else f"{path}/**/*.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
    return connection


def sort_key(row: tuple) -> tuple:
    return tuple((value is None, str(value)) for value in row)


def spark_rows(frame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted((tuple(row) for row in frame.select(*columns).collect()), key=sort_key)


def sql_rows(connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    relation = connection.sql(sql)
    columns = sorted(relation.columns)
    quoted = ", ".join(f'"{name}"' for name in columns)
    return columns, sorted(relation.project(quoted).fetchall(), key=sort_key)
