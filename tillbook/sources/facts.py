"""Fact tables that lie together: both in buckets of transaction_id, so that their join moves no row.

:func:`save_facts` shuffles each table once and writes it; every later join of the two, a refresh
of the summaries or a report on single timestamps, reads bucket against bucket. A bucket is read
by one task: choose ``buckets`` so that one of items has some 256 MB. A transaction with very many items
makes its bucket longer, but is streamed through the join and folded row by row.
"""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from tillbook.model import RetailModel

KEY = "transaction_id"


def _described(table: DataFrame) -> list[list[str]]:
    return [[field.name, field.dataType.simpleString()] for field in table.schema]


def save_facts(model: RetailModel, folder: str, buckets: int) -> None:
    """Write both fact tables into a new folder; their description is written last."""
    spark, tables = model.transactions.sparkSession, {}
    for name in ("transactions", "items"):
        table, path = getattr(model, name), f"{folder}/{name}"
        own = f"tillbook_{uuid4().hex}"
        rows = table.repartition(buckets, KEY).write.bucketBy(buckets, KEY).sortBy(KEY)
        rows.format("parquet").option("path", path).mode("error").saveAsTable(own)
        spark.sql(f"DROP TABLE {own}")  # its files stay
        tables[name] = _described(table)
    about = json.dumps({"buckets": buckets, "tables": tables})
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("error").text(f"{folder}/facts")


def facts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The saved ``transactions`` and ``items``, as arguments of a :class:`~tillbook.model.RetailModel`."""
    about = json.loads(spark.read.text(f"{folder}/facts").first()["value"])
    found = {}
    for name, columns in about["tables"].items():
        listed = ", ".join(f"`{column}` {kind}" for column, kind in columns)
        own = f"tillbook_{uuid4().hex}"
        place = f"{folder}/{name}".replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {own} ({listed}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY})"
            f" INTO {about['buckets']} BUCKETS LOCATION '{place}'"
        )
        found[name] = spark.table(own)
    return found
