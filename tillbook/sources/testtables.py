"""The generated star-schema tables seen as retail tables.

The generated tables know neither stores nor cups, so regions stand for stores,
events for transactions and parts for items. Only this module knows the mapping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillbook.model import RetailModel
from tillbook.sources.kept import is_folder, keep_for_application

INPUTS = ("events", "customer", "nation", "region", "lineitem", "part")

# The part nouns sold without a flavour, and the regions that
# stand for the two store groups.
PLAIN_ITEMS = ("bolt", "rod")
STORE_GROUPS = {
    "All": ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"),
    "Only London": ("AMERICA", "EUROPE"),
    "Only Outside London": ("AFRICA", "ASIA", "MIDDLE EAST"),
}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def transactions(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Events, of the folder if none are given, with the region of their user's nation as the store.

    The events stream through one join after the other. Whether the other side is
    broadcast is left to Spark, which decides by the size of the files.
    """
    user_nation = _read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("n_nationkey")
    )
    nation_store = (
        _read(spark, sf_dir, "nation")
        .join(
            _read(spark, sf_dir, "region"),
            F.col("n_regionkey") == F.col("r_regionkey"),
        )
        .select("n_nationkey", F.col("r_name").alias("store"))
    )
    hour = F.hour("ts")
    return (
        (_read(spark, sf_dir, "events") if events is None else events)
        .select(F.col("event_id").alias("transaction_id"), "ts", "user_id")
        .join(user_nation, "user_id")
        .join(nation_store, "n_nationkey")
        .select(
            "transaction_id",
            "ts",
            "store",
            F.when(hour < 11, 1)
            .when(hour < 13, 2)
            .when(hour < 15, 3)
            .otherwise(4)
            .alias("time_of_day"),
        )
    )


def transactions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream of the files of the events.

    A stream takes a plain path for a folder, so a table that is a single file is named by a pattern.
    """
    schema = _read(spark, sf_dir, "events").schema
    name = "events.parquet" if is_folder(spark, f"{sf_dir}/events.parquet") else "[e]vents.parquet"
    return transactions(spark, sf_dir, spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with the two words of the part name as flavour and item."""
    word = {n: F.split_part("p_name", F.lit(" "), F.lit(n)) for n in (1, 2)}
    kinds = _read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        word[2].alias("item_name"),
        F.when(~word[2].isin(*PLAIN_ITEMS), word[1]).alias("item_flavour"),
        F.when(F.col("p_size") > 25, "Large").otherwise("Regular").alias("item_size"),
    )
    return (
        _read(spark, sf_dir, "lineitem")
        .select(
            F.col("l_orderkey").alias("transaction_id"),
            "l_partkey",
            F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        )
        .join(kinds, "l_partkey")
        .select("transaction_id", "item_name", "item_flavour", "item_size", "price")
    )


def load(spark: SparkSession, sf_dir: str, keep_summaries: bool = True) -> RetailModel:
    """The retail tables of one folder of generated tables."""
    inputs = [f"{sf_dir}/{table}.parquet" for table in INPUTS]
    where = {"keep": keep_for_application(spark, inputs, version=__name__)} if keep_summaries else {}
    return RetailModel(
        lambda: transactions(spark, sf_dir),
        lambda: items(spark, sf_dir),
        STORE_GROUPS,
        **where,
    )
