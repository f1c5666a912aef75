"""The coffee-shop tables in their own layout.

Column names on the left are those of the warehouse, on the right ours.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, TimestampType

from tillbook.model import RetailModel
from tillbook.sources.kept import keep_for_application

# The five stores and the two groups of them.
STORE_GROUPS = {
    "All": ("Uppingham", "Longridge", "Chesterfield", "London Camden", "London Soho"),
    "Only London": ("London Camden", "London Soho"),
    "Only Outside London": ("Uppingham", "Longridge", "Chesterfield"),
}


def daily_store(table: DataFrame) -> DataFrame:
    """One row per store and day, as the warehouse keeps it."""
    return table.select(
        F.col("store_name").alias("store"),
        F.col("total_revenue_for_day").cast("decimal(28,2)").alias("revenue"),
        F.col("avg_spend_per_customer_for_day").cast("decimal(22,6)").alias("avg_spend"),
        F.col("total_customers_for_day").cast("bigint").alias("customers"),
        F.col("total_coffees_sold_for_day").cast("bigint").alias("coffees"),
        F.to_date("current_day").alias("day"),
    )


def transactions(table: DataFrame, zone: str | None = None, iso_text: bool = False) -> DataFrame:
    """One row per transaction; the time may be a timestamp or its text.

    A timestamp with a zone becomes the wall-clock time of ``zone``, or of the session if none is
    named. Days asked for are pushed down to the scan for a timestamp, with ``zone`` as the instants at
    which its days begin, and with ``iso_text`` for text of the form ``YYYY-MM-DD hh:mm:ss``, whose order is that of time.
    Other text is parsed row by row, so a day scans the whole table.
    """
    column, kind = F.col("timestamp"), table.schema["timestamp"].dataType
    time = column.cast("timestamp_ntz")
    if isinstance(kind, TimestampType) and zone is not None:
        time = F.convert_timezone(F.current_timezone(), F.lit(zone), time)
    instant = []
    if isinstance(kind, TimestampType) and zone is not None:
        # the instant itself, so that a day can be tested on the column that the scan reads
        instant = [column.alias("ts_instant", metadata={"zone": zone})]
    text = [column.alias("ts_text")] if iso_text and isinstance(kind, StringType) else []
    return table.select(
        "transaction_id",
        time.alias("ts"),
        "store",
        F.col("time_of_day").cast("int").alias("time_of_day"),
        *text,
        *instant,
    )


def items(table: DataFrame) -> DataFrame:
    """One row per item sold. The warehouse keeps no item price."""
    price = F.col("price") if "price" in table.columns else F.lit(None)
    return table.select(
        "transaction_id",
        "item_name",
        "item_flavour",
        "item_size",
        price.cast("decimal(18,2)").alias("price"),
    )


def load(
    spark: SparkSession,
    daily: DataFrame,
    customer_data: DataFrame,
    customer_items: DataFrame,
    inputs: Sequence[str] = (),
    given: Mapping[str, DataFrame] | None = None,
    zone: str | None = None,
    iso_text: bool = False,
) -> RetailModel:
    """The model over the three warehouse tables, read by any Spark source.

    With the paths of all three tables as ``inputs`` (of the daily one only if it is read from
    files), summaries are kept for the application. Else, and without ``given`` summaries from
    :func:`~tillbook.sources.kept.saved`, every report joins the two last tables itself.
    Ids of transactions keep their type, which must be one in both tables.
    """
    where = {"keep": keep_for_application(spark, inputs)} if inputs else {}
    return RetailModel(
        transactions(customer_data, zone, iso_text),
        items(customer_items),
        STORE_GROUPS,
        given={**(given or {}), "daily_store": daily_store(daily)},
        **where,
    )
