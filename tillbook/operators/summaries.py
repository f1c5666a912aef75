"""The fact join and the summary tables the reports read.

Each is folded from the facts as early as its rows allow, or from what was folded before:

``sold``         every item sold with the time and store of its transaction; only
                 reports of single timestamps need it
``daily_store``  one row per store and day, from items added up per transaction
``store_days``   one row per store and day with any transaction, sold items or not
``store_months`` the days of those as the bits of a number, one row per store and month
``store_balances`` running totals of ``daily_store`` up to the end of each month
``item_hours``   cups per store, day, hour, band, item, flavour and size
``item_kinds``   cups per store, band, item, flavour and size; doesn't grow with days
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_KIND = "item_name string, item_flavour string, item_size string"
# Columns of the summaries as stored. Those with days are laid out by their month.
SCHEMAS = {
    "sold": (
        f"store string, ts timestamp_ntz, time_of_day int, transaction_id bigint, {_KIND},"
        " price decimal(18,2), day date, month date"
    ),
    "daily_store": (
        "store string, revenue decimal(28,2), avg_spend decimal(22,6), customers bigint,"
        " coffees bigint, day date, month date"
    ),
    "store_days": "store string, n_transactions bigint, day date, month date",
    "store_months": "store string, days int, month date",
    "store_balances": (
        "store string, revenue decimal(38,2), avg_spend decimal(38,6), customers bigint, coffees bigint,"
        " n_revenue bigint, n_avg_spend bigint, n_customers bigint, n_coffees bigint, month date"
    ),
    "item_hours": (
        f"store string, the_hour int, time_of_day int, {_KIND}, cups bigint, day date, month date"
    ),
    "item_kinds": f"store string, time_of_day int, {_KIND}, cups bigint",
}
# What rows of a month are sorted by, so that parquet statistics can skip.
ORDER = {
    "sold": ("day", "store"),
    "daily_store": ("store", "day"),
    "store_days": ("store", "day"),
    "store_months": ("store", "month"),
    "store_balances": ("store", "month"),
    "item_hours": ("store", "item_name", "day"),
    "item_kinds": ("store", "item_name"),
}
ITEM_HOUR_KEYS = (
    "store",
    "day",
    "the_hour",
    "time_of_day",
    "item_name",
    "item_flavour",
    "item_size",
)


def sold_items(transactions: DataFrame, items: DataFrame) -> DataFrame:
    """Every item sold with its transaction.

    Both sides may be huge, so nothing is hinted: the join shuffles on
    ``transaction_id`` and adaptive execution splits the partition of a transaction
    that holds too many items.
    """
    return items.join(transactions, "transaction_id", "inner")


def sold(transactions: DataFrame, items: DataFrame) -> DataFrame:
    """The join of the facts with the day of each row; each fact table is shuffled once."""
    visits = transactions.select("transaction_id", "store", "ts", "time_of_day")
    kinds = items.select("transaction_id", "item_name", "item_flavour", "item_size", "price")
    return sold_items(visits, kinds).select(
        "store",
        "ts",
        "time_of_day",
        "transaction_id",
        "item_name",
        "item_flavour",
        "item_size",
        "price",
        F.to_date("ts").alias("day"),
    )


def baskets(items: DataFrame) -> DataFrame:
    """Revenue and cups of each transaction.

    Items are added up before they are shuffled, so a transaction with very many
    items is one row per task, and no other column of an item leaves its task.
    """
    return items.groupBy("transaction_id").agg(
        F.sum("price").alias("revenue"), F.count("item_name").alias("coffees")
    )


def daily_store(transactions: DataFrame, items: DataFrame) -> DataFrame:
    """Revenue, average spend, customers and cups per store and day.

    Items are folded per transaction first and then joined with the transactions, whose
    join leaves them by transaction: the next fold needs no shuffle. A transaction
    that the table holds twice for a store and day is one customer who paid twice.
    """
    visits = transactions.select("transaction_id", "store", F.to_date("ts").alias("day"))
    return _daily(baskets(items).join(visits, "transaction_id"))


def daily_store_of(sold: DataFrame) -> DataFrame:
    """The same from the joined facts, where they are a table already."""
    rows = sold.select(
        "store", "day", "transaction_id", F.col("price").alias("revenue"), F.when(F.col("item_name").isNotNull(), 1).alias("coffees")
    )
    return _daily(rows)


def _daily(parts: DataFrame) -> DataFrame:
    """Days of stores from parts of transactions: (store, day, transaction_id, revenue, coffees)."""
    visits = parts.groupBy("store", "day", "transaction_id").agg(
        F.sum("revenue").alias("revenue"), F.coalesce(F.sum("coffees"), F.lit(0)).alias("coffees")
    )
    totals = visits.groupBy("store", "day").agg(
        F.sum("revenue").cast("decimal(28,2)").alias("revenue"),
        F.count("*").alias("customers"),
        F.sum("coffees").alias("coffees"),
    )
    return totals.select(
        "store",
        "revenue",
        (F.col("revenue") / F.col("customers")).cast("decimal(22,6)").alias("avg_spend"),
        "customers",
        "coffees",
        "day",
    )


def store_days(transactions: DataFrame) -> DataFrame:
    """Days on which a store has at least one transaction."""
    return (
        transactions.groupBy("store", F.to_date("ts").alias("day"))
        .agg(F.count("*").alias("n_transactions"))
        .select("store", "n_transactions", "day")
    )


def month_bits(day: Column) -> Column:
    """A number with the bit of each day of a month that occurs; of two such numbers, bit_or has the days of both."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1), F.dayofmonth(day) - 1))


def store_months(store_days: DataFrame) -> DataFrame:
    """The days of each store and month as bits."""
    return store_days.groupBy("store", F.trunc("day", "month").alias("month")).agg(
        month_bits(F.col("day")).alias("days")
    ).select("store", "days", "month")


def store_balances(daily_store: DataFrame) -> DataFrame:
    """Totals of each store from its first day to the end of each month with data.

    Beside each sum stands the number of days that have the measure, as plain means over days are asked
    for. The window holds the months of one store.
    """
    measures = ("revenue", "avg_spend", "customers", "coffees")
    months = daily_store.groupBy("store", F.trunc("day", "month").alias("month")).agg(
        *(F.sum(name).alias(name) for name in measures), *(F.count(name).alias(f"n_{name}") for name in measures)
    )
    so_far = Window.partitionBy("store").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    kinds = {"revenue": "decimal(38,2)", "avg_spend": "decimal(38,6)"}
    totals = {
        name: F.coalesce(F.sum(name).over(so_far), F.lit(0)).cast(kinds.get(name, "bigint"))
        for name in (*measures, *(f"n_{name}" for name in measures))
    }
    return months.select("store", *(total.alias(name) for name, total in totals.items()), "month")


def item_hours(sold: DataFrame) -> DataFrame:
    """Cups per store, day, hour, band and kind of item.

    A cup is an item with a name; a row of nameless items stays, with 0 cups.
    """
    return (
        sold.withColumn("the_hour", F.hour("ts"))
        .groupBy(*ITEM_HOUR_KEYS)
        .agg(F.count("item_name").alias("cups"))
        .select(*[key for key in ITEM_HOUR_KEYS if key != "day"], "cups", "day")
    )


def item_kinds(item_hours: DataFrame) -> DataFrame:
    """Cups per store, band and kind of item over all days."""
    keys = [key for key in ITEM_HOUR_KEYS if key not in ("day", "the_hour")]
    return item_hours.groupBy(*keys).agg(F.sum("cups").alias("cups"))
