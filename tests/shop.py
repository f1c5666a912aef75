"""A coffee shop of a few rows, for rules that generated data cannot reach."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import SparkSession

from tillbook import RetailModel
from tillbook.sources.warehouse import STORE_GROUPS

DAILY = [
    ("Chesterfield", "2022-07-04", "100.00", "5.00", 20, 30),
    ("Chesterfield", "2022-07-05", "120.00", "6.00", 20, 36),
    ("Uppingham", "2022-07-04", "80.00", "4.00", 20, 25),
    ("Uppingham", "2022-07-06", "90.00", "4.50", 20, 28),
    ("London Soho", "2022-07-05", "200.00", "8.00", 25, 50),
]
TRANSACTIONS = [
    (1, "2022-07-04 09:15", "Chesterfield", 1),
    (2, "2022-07-05 09:15", "Chesterfield", 1),
    (3, "2022-07-05 09:40", "Chesterfield", 1),
    (4, "2022-07-05 12:05", "Chesterfield", 2),
    (5, "2022-07-04 12:30", "Uppingham", 2),
    (6, "2022-07-06 13:00", "Uppingham", 3),
    (7, "2022-07-05 15:00", "London Soho", 4),
    (8, "2022-07-05 16:00", "Chesterfield", 4),
]
ITEMS = [
    (1, "Latte", None, "Regular"),
    (2, "Latte", None, "Regular"),
    (2, "Latte", None, "Large"),
    (2, "Flavoured Latte", "Vanilla", "Large"),
    (3, "Latte", None, "Regular"),
    (3, None, None, "Regular"),
    (4, "Flavoured Latte", "Hazelnut", "Regular"),
    (5, "Latte", None, "Regular"),
    (6, "Mocha", None, "Regular"),
    (7, "Mocha", None, "Large"),
    (7, "Flavoured Latte", "Vanilla", "Regular"),
    (99, "Latte", None, "Regular"),
]


def daily_frame(spark: SparkSession, rows):
    values = [
        (store, dt.date.fromisoformat(day), Decimal(revenue), Decimal(spend), customers, coffees)
        for store, day, revenue, spend, customers, coffees in rows
    ]
    return spark.createDataFrame(
        values,
        "store string, day date, revenue decimal(28,2), avg_spend decimal(22,6),"
        " customers bigint, coffees bigint",
    )


def transactions_frame(spark: SparkSession, rows):
    values = [(i, dt.datetime.fromisoformat(ts), store, band) for i, ts, store, band in rows]
    return spark.createDataFrame(
        values, "transaction_id bigint, ts timestamp_ntz, store string, time_of_day int"
    )


def items_frame(spark: SparkSession, rows, price: str = "2.50"):
    values = [(*row, Decimal(price)) for row in rows]
    return spark.createDataFrame(
        values,
        "transaction_id bigint, item_name string, item_flavour string, item_size string,"
        " price decimal(18,2)",
    )


def shop(
    spark: SparkSession, transactions=TRANSACTIONS, items=ITEMS, daily=DAILY
) -> RetailModel:
    """The shop. With ``daily=None`` the daily table is derived from the items."""
    return RetailModel(
        transactions_frame(spark, transactions),
        items_frame(spark, items),
        STORE_GROUPS,
        given={} if daily is None else {"daily_store": daily_frame(spark, daily)},
    )
