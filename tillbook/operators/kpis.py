"""Aggregates over the daily store table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillbook.functions.measures import exact_mean, or_zero

KPI_COLUMNS = ("total_revenue", "avg_spend", "total_customers", "total_coffees")
MEAN_COLUMNS = ("avg_revenue", "avg_spend", "avg_customers", "avg_coffees")
MEASURES = ("revenue", "avg_spend", "customers", "coffees")


def only(condition: Column | None, value: Column) -> Column:
    """``value`` where the condition holds, else NULL."""
    return value if condition is None else F.when(condition, value)


def kpi_block(condition: Column | None = None) -> list[Column]:
    """Total revenue, mean of the daily average spends, customers and cups.

    The mean is taken over days and not weighted by customers.
    """
    revenue, spend, customers, coffees = (
        only(condition, F.col(name)) for name in MEASURES
    )
    block = (
        F.sum(revenue).cast("double"),
        exact_mean(spend),
        F.sum(customers),
        F.sum(coffees),
    )
    return [or_zero(value).alias(name) for value, name in zip(block, KPI_COLUMNS)]


def means(condition: Column | None = None) -> list[Column]:
    """Means of the four measures over days."""
    return [
        exact_mean(only(condition, F.col(measure))).alias(name)
        for measure, name in zip(MEASURES, MEAN_COLUMNS)
    ]


def per_store(rows: DataFrame, store: str | None, *aggregates: Column) -> DataFrame:
    """Aggregates of every store, or of one store, which always gives a row."""
    if store is None:
        return rows.groupBy("store").agg(*aggregates)
    return (
        rows.where(F.col("store") == store)
        .agg(*aggregates)
        .select(F.lit(store).alias("store"), "*")
    )
