"""Weeks of a store: their seven days, averages and availability."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillbook.functions import dates, text
from tillbook.functions.measures import impact_level, percent_of
from tillbook.model import RetailModel
from tillbook.operators.calendar import WEEK, day_flags, of_week, week_days
from tillbook.operators.kpis import means


def week_grid(
    model: RetailModel,
    store: str | None = None,
    iso_week: int | None = None,
    iso_year: int | None = None,
    absent_weeks: bool = False,
) -> DataFrame:
    """Seven rows per store and week; days without data keep NULL figures.

    With ``absent_weeks``, weeks without any data between those with data are there too.
    """
    days = week_days(
        model.daily_store,
        store=store,
        iso_week=iso_week,
        iso_year=iso_year,
        absent_weeks=absent_weeks,
    )
    return days.select(
        *WEEK,
        "iso_weekday",
        dates.weekday_name(F.col("iso_weekday")).alias("weekday_name"),
        "day",
        "fact.revenue",
        "fact.avg_spend",
        "fact.customers",
        "fact.coffees",
        F.col("fact").isNotNull().alias("has_data"),
    )


def week_commencing(
    model: RetailModel,
    store: str | None = None,
    iso_week: int | None = None,
    iso_year: int | None = None,
) -> DataFrame:
    rows = of_week(model.daily_store, store, iso_week, iso_year)
    monday = dates.week_commencing(F.col("day")).alias("week_commencing")
    return rows.select(*WEEK, monday).distinct()


def week_availability(
    model: RetailModel,
    store: str | None = None,
    iso_week: int | None = None,
    iso_year: int | None = None,
) -> DataFrame:
    """Which of the seven days have data, their number and share."""
    rows = of_week(model.daily_store, store, iso_week, iso_year)
    flags = rows.groupBy(*WEEK).agg(day_flags(F.col("day")).alias("week_array"))
    available = F.size(F.filter("week_array", lambda has_data: has_data))
    return flags.select(
        *WEEK,
        available.alias("days_available"),
        percent_of(available, F.lit(7)).alias("availability_pct"),
        "week_array",
    )


def week_day_lines(
    model: RetailModel,
    store: str | None = None,
    iso_week: int | None = None,
    iso_year: int | None = None,
) -> DataFrame:
    """One text per day of the week that says whether it has data."""
    grid = week_grid(model, store, iso_week, iso_year)
    state = F.when(
        F.col("has_data"), F.concat(F.lit("Available ["), F.col("day").cast("string"), F.lit("]"))
    ).otherwise("No Data")
    return grid.select(
        *WEEK, "iso_weekday", F.concat("weekday_name", F.lit(" - "), state).alias("line")
    )


def week_average(
    model: RetailModel,
    store: str | None = None,
    iso_week: int | None = None,
    iso_year: int | None = None,
) -> DataFrame:
    """Means of the four measures over the days of a week that have data."""
    rows = of_week(model.daily_store, store, iso_week, iso_year)
    return rows.groupBy(*WEEK).agg(*means())


def weekday_vs_week_average(
    model: RetailModel,
    store: str | None = None,
    iso_week: int | None = None,
    iso_year: int | None = None,
) -> DataFrame:
    """Revenue of each day against the week's mean, in amount, percent and level."""
    days = week_days(
        model.daily_store,
        F.try_divide(F.sum("revenue").cast("double"), F.sum("revenues")).alias("mean"),
        store=store,
        iso_week=iso_week,
        iso_year=iso_year,
    )
    return (
        days.select(
            *WEEK, "iso_weekday", "fact.revenue", "mean"
        )
        .withColumn("delta", F.col("revenue") - F.col("mean"))
        .withColumn("diff_pct", percent_of(F.col("delta"), F.col("mean")))
        .withColumn("impact_level", impact_level(F.col("diff_pct")))
        .drop("mean")
    )


def week_cards(
    model: RetailModel,
    store: str | None = None,
    iso_week: int | None = None,
    iso_year: int | None = None,
) -> DataFrame:
    """Each day of a week as texts, one row per figure; a day without data has ``N/A`` and no day.

    Revenue carries its difference from the mean of the week, whose percent is a figure of its own.
    """
    figures = week_days(
        model.daily_store,
        F.try_divide(F.sum("revenue").cast("double"), F.sum("revenues")).alias("mean"),
        store=store,
        iso_week=iso_week,
        iso_year=iso_year,
    ).withColumn("delta", F.col("fact.revenue") - F.col("mean"))
    absent = F.col("fact").isNull()
    shown = {
        "revenue": text.money(F.col("fact.revenue")),
        "difference": text.percent(percent_of(F.col("delta"), F.col("mean"))),
        "avg_spend": text.money(F.col("fact.avg_spend")),
        "customers": F.col("fact.customers").cast("string"),
        "coffees": F.col("fact.coffees").cast("string"),
    }
    cards = F.array(
        *[
            F.struct(
                F.lit(name).alias("figure"),
                F.when(absent, "N/A").otherwise(value).alias("value"),
                (F.when(absent, "-").otherwise(text.fixed_point(F.col("delta"))) if name == "revenue" else F.lit(None).cast("string")).alias("delta"),
            )
            for name, value in shown.items()
        ]
    )
    return figures.select(
        *WEEK,
        "iso_weekday",
        dates.weekday_name(F.col("iso_weekday")).alias("weekday_name"),
        F.when(absent, "-").otherwise(F.col("day").cast("string")).alias("day"),
        F.inline(cards),
    )
