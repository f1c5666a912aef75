"""Expected days matched with days that have data."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from tillbook.functions import dates
from tillbook.functions.measures import exact_mean
from tillbook.operators.selection import of_store, within

WEEK = ("store", "iso_year", "iso_week")


def with_week(rows: DataFrame) -> DataFrame:
    """Add the ISO year and week of ``day``."""
    day = F.col("day")
    return rows.withColumns(
        {"iso_year": dates.iso_year(day), "iso_week": dates.iso_week(day)}
    )


def of_week(
    rows: DataFrame, store: str | None, iso_week: int | None, iso_year: int | None
) -> DataFrame:
    """Rows of a store and week with their ISO year and week.

    Where both are known the week is a range of days, which prunes months; a week of
    every year can't be pruned, nor a year, which begins and ends within weeks.
    """
    rows = of_store(rows, store)
    if iso_week is not None and iso_year is not None:
        monday = dt.date.fromisocalendar(iso_year, iso_week, 1)
        rows = within(rows, monday, monday + dt.timedelta(days=6))
    rows = with_week(rows)
    if iso_week is not None:
        rows = rows.where(F.col("iso_week") == iso_week)
    if iso_year is not None:
        rows = rows.where(F.col("iso_year") == iso_year)
    return rows


def week_days(
    daily_store: DataFrame,
    *aggregates: Column,
    store: str | None = None,
    iso_week: int | None = None,
    iso_year: int | None = None,
    absent_weeks: bool = False,
) -> DataFrame:
    """All seven days of every week in which a store has data.

    ``fact`` holds the measures of a day and is NULL on a day without data. Should a
    store have several rows for a day, they are added up and their average spends
    averaged, as in the other reports. ``aggregates`` of the week ride along; they are over
    its days. With ``absent_weeks`` the weeks between a store's first and last
    day that have no data are there too.

    Rows are folded per day, so the list of a week has at most seven entries.
    """
    facts = of_week(daily_store, store, iso_week, iso_year)
    measures = F.struct(
        F.sum("revenue").cast("double").alias("revenue"),
        exact_mean(F.col("avg_spend")).alias("avg_spend"),
        F.sum("customers").alias("customers"),
        F.sum("coffees").alias("coffees"),
    )
    exact = [F.sum("revenue").alias("revenue"), F.count("revenue").alias("revenues")]
    by_day = facts.groupBy(*WEEK, "day").agg(measures.alias("fact"), *exact)
    entry = F.struct(dates.iso_weekday(F.col("day")), "fact")
    weeks = (
        by_day.withColumn("monday", dates.week_commencing(F.col("day")))
        .groupBy(*WEEK, "monday")
        .agg(F.collect_list(entry).alias("facts"), *aggregates)
    )
    if absent_weeks:
        expected = of_week_of(_weeks_between(of_store(daily_store, store)), iso_week, iso_year)
        weeks = expected.join(weeks, [*WEEK, "monday"], "left")
    held = F.map_from_entries(F.coalesce("facts", F.array()))
    days = F.array(
        *(
            F.struct(
                F.lit(number).alias("iso_weekday"),
                F.date_add("monday", number - 1).alias("day"),
                F.try_element_at("held", F.lit(number)).alias("fact"),
            )
            for number in range(1, 8)
        )
    )
    return weeks.withColumn("held", held).select("*", F.inline(days)).drop("held", "facts", "monday")


def _weeks_between(daily_store: DataFrame) -> DataFrame:
    """(store, monday) of all weeks from a store's first day to its last."""
    bounds = daily_store.groupBy("store").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    ends = (dates.week_commencing(F.col(name)) for name in ("first", "last"))
    mondays = F.sequence(*ends, F.expr("interval 7 days"))
    return bounds.where(F.col("first").isNotNull()).select("store", F.explode(mondays).alias("monday"))


def of_week_of(mondays: DataFrame, iso_week: int | None, iso_year: int | None) -> DataFrame:
    """(store, iso_year, iso_week, monday) of the weeks asked for."""
    monday = F.col("monday")
    rows = mondays.select("store", dates.iso_year(monday).alias("iso_year"), dates.iso_week(monday).alias("iso_week"), "monday")
    for name, value in (("iso_week", iso_week), ("iso_year", iso_year)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows


def day_flags(day: Column) -> Column:
    """Which of the seven days of a week occur, Monday first, from one number with a bit for each."""
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1), dates.iso_weekday(day) - 1))
    return F.transform(F.array(*map(F.lit, range(7))), lambda place: F.getbit(bits, place) == 1)
