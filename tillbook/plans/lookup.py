"""Reports by the keys a user of the dashboard asks for."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from tillbook.functions.dates import date_lit, day_before, iso_week
from tillbook.model import RetailModel
from tillbook.plans import kpi, store as stores

Day = dt.date | str

# The days a range covers when none is named.
DEFAULT_RANGE = ("2022-06-07", "2022-07-05")


def basic_date(
    model: RetailModel, which: str, as_of: Day | None = None
) -> DataFrame | None:
    """``current``, ``yesterday`` or ``first``; ``None`` for any other key."""
    column = {"current": "as_of", "yesterday": "yesterday", "first": "first_day"}.get(which)
    return None if column is None else kpi.date_bounds(model, as_of).select(column)


def previous_day(model: RetailModel, day: Day) -> DataFrame:
    return model.daily_store.sparkSession.range(1).select(day_before(date_lit(day)).alias("day"))


def previous_days(model: RetailModel) -> DataFrame:
    """Every day with data and the day before it."""
    return model.daily_store.select("day", day_before(F.col("day")).alias("previous_day")).distinct()


def store_breakdown(
    model: RetailModel,
    store: str,
    wanted: str = "alltime",
    between: tuple[Day, Day] = DEFAULT_RANGE,
) -> DataFrame | int:
    """The figure of a store a key stands for; 0 for an unknown key.

    The keys are fixed values.
    """
    start, end = between
    days = model.daily_store.where(F.col("store") == store)
    reports = {
        "alltime": lambda: stores.store_revenue_alltime(model, store).select("total_revenue"),
        "alltimedates": lambda: stores.store_daily_revenue(model, store).select("revenue", "day"),
        "justdays": lambda: stores.total_days(model),
        "thesedays": lambda: stores.store_days_in_range(model, store, start, end).select("n_days"),
        "weekofyear": lambda: days.select(iso_week(F.col("day")).alias("iso_week")).distinct().orderBy("iso_week"),
        "datesavgrevenue": lambda: stores.range_revenue(model, store, start, end).select(
            "range_revenue"
        ),
        "avgcsfordates": lambda: stores.range_revenue(model, store, start, end).select(
            "range_avg_spend"
        ),
        "avgcs": lambda: stores.store_alltime_averages(model, store).select("avg_spend"),
        "avgcusts": lambda: stores.store_alltime_averages(model, store).select("avg_customers"),
        "avgcups": lambda: stores.store_alltime_averages(model, store).select("avg_coffees"),
    }
    return reports[wanted]() if wanted in reports else 0
