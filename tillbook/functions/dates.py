"""Date and time expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

WEEKDAY_NAMES = (
    "Monday",
    "Tuesday",
    "Wednesday",
    "Thursday",
    "Friday",
    "Saturday",
    "Sunday",
)


def as_date(day: dt.date | str) -> dt.date:
    """Accept a date or an ISO ``YYYY-MM-DD`` text."""
    if isinstance(day, dt.datetime):
        return day.date()
    if isinstance(day, dt.date):
        return day
    return dt.date.fromisoformat(day)


def date_lit(day: dt.date | str) -> Column:
    return F.lit(as_date(day))


def day_before(day: Column) -> Column:
    return F.date_sub(day, 1)


def inclusive_days(start: Column, end: Column) -> Column:
    """Number of calendar days from ``start`` to ``end``, both counted."""
    return F.datediff(end, start) + 1


def iso_year(day: Column) -> Column:
    """The year the ISO week of ``day`` belongs to."""
    return F.extract(F.lit("YEAROFWEEK"), day)


def iso_week(day: Column) -> Column:
    return F.weekofyear(day)


def iso_weekday(day: Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(day) + 1


def week_commencing(day: Column) -> Column:
    """The Monday of the week of ``day``."""
    return F.trunc(day, "week")


def weekday_name(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAY_NAMES)), number)
