"""User selections turned into row conditions.

Everything here works on parameters only: it returns plain values or a
``Column`` and never touches data.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, functions as F

from tillbook.functions.dates import as_date, date_lit

ALL = "All"
# The group names from strongest to weakest when several are picked
# together, and the sizes with the one that counts when none is picked first.
GROUP_ORDER = (ALL, "Only London", "Only Outside London")
SIZES = ("Regular", "Large")


def resolve_stores(
    picked: Sequence[str] | None, groups: Mapping[str, Sequence[str]]
) -> list[str] | None:
    """Stores a selection stands for; ``None`` means no restriction.

    No pick means all stores. Among several picks the strongest group wins over
    single stores.
    """
    picked = list(picked or [ALL])
    strongest = next((group for group in GROUP_ORDER if group in picked), None)
    if strongest == ALL:
        return None
    if strongest is not None:
        return list(groups[strongest])
    return picked


def in_stores(store: Column, stores: Sequence[str] | None) -> Column:
    return F.lit(True) if stores is None else store.isin(list(stores))


def of_store(rows: DataFrame, store: str | None) -> DataFrame:
    return rows if store is None else rows.where(F.col("store") == store)


def check_range(start: dt.date | str, end: dt.date | str) -> tuple[dt.date, dt.date]:
    first, last = as_date(start), as_date(end)
    if first > last:
        raise ValueError(f"start date {first} is after the end date {last}")
    return first, last


def within(
    rows: DataFrame, start: dt.date | str | None = None, end: dt.date | str | None = None
) -> DataFrame:
    """Rows from ``start`` to ``end``, both included; an end left out is open.

    On a table without ``day`` the condition is a half-open range on the raw ``ts``,
    which the parquet reader can test against its min/max statistics. A table laid
    out by ``month`` is pruned to those folders first, and one that carries the text
    of its ISO times as ``ts_text`` or their instants as ``ts_instant`` is tested on that as well,
    which can be pushed down.
    """
    if start is not None and end is not None:
        check_range(start, end)
    columns = set(rows.columns)
    if "ts_text" in columns:
        if start is not None:
            rows = rows.where(F.col("ts_text") >= str(as_date(start)))
        if end is not None:
            rows = rows.where(F.col("ts_text") < str(as_date(end) + dt.timedelta(days=1)))
    if "ts_instant" in columns:
        zone = rows.schema["ts_instant"].metadata["zone"]
        if start is not None:
            rows = rows.where(F.col("ts_instant") >= F.lit(min(day_begins(as_date(start), zone))))
        if end is not None:
            following = as_date(end) + dt.timedelta(days=1)
            rows = rows.where(F.col("ts_instant") < F.lit(max(day_begins(following, zone))))
    if start is not None:
        first = as_date(start)
        if "month" in columns:
            rows = rows.where(F.col("month") >= F.lit(first.replace(day=1)))
        rows = rows.where(
            F.col("day") >= F.lit(first) if "day" in columns else F.col("ts") >= _midnight(first)
        )
    if end is not None:
        last = as_date(end)
        if "month" in columns:
            rows = rows.where(F.col("month") <= F.lit(last.replace(day=1)))
        rows = rows.where(
            F.col("day") <= F.lit(last)
            if "day" in columns
            else F.col("ts") < _midnight(last + dt.timedelta(days=1))
        )
    return rows


def on_day(rows: DataFrame, day: dt.date | str | None) -> DataFrame:
    return rows if day is None else within(rows, day, day)


def day_begins(day: dt.date, zone: str) -> tuple[dt.datetime, dt.datetime]:
    """The instants at which a day begins in a zone: two if clocks show its midnight twice, else the same one twice.

    A midnight that clocks skip stands for the instant at which they skip it. The rules of the zone
    give the days on which clocks change 23 or 25 hours.
    """
    midnight = dt.datetime.combine(day, dt.time(), ZoneInfo(zone))
    both = [midnight.replace(fold=fold).astimezone(dt.timezone.utc) for fold in (0, 1)]
    return min(both), max(both)


def _midnight(day: dt.date) -> Column:
    return F.lit(str(dt.datetime.combine(day, dt.time()))).cast("timestamp_ntz")


def in_range(day: Column, start: dt.date | str, end: dt.date | str) -> Column:
    """Both ends included."""
    return day.between(date_lit(start), date_lit(end))


def has_flavour(
    flavour: Column, picked: Sequence[str | None], first_listed: Column
) -> Column:
    """Flavour is one of the picks, where NULL can be picked like any other.

    No pick falls back to ``first_listed``, the flavour the item lists first.
    """
    if not picked:
        return flavour.eqNullSafe(first_listed)
    named = [name for name in picked if name is not None]
    condition = flavour.isin(named) if named else F.lit(False)
    return condition | flavour.isNull() if None in picked else condition


def has_size(size: Column, picked: Sequence[str]) -> Column:
    return size.isin(list(picked) or [SIZES[0]])
