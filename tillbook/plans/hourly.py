"""Cups by time and item, the insights drawn from them, and item comparisons."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tillbook.functions import text
from tillbook.functions.measures import exact_mean, or_zero
from tillbook.model import RetailModel
from tillbook.operators.selection import SIZES, has_flavour, has_size, of_store, on_day

Day = dt.date | str


def cups_by_timestamp_item(
    model: RetailModel, store: str | None = None, day: Day | None = None
) -> DataFrame:
    """Cups per full timestamp and item; a nameless item gives a row with 0 cups."""
    return (
        on_day(of_store(model.sold, store), day)
        .groupBy("store", "ts", "item_name")
        .agg(F.count("item_name").alias("cups_sold"))
        .select("store", "ts", F.hour("ts").alias("the_hour"), "item_name", "cups_sold")
    )


def _cells(model: RetailModel, store: str | None, day: Day | None = None) -> DataFrame:
    return on_day(of_store(model.item_hours, store), day)


def cups_by_hour_item(
    model: RetailModel, store: str | None = None, day: Day | None = None
) -> DataFrame:
    return (
        _cells(model, store, day)
        .groupBy("store", "day", "the_hour", "item_name")
        .agg(F.sum("cups").alias("cups_sold"))
    )


def hourly_insights(
    model: RetailModel, store: str | None = None, day: Day | None = None
) -> DataFrame:
    """Worst and best hour, mean of the hourly totals and the hours that reach it.

    On equal cups the earliest hour is the worst and the latest the best. Only
    hours with sales count for the mean. A list holds at most 24 hours.
    """
    hours = (
        _cells(model, store, day)
        .groupBy("store", "day", "the_hour")
        .agg(F.sum("cups").alias("cups"))
    )
    one_day = store is not None and day is not None
    ranked = F.struct("cups", "the_hour")
    found = (hours if one_day else hours.groupBy("store", "day")).agg(
        F.min(ranked).alias("worst"),
        F.max(ranked).alias("best"),
        or_zero(exact_mean(F.col("cups"))).alias("avg_hour_cups"),
        F.collect_list(ranked).alias("hours"),
    )
    keys = (
        [F.lit(store).alias("store"), F.lit(day).cast("date").alias("day")]
        if one_day
        else [F.col("store"), F.col("day")]
    )
    busy = F.filter("hours", lambda hour: hour["cups"] >= F.col("avg_hour_cups"))
    return found.select(
        *keys,
        F.col("worst.the_hour").alias("worst_hour"),
        F.col("worst.cups").alias("worst_cups"),
        F.col("best.the_hour").alias("best_hour"),
        F.col("best.cups").alias("best_cups"),
        "avg_hour_cups",
        text.hours_text(F.transform(busy, lambda hour: hour["the_hour"])).alias(
            "hours_above_avg"
        ),
        text.hour_cups_label(F.col("worst.the_hour"), F.col("worst.cups")).alias(
            "worst_label"
        ),
        text.hour_cups_label(F.col("best.the_hour"), F.col("best.cups")).alias(
            "best_label"
        ),
    )


def store_items(model: RetailModel, store: str | None = None) -> DataFrame:
    return of_store(model.item_kinds, store).select("store", "item_name").distinct()


def item_flavours(
    model: RetailModel, store: str | None = None, item: str | None = None
) -> DataFrame:
    """Flavours of the items of a store, where no flavour (NULL) is one of them."""
    rows = of_store(model.item_kinds, store)
    if item is not None:
        rows = rows.where(F.col("item_name") == item)
    return rows.select("store", "item_name", "item_flavour").distinct()


@dataclass(frozen=True)
class ItemChoice:
    """An item with the flavours and sizes to count.

    ``flavours`` may hold ``None`` for "no flavour". Left empty it means the first
    flavour the store lists for the item, with "no flavour" listed before all names.
    ``sizes`` left empty means Regular.
    """

    item: str
    flavours: Sequence[str | None] = ()
    sizes: Sequence[str] = (SIZES[0],)


def _first_flavours(kinds: DataFrame) -> DataFrame:
    """The flavour each store lists first for each item, both in one row."""
    flavour = F.col("item_flavour")
    plain = F.count("*") > F.count(flavour)
    first = F.when(plain, F.lit(None)).otherwise(F.min(flavour))
    return kinds.groupBy(
        F.col("store").alias("listing_store"), F.col("item_name").alias("listed_item")
    ).agg(first.alias("first_flavour"))


def _picked_cups(
    rows: DataFrame, picks: Sequence[Column], label: Column, keys: Sequence[str]
) -> DataFrame:
    """Cups of the rows that meet a pick, counted once for each pick they meet.

    This appends the rows of both picks without reading the table twice.
    """
    times = sum((F.when(pick, 1).otherwise(0) for pick in picks), F.lit(0))
    return (
        rows.withColumn("times", times)
        .where(F.col("times") > 0)
        .groupBy(*keys, "the_hour", label)
        .agg(F.sum(F.col("cups") * F.col("times")).alias("cups_sold"))
    )


def _keys(store: str | None, day: Day | None) -> list[str]:
    return [
        name for name, value in (("store", store), ("day", day)) if value is None
    ]


def compare_two_items(
    model: RetailModel,
    item_1: str,
    item_2: str,
    store: str | None = None,
    day: Day | None = None,
) -> DataFrame:
    """Cups per hour of two items. An item chosen twice counts twice."""
    name = F.col("item_name")
    rows = _cells(model, store, day).where(name.isin(item_1, item_2))
    picks = [name == item_1, name == item_2]
    return _picked_cups(rows, picks, name, _keys(store, day))


def compare_two_items_advanced(
    model: RetailModel,
    choice_1: ItemChoice,
    choice_2: ItemChoice,
    store: str | None = None,
    day: Day | None = None,
) -> DataFrame:
    """Cups per hour of two items by flavour and size."""
    name, flavour, size = (
        F.col(f"item_{part}") for part in ("name", "flavour", "size")
    )
    choices = (choice_1, choice_2)
    chosen = name.isin(*{choice.item for choice in choices})
    rows = _cells(model, store, day).where(chosen)
    if not all(choice.flavours for choice in choices):
        firsts = _first_flavours(of_store(model.item_kinds, store).where(chosen))
        same = F.col("store").eqNullSafe(F.col("listing_store")) & (name == F.col("listed_item"))
        rows = rows.join(firsts, same, "left")
    picks = [
        (name == choice.item)
        & has_flavour(flavour, choice.flavours, F.col("first_flavour"))
        & has_size(size, choice.sizes)
        for choice in choices
    ]
    label = text.item_label(name, size, flavour).alias("item")
    return _picked_cups(rows, picks, label, _keys(store, day))
