"""How much each item sells in the bands of the day, all stores and days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tillbook.functions.text import BAND_NAMES, band_name
from tillbook.model import RetailModel

# The named items the popularity chart leaves out; pass them as
# ``exclude`` to draw it.
LEFT_OUT = ("Flavoured Iced Latte", "Speciality Tea")


def _cups_per_band(rows: DataFrame) -> DataFrame:
    return rows.groupBy("item_name", "time_of_day").agg(F.sum("cups").alias("cups_sold"))


def sales_by_time_of_day(model: RetailModel, band: int | None = None) -> DataFrame:
    """Cups per item and band in order of the names, one grouping for all bands."""
    rows = model.item_kinds
    if band is not None:
        rows = rows.where(F.col("time_of_day") == band)
    return _cups_per_band(rows).orderBy(F.asc_nulls_last("item_name"), "time_of_day")


def _named(rows: DataFrame, exclude: Sequence[str]) -> DataFrame:
    rows = rows.where(F.col("item_name").isNotNull())
    return rows.where(~F.col("item_name").isin(list(exclude))) if exclude else rows


def _without_top(rows: DataFrame, cups: str, top: int) -> DataFrame:
    """Drop the ``top`` items with most cups; on equal cups the first by name."""
    if not top:
        return rows
    best = (
        rows.groupBy("item_name")
        .agg(F.sum(cups).alias("all_cups"))
        .orderBy(F.desc("all_cups"), "item_name")
        .limit(top)
        .select("item_name")
    )
    return rows.join(best, "item_name", "left_anti")


def item_popularity_long(
    model: RetailModel, exclude: Sequence[str] = (), without_top: int = 0
) -> DataFrame:
    """Cups per item and band with the band's name."""
    rows = _cups_per_band(_named(model.item_kinds, exclude))
    return _without_top(rows, "cups_sold", without_top).select(
        "item_name", "time_of_day", band_name(F.col("time_of_day")).alias("band"), "cups_sold"
    )


def item_popularity(
    model: RetailModel, exclude: Sequence[str] = (), without_top: int = 0
) -> DataFrame:
    """One row per item with its cups in each band and in total."""
    cups = F.col("cups")
    rows = (
        _named(model.item_kinds, exclude)
        .groupBy("item_name")
        .agg(
            *[
                F.sum(F.when(F.col("time_of_day") == number, cups).otherwise(0)).alias(name)
                for number, name in BAND_NAMES.items()
            ],
            F.sum(cups).alias("total"),
        )
    )
    return _without_top(rows, "total", without_top)


def best_worst_by_time_of_day(model: RetailModel) -> DataFrame:
    """Best and worst item of each band, and over the items of all bands.

    Compared by cups and then by name. ``all`` compares the figures of single
    bands, it does not add bands up.
    """
    ranked = F.struct("cups_sold", "item_name")
    found = (
        _cups_per_band(_named(model.item_kinds, ()))
        .rollup("time_of_day")
        .agg(
            F.grouping("time_of_day").alias("all_bands"),
            F.max(ranked).alias("best"),
            F.min(ranked).alias("worst"),
        )
    )
    band = F.when(F.col("all_bands") == 1, "all").otherwise(
        band_name(F.col("time_of_day"))
    )
    return found.select(
        band.alias("band"),
        F.col("best.item_name").alias("best_item"),
        F.col("best.cups_sold").alias("best_cups"),
        F.col("worst.item_name").alias("worst_item"),
        F.col("worst.cups_sold").alias("worst_cups"),
    )
