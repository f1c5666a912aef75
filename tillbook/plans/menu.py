"""The menu of a store and which of its lines are unavailable."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tillbook.functions import text
from tillbook.model import RetailModel
from tillbook.operators.selection import of_store


def store_menu(model: RetailModel, store: str | None = None) -> DataFrame:
    """One line per item and flavour a store has sold; empty lines are dropped.

    The line is only put together for distinct kinds of item.
    """
    name, flavour = F.col("item_name"), F.col("item_flavour")
    return (
        of_store(model.item_kinds, store)
        .where(F.trim(F.concat_ws(" ", name, flavour)) != "")
        .select("store", name, flavour)
        .distinct()
        .select("store", text.menu_label(name, flavour).alias("menu_item"))
    )


def _pairs(unavailable: Iterable[tuple[str, str]]) -> pa.Table:
    """The pairs as an Arrow table, of which Spark knows the size when it joins."""
    names = ("store", "menu_item")
    rows = [dict(zip(names, pair)) for pair in unavailable]
    return pa.Table.from_pylist(rows, pa.schema([(name, pa.string()) for name in names]))


def store_menu_availability(
    model: RetailModel,
    unavailable: DataFrame | Iterable[tuple[str, str]] = (),
    store: str | None = None,
    crop_to: int | None = None,
) -> DataFrame:
    """Menu lines in label order with their column, availability and shown text.

    ``unavailable`` holds pairs of store and menu line. ``crop_to`` cuts the shown text for
    whoever draws it; the original's picture has room for ``text.CROPPED_LENGTH`` letters
    where a menu has more lines than a column.

    The lines of a store are numbered by one sort. They are the distinct kinds of item
    it sells, put together from a table that doesn't grow with sales or days.
    """
    menu = store_menu(model, store)
    lines = Window.partitionBy("store")
    menu = menu.select(
        "store",
        "menu_item",
        F.row_number().over(lines.orderBy("menu_item")).alias("position"),
        F.count("*").over(lines).cast("int").alias("n_lines"),
    )
    if not isinstance(unavailable, DataFrame):
        unavailable = menu.sparkSession.createDataFrame(_pairs(unavailable))
    flags = unavailable.select("store", "menu_item", F.lit(True).alias("unavailable")).distinct()
    position = F.col("position")
    missing = F.coalesce("unavailable", F.lit(False))
    shown = text.cropped(F.col("menu_item"), crop_to)
    return menu.join(flags, ["store", "menu_item"], "left").select(
        "store",
        "position",
        "n_lines",
        F.when(position > text.LINES_PER_COLUMN, 2).otherwise(1).alias("column_no"),
        "menu_item",
        (~missing).alias("available"),
        text.flagged(shown, missing).alias("display_text"),
    )
