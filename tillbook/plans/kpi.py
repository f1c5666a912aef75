"""Date bounds and the daily snapshot of the four headline figures."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tillbook.functions import text
from tillbook.functions.dates import as_date, date_lit, day_before
from tillbook.functions.measures import BOTH_MISSING, missing_status, or_zero
from tillbook.model import RetailModel
from tillbook.operators.kpis import KPI_COLUMNS, MEASURES, kpi_block, only
from tillbook.operators.selection import ALL, in_stores, on_day, resolve_stores, within

Day = dt.date | str


def first_data_date(model: RetailModel) -> DataFrame:
    return model.daily_store.agg(F.min("day").alias("first_day"))


def date_bounds(model: RetailModel, as_of: Day | None = None) -> DataFrame:
    """Today, yesterday and the first day with data."""
    today = F.current_date() if as_of is None else date_lit(as_of)
    return first_data_date(model).select(
        today.alias("as_of"), day_before(today).alias("yesterday"), "first_day"
    )


def _selected(model: RetailModel, stores: Sequence[str] | None) -> DataFrame:
    chosen = resolve_stores(stores, model.store_groups)
    return model.daily_store.where(in_stores(F.col("store"), chosen))


def kpi_snapshot(
    model: RetailModel, day: Day | None = None, stores: Sequence[str] | None = None
) -> DataFrame:
    """The four figures of a day, or of every day, over the selected stores."""
    rows = on_day(_selected(model, stores), day)
    return (rows.groupBy("day") if day is None else rows).agg(*kpi_block())


def kpi_snapshot_literal(
    model: RetailModel, day: Day | None = None, stores: Sequence[str] | None = None
) -> DataFrame:
    """The snapshot under ``day = d AND store = a OR store = b``, read literally.

    AND binds first: the day restricts the first listed store only, and the other
    stores are added up over all days.
    """
    chosen = resolve_stores(stores, model.store_groups)
    first, *rest = model.store_groups[ALL] if chosen is None else chosen
    store = F.col("store")
    other = store.isin(rest) if rest else F.lit(False)
    rows = model.daily_store.where((store == first) | other)
    if day is not None:
        return rows.where((F.col("day") == date_lit(day)) | other).agg(*kpi_block())

    others = rows.where(other).agg(F.struct(*_parts()).alias("others"))
    return (
        rows.groupBy("day")
        .agg(F.struct(*_parts(store == first)).alias("first"))
        .withColumn("others", others.scalar())
        .select("day", *_totals(F.col("first"), F.col("others")))
    )


def _parts(condition: Column | None = None) -> list[Column]:
    """Sums and the day count from which totals and means can be put together."""
    return [
        F.sum(only(condition, F.col(name))).alias(name) for name in MEASURES
    ] + [F.count(only(condition, F.col("avg_spend"))).alias("n_days")]


def _totals(left: Column, right: Column) -> list[Column]:
    revenue, spend, customers, coffees, days = (
        or_zero(left[name]) + or_zero(right[name]) for name in (*MEASURES, "n_days")
    )
    values = (
        revenue.cast("double"),
        or_zero(F.try_divide(spend.cast("double"), days)),
        customers,
        coffees,
    )
    return [value.alias(name) for value, name in zip(values, KPI_COLUMNS)]


def kpi_day_over_day(
    model: RetailModel, day: Day | None = None, stores: Sequence[str] | None = None
) -> DataFrame:
    """The figures of a day, those of the day before, their difference and what is
    missing.

    Each store-day counts once for its own day and once for the following one, so
    both sets come out of one aggregation and a gap stays visible. Without ``day``
    there is a row for every day that has data on itself or on the day before.
    """
    rows = _selected(model, stores)
    if day is not None:
        rows = within(rows, as_date(day) - dt.timedelta(days=1), day)
    roles = F.array(
        F.struct(F.col("day").alias("on_day"), F.lit(True).alias("selected")),
        F.struct(F.date_add("day", 1).alias("on_day"), F.lit(False).alias("selected")),
    )
    rows = rows.select(*MEASURES, F.inline(roles))
    grouped = (
        rows.groupBy(F.col("on_day").alias("day"))
        if day is None
        else rows.where(F.col("on_day") == date_lit(day))
    )
    selected = F.col("selected")
    figures = grouped.agg(
        F.count_if(selected).alias("rows"),
        F.count_if(~selected).alias("previous_rows"),
        F.struct(*kpi_block(selected)).alias("now"),
        F.struct(*kpi_block(~selected)).alias("prev"),
    )
    return figures.select(
        *(["day"] if day is None else []),
        *[F.col(f"now.{name}") for name in KPI_COLUMNS],
        *[F.col(f"prev.{name}").alias(f"prev_{name}") for name in KPI_COLUMNS],
        *[
            (F.col(f"now.{name}") - F.col(f"prev.{name}")).alias(f"delta_{name}")
            for name in KPI_COLUMNS
        ],
        missing_status(F.col("rows"), F.col("previous_rows")).alias("status"),
    )


def kpi_cards(
    model: RetailModel, day: Day, stores: Sequence[str] | None = None
) -> DataFrame:
    """The day-over-day figures as texts: one row per figure, with what is missing.

    Where one day has no data its figures count as 0, as the status tells; where
    neither day has any there are no figures.
    """
    chosen = resolve_stores(stores, model.store_groups)
    if chosen is not None and set(chosen) == set(model.store_groups.get(ALL, ())):
        chosen = None
    amounts = ("total_revenue", "avg_spend")

    def shown(name: str, column: str) -> Column:
        value = F.col(column)
        return text.money(value) if name in amounts else value.cast("string")

    status = F.col("status")
    there = status != BOTH_MISSING
    cards = F.array(
        *[
            F.struct(
                F.lit(name).alias("figure"),
                F.when(there, shown(name, name)).alias("value"),
                F.when(there, shown(name, f"delta_{name}")).alias("delta"),
            )
            for name in KPI_COLUMNS
        ]
    )
    return kpi_day_over_day(model, day, stores).select(
        date_lit(as_date(day)).alias("day"),
        text.stores_text(chosen).alias("stores"),
        "status",
        F.inline(cards),
    )
