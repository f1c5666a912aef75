"""Figures of single stores, all time and in a range of days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from tillbook.functions import text
from tillbook.functions.dates import as_date, date_lit, inclusive_days, iso_week, iso_year
from tillbook.functions.measures import (
    availability_rating,
    direction,
    exact_mean,
    or_zero,
    per_day,
    percent_of,
    whole_number,
)
from tillbook.model import RetailModel
from tillbook.operators.kpis import KPI_COLUMNS, MEAN_COLUMNS, MEASURES, kpi_block, means, only, per_store
from tillbook.operators.selection import check_range, in_range, of_store, within

Day = dt.date | str


def store_revenue_alltime(model: RetailModel, store: str | None = None) -> DataFrame:
    return per_store(
        model.daily_store, store, F.sum("revenue").cast("double").alias("total_revenue")
    )


def store_daily_revenue(model: RetailModel, store: str | None = None) -> DataFrame:
    """Revenue of every day, in order of the days."""
    return (
        of_store(model.daily_store, store)
        .select("store", "day", F.col("revenue").cast("double").alias("revenue"))
        .orderBy("store", "day")
    )


def total_days(model: RetailModel) -> DataFrame:
    """Days on which any store has a transaction."""
    months = model.store_months.groupBy("month").agg(F.bit_or("days").alias("days"))
    return months.agg(or_zero(F.sum(F.bit_count("days"))).alias("n_days"))


def store_days_in_range(
    model: RetailModel,
    store: str | None = None,
    start: Day | None = None,
    end: Day | None = None,
) -> DataFrame:
    """Days with a transaction per store; a store without any in the range has 0.

    Days are bits of a number per month, so those of the range are counted without a distinct.
    """
    return _days_with_data(model, store, start, end, "n_days")


def _days_with_data(
    model: RetailModel, store: str | None, start: Day | None, end: Day | None, name: str
) -> DataFrame:
    rows = of_store(model.store_months, store)
    if store is not None:
        # a store asked for has a row anyway, so months outside may be left out
        rows = rows if start is None else rows.where(F.col("month") >= F.lit(as_date(start).replace(day=1)))
        rows = rows if end is None else rows.where(F.col("month") <= F.lit(as_date(end).replace(day=1)))
    return per_store(rows, store, or_zero(F.sum(_days_within(start, end))).alias(name))


def _days_within(start: Day | None, end: Day | None) -> Column:
    """How many of the days of a month, given as bits, lie in a range of which either end may be open."""
    if start is not None and end is not None:
        check_range(start, end)
    month, days = F.col("month"), F.col("days")
    if start is not None:
        first = as_date(start)
        low = F.when(month == F.lit(first.replace(day=1)), -1 << (first.day - 1)).when(month > F.lit(first), -1)
        days = days.bitwiseAND(low.otherwise(0))
    if end is not None:
        last = as_date(end)
        high = F.when(month == F.lit(last.replace(day=1)), (1 << last.day) - 1).when(month < F.lit(last), -1)
        days = days.bitwiseAND(high.otherwise(0))
    return F.bit_count(days)


def _ranged(start: Day | None, end: Day | None) -> Column:
    """Whether ``day`` lies in a range of which either end may be open."""
    if start is not None and end is not None:
        check_range(start, end)
    day = F.col("day")
    after = F.lit(True) if start is None else day >= date_lit(start)
    return after if end is None else after & (day <= date_lit(end))


def store_weeks(model: RetailModel, store: str | None = None) -> DataFrame:
    """Weeks with data, in order."""
    day = F.col("day")
    return (
        of_store(model.daily_store, store)
        .select("store", iso_year(day).alias("iso_year"), iso_week(day).alias("iso_week"))
        .distinct()
        .orderBy("store", "iso_year", "iso_week")
    )


def store_summary(model: RetailModel, store: str | None = None) -> DataFrame:
    """All-time revenue, daily average, days of data and their completeness."""
    all_days = total_days(model).scalar()
    totals = per_store(
        model.daily_store,
        store,
        F.sum("revenue").cast("double").alias("total_revenue"),
        F.count("day").alias("n_days"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
    )
    return totals.select(
        "store",
        "total_revenue",
        per_day(F.col("total_revenue"), F.col("n_days")).alias("avg_daily_revenue"),
        "n_days",
        "first_day",
        "last_day",
        F.round(percent_of(F.col("n_days"), all_days), 1).alias("completeness_pct"),
    )


def store_cards(model: RetailModel, store: str | None = None) -> DataFrame:
    """The summary as texts: one row per figure."""
    shown = {
        "total_revenue": text.money(F.col("total_revenue")),
        "avg_daily_revenue": text.money(F.col("avg_daily_revenue")),
        "n_days": F.col("n_days").cast("string"),
        "completeness_pct": text.percent(F.col("completeness_pct"), 1),
    }
    cards = F.array(
        *[
            F.struct(F.lit(name).alias("figure"), value.alias("value"))
            for name, value in shown.items()
        ]
    )
    return store_summary(model, store).select("store", F.inline(cards))


def range_revenue(
    model: RetailModel,
    store: str | None = None,
    start: Day | None = None,
    end: Day | None = None,
) -> DataFrame:
    """Revenue and mean daily average spend in a range of days, 0 for a store without any."""
    if store is not None:
        return range_totals(model, store, start, end).select(
            "store",
            F.col("range.revenue").cast("double").alias("range_revenue"),
            or_zero(_mean("range", "avg_spend")).alias("range_avg_spend"),
        )
    inside = _ranged(start, end)
    revenue = F.sum(only(inside, F.col("revenue"))).cast("double")
    return per_store(
        model.daily_store,
        store,
        or_zero(revenue).alias("range_revenue"),
        or_zero(exact_mean(only(inside, F.col("avg_spend")))).alias("range_avg_spend"),
    )


#: What running totals hold: the sum of each measure, and on how many days it is known.
BALANCE = {
    "revenue": "decimal(38,2)",
    "avg_spend": "decimal(38,6)",
    **dict.fromkeys(("customers", "coffees", *(f"n_{name}" for name in MEASURES)), "bigint"),
}


def range_totals(
    model: RetailModel, store: str | None = None, start: Day | None = None, end: Day | None = None
) -> DataFrame:
    """(store, range, alltime): totals of a range of days and of all days, as structs of BALANCE.

    The range is the difference of two running totals: that of the last month before the one in which it
    ends, plus the days of that month up to the end, less the same for its start. However long the range,
    daily rows of two months are read. A store without data in the range has zeros; a store asked for
    always gives a row.
    """
    if start is not None and end is not None:
        check_range(start, end)
    balances = of_store(model.store_balances, store)

    def before(day: dt.date | None) -> Column:
        """The running total before the month of a day; without a day the last one."""
        known = F.col("month") if day is None else F.when(F.col("month") < F.lit(day.replace(day=1)), F.col("month"))
        return F.max_by(F.struct(*BALANCE), known)

    first, last = (None if day is None else as_date(day) for day in (start, end))
    none_yet = F.lit(None).cast(f"struct<{','.join(f'{name}:{kind}' for name, kind in BALANCE.items())}>")
    ends = per_store(
        balances,
        store,
        before(last).alias("upto"),
        (before(first) if first is not None else none_yet).alias("base"),
        before(None).alias("total"),
    )
    parts = ends.select(
        "store",
        *(_or_none("upto", name).alias(name) - _or_none("base", name) for name in BALANCE),
        *(_or_none("total", name) for name in BALANCE),
    ).toDF("store", *BALANCE, *(f"all_{name}" for name in BALANCE))
    days = of_store(model.daily_store, store)
    for day, sign, to in ((last, 1, last), (first, -1, None if first is None else first - dt.timedelta(days=1))):
        if day is not None and to >= day.replace(day=1):
            edge = within(days, day.replace(day=1), to).select(
                "store",
                *((F.col(name) * sign).alias(name) for name in MEASURES),
                *(F.when(F.col(name).isNotNull(), sign).alias(f"n_{name}") for name in MEASURES),
                *(F.lit(0).alias(f"all_{name}") for name in BALANCE),
            )
            parts = parts.unionByName(edge)
    sums = [F.struct(*(or_zero(F.sum(f"{prefix}{name}")).alias(name) for name in BALANCE)) for prefix in ("", "all_")]
    return per_store(parts, store, sums[0].alias("range"), sums[1].alias("alltime"))


def _or_none(balance: str, name: str) -> Column:
    return or_zero(F.col(f"{balance}.{name}"))


def _mean(totals: str, measure: str) -> Column:
    return F.try_divide(F.col(f"{totals}.{measure}").cast("double"), F.col(f"{totals}.n_{measure}"))


def _block(totals: str) -> list[Column]:
    """The four figures of :func:`kpi_block` from totals."""
    values = (
        F.col(f"{totals}.revenue").cast("double"),
        or_zero(_mean(totals, "avg_spend")),
        F.col(f"{totals}.customers"),
        F.col(f"{totals}.coffees"),
    )
    return [value.alias(name) for value, name in zip(values, KPI_COLUMNS)]


def store_alltime_averages(model: RetailModel, store: str | None = None) -> DataFrame:
    return per_store(model.daily_store, store, *means()[1:])


def range_availability(
    model: RetailModel, start: Day, end: Day, store: str | None = None
) -> DataFrame:
    """Days with data in a range, as a share of its calendar days, with a rating.

    Stores without data in the range stay, with 0 days.
    """
    first, last = check_range(start, end)
    days = inclusive_days(date_lit(first), date_lit(last))
    share = percent_of(F.col("days_available"), F.col("days_inclusive"))
    return (
        _days_with_data(model, store, first, last, "days_available")
        .select("store", days.alias("days_inclusive"), "days_available")
        .withColumn("availability_pct", share)
        .withColumn("rating", availability_rating(F.col("availability_pct")))
    )


def range_kpis(
    model: RetailModel, start: Day, end: Day, store: str | None = None
) -> DataFrame:
    """The four figures in a range beside the all-time totals, in one pass."""
    first, last = check_range(start, end)
    if store is not None:
        totals = range_totals(model, store, first, last)
        return totals.select(
            "store",
            *_block("range"),
            F.col("alltime.revenue").cast("double").alias("alltime_revenue"),
            F.col("alltime.customers").alias("alltime_customers"),
            F.col("alltime.coffees").alias("alltime_coffees"),
        )
    revenue, _, customers, coffees = kpi_block()
    return per_store(
        model.daily_store,
        store,
        *kpi_block(in_range(F.col("day"), first, last)),
        revenue.alias("alltime_revenue"),
        customers.alias("alltime_customers"),
        coffees.alias("alltime_coffees"),
    )


def range_vs_alltime(
    model: RetailModel, start: Day, end: Day, store: str | None = None
) -> DataFrame:
    """Daily averages in a range against all time, one row per measure.

    The range divides by its calendar days, all time by the days with data. Daily
    customers and cups are cut to whole numbers before they are compared.
    """
    first, last = check_range(start, end)
    days = inclusive_days(date_lit(first), date_lit(last))
    if store is None:
        totals = per_store(
            model.daily_store,
            store,
            F.struct(*kpi_block(in_range(F.col("day"), first, last))).alias("range"),
            F.struct(*means()).alias("alltime"),
        )
    else:
        averages = [_mean("alltime", measure).alias(name) for measure, name in zip(MEASURES, MEAN_COLUMNS)]
        totals = range_totals(model, store, first, last).select(
            "store", F.struct(*_block("range")).alias("range"), F.struct(*averages).alias("alltime")
        )

    def row(measure: str, in_the_range: Column, all_time: Column) -> Column:
        return F.struct(
            F.lit(measure).alias("measure"),
            in_the_range.cast("double").alias("range_value"),
            all_time.cast("double").alias("alltime_value"),
        )

    rows = F.array(
        row(
            "revenue",
            per_day(F.col("range.total_revenue"), days),
            F.col("alltime.avg_revenue"),
        ),
        row("avg_spend", F.col("range.avg_spend"), F.col("alltime.avg_spend")),
        row(
            "customers",
            whole_number(per_day(F.col("range.total_customers"), days)),
            whole_number(F.col("alltime.avg_customers")),
        ),
        row(
            "coffees",
            whole_number(per_day(F.col("range.total_coffees"), days)),
            whole_number(F.col("alltime.avg_coffees")),
        ),
    )
    value, base = F.col("range_value"), F.col("alltime_value")
    return totals.select("store", F.inline(rows)).select(
        "store",
        "measure",
        "range_value",
        "alltime_value",
        (value - base).alias("difference"),
        direction(value, base).alias("direction"),
    )


def range_cards(
    model: RetailModel, start: Day, end: Day, store: str | None = None
) -> DataFrame:
    """Availability and daily averages of a range as texts: one row per figure.

    ``delta`` is the rating of the availability or the all-time average, and ``direction``
    how the value stands to it.
    """

    def card(figure: str, value: Column, delta: Column, way: str) -> Column:
        texts = (F.lit(figure), value.cast("string"), delta, F.lit(None).cast("string"), F.lit(way))
        names = ("figure", "value", "delta", "difference", "direction")
        return F.struct(*(column.alias(name) for column, name in zip(texts, names)))

    rating = F.col("rating")
    days = F.array(
        card("days_inclusive", F.col("days_inclusive"), F.lit("Inclusive"), "off"),
        card("days_available", F.col("days_available"), rating, "normal"),
        card("availability", text.percent(F.col("availability_pct")), rating, "normal"),
    )
    amount = F.col("measure").isin("revenue", "avg_spend")

    def shown(name: str, money: bool = True) -> Column:
        value = F.col(name)
        decimals = text.money(value) if money else text.fixed_point(value)
        return F.when(amount, decimals).otherwise(value.cast("bigint").cast("string")).alias(name)

    averages = range_vs_alltime(model, start, end, store).select(
        "store",
        F.concat(F.lit("daily_"), "measure").alias("figure"),
        shown("range_value").alias("value"),
        shown("alltime_value", money=False).alias("delta"),
        shown("difference"),
        "direction",
    )
    return range_availability(model, start, end, store).select("store", F.inline(days)).unionByName(averages)


def store_vs_store(
    model: RetailModel, first: str | None = None, second: str | None = None
) -> DataFrame:
    """The four all-time figures of two stores, one row each, or of all stores."""
    if first is None or second is None:
        return per_store(model.daily_store, first or second, *kpi_block())
    rows = [per_store(model.daily_store, store, *kpi_block()) for store in (first, second)]
    return rows[0].unionByName(rows[1])
