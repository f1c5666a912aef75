"""Figures that must agree between reports."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from compare import TEST_DATA, spark_rows, sql_rows, tables
from test_plans import settings
from tillbook.operators.summaries import sold_items
from tillbook.plans import hourly, popularity, week
from tillbook.sources import testtables

FOLDER = f"{TEST_DATA}/sf0.01"
DAY = "2024-01-15"


@pytest.fixture(scope="module")
def model(spark):
    return testtables.load(spark, FOLDER)


def total(frame, column):
    return frame.agg(F.sum(column)).first()[0]


def test_cups_agree_between_levels(model):
    joined = sold_items(model.transactions, model.items)
    one = joined.where((F.col("store") == "ASIA") & (F.to_date("ts") == F.lit(DAY).cast("date")))
    for store, day, rows in ((None, None, joined), ("ASIA", DAY, one)):
        expected = rows.count()
        assert total(hourly.cups_by_timestamp_item(model, store, day), "cups_sold") == expected
        assert total(hourly.cups_by_hour_item(model, store, day), "cups_sold") == expected


def test_bands_add_up_to_hours(model):
    bands = total(popularity.sales_by_time_of_day(model), "cups_sold")
    assert bands == total(hourly.cups_by_hour_item(model), "cups_sold")
    assert bands == total(popularity.item_popularity(model), "total")
    assert bands == total(popularity.item_popularity_long(model), "cups_sold")


def test_coffees_of_the_daily_table(model):
    assert total(model.daily_store, "coffees") == total(model.item_hours, "cups")


def test_every_week_has_seven_days(model):
    sizes = week.week_grid(model).groupBy("store", "iso_year", "iso_week").count()
    assert {row["count"] for row in sizes.collect()} == {7}


def test_one_store_and_day_equal_their_part_of_the_whole(model):
    whole = hourly.hourly_insights(model).where((F.col("store") == "ASIA") & (F.col("day") == DAY))
    assert hourly.hourly_insights(model, "ASIA", DAY).collect() == whole.collect()
    whole = week.weekday_vs_week_average(model).where("store = 'ASIA' AND iso_week = 3")
    single = week.weekday_vs_week_average(model, "ASIA", 3)
    assert spark_rows(single) == spark_rows(whole)


@pytest.mark.parametrize("name", ["item_hours", "daily_store", "transactions_per_store"])
def test_session_time_zone_does_not_matter(spark, name):
    with settings(spark, spark__sql__session__timeZone="Asia/Tokyo"):
        model = testtables.load(spark, FOLDER, keep_summaries=False)
        actual = spark_rows(registry.REPORTS[name](model))
    assert actual == sql_rows(tables(FOLDER), registry.oracle_sql()[name])[1]
