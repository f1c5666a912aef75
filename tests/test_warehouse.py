"""The coffee-shop tables in their own layout."""

import os
import shutil
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from compare import TEST_DATA
from shop import DAILY, ITEMS, TRANSACTIONS, daily_frame, items_frame, shop, transactions_frame
from test_plans import plan
from tillbook import RetailModel
from tillbook.operators import summaries
from tillbook.operators.selection import on_day
from tillbook.plans import hourly, kpi, menu, store
from tillbook.sources import kept, warehouse


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    target = str(tmp_path_factory.mktemp("warehouse"))
    daily_frame(spark, DAILY).select(
        F.col("revenue").alias("total_revenue_for_day"),
        F.col("avg_spend").alias("avg_spend_per_customer_for_day"),
        F.col("customers").alias("total_customers_for_day"),
        F.col("coffees").alias("total_coffees_sold_for_day"),
        F.col("day").alias("current_day"),
        F.col("store").alias("store_name"),
    ).write.parquet(f"{target}/insights")
    transactions_frame(spark, TRANSACTIONS).select(
        "transaction_id", F.col("ts").cast("string").alias("timestamp"), "store", "time_of_day"
    ).write.csv(f"{target}/customers", header=True)
    items_frame(spark, ITEMS).drop("price").write.json(f"{target}/items")
    return target


@pytest.fixture(scope="module", params=[False, True])
def model(request, spark, folder):
    paths = [f"{folder}/customers", f"{folder}/items", f"{folder}/insights"]
    return warehouse.load(
        spark,
        spark.read.parquet(f"{folder}/insights"),
        spark.read.csv(paths[0], header=True),
        spark.read.schema(
            "transaction_id bigint, item_name string, item_flavour string, item_size string"
        ).json(paths[1]),
        inputs=paths if request.param else (),
    )


@pytest.mark.parametrize(
    "report",
    [
        lambda m: kpi.kpi_snapshot(m),
        lambda m: kpi.kpi_day_over_day(m, "2022-07-05", ["Only London"]),
        lambda m: store.store_summary(m),
        lambda m: hourly.cups_by_timestamp_item(m),
        lambda m: hourly.hourly_insights(m),
        lambda m: menu.store_menu_availability(m, [("Uppingham", "Mocha")]),
    ],
)
def test_reports_equal_those_of_the_shop(spark, model, report):
    found, expected = report(model), report(shop(spark))
    assert found.columns == expected.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))


OTHER_MONTHS = [(i, f"2022-{month}-15 10:00", "Uppingham", 1) for i, month in ((50, "06"), (51, "08"))]


COLUMNS = {
    "sold": ["store", "ts", "time_of_day", "transaction_id", "item_name", "item_flavour", "item_size", "price", "day"],
    "daily_store": ["store", "day", "revenue", "avg_spend", "customers", "coffees"],
    "store_days": ["store", "day", "n_transactions"],
    "item_hours": [*summaries.ITEM_HOUR_KEYS, "cups"],
    "item_kinds": ["store", "time_of_day", "item_name", "item_flavour", "item_size", "cups"],
}


def summaries_of(model):
    return {
        name: sorted(map(str, getattr(model, name).select(*columns).collect()))
        for name, columns in COLUMNS.items()
    }


SOLD = ITEMS + [(50, "Mocha", None, "Large"), (51, "Mocha", None, "Large")]


def reader(spark, model, folder):
    return RetailModel(model.transactions, model.items, given=kept.saved(spark, folder))


def test_refresh_replaces_its_months_only(spark, tmp_path):
    folder = str(tmp_path / "summaries")
    before = shop(spark, TRANSACTIONS[:4] + OTHER_MONTHS[:1], SOLD, daily=None)
    after = shop(spark, TRANSACTIONS + OTHER_MONTHS, SOLD, daily=None)
    kept.save(before, folder)
    assert summaries_of(reader(spark, after, folder)) == summaries_of(before)
    june = {file for file in reader(spark, after, folder).item_hours.inputFiles() if "month=2022-06" in file}
    kept.refresh(after, folder, "2022-07-06", "2022-08-01")
    assert summaries_of(reader(spark, after, folder)) == summaries_of(after)
    assert june <= set(reader(spark, after, folder).item_hours.inputFiles())


def test_refresh_removes_emptied_months(spark, tmp_path):
    folder = str(tmp_path / "summaries")
    kept.save(shop(spark, TRANSACTIONS + OTHER_MONTHS, SOLD, daily=None), folder)
    less = shop(spark, TRANSACTIONS + OTHER_MONTHS[1:], SOLD, daily=None)
    kept.refresh(less, folder, "2022-06-01", "2022-06-30")
    assert summaries_of(reader(spark, less, folder)) == summaries_of(less)


def test_refresh_leaves_supplied_tables_as_they_are(spark, tmp_path, model):
    folder = str(tmp_path / "summaries")
    expected = summaries_of(model)["daily_store"]
    kept.save(model, folder)
    kept.refresh(model, folder, "2022-07-01", "2022-07-31")
    assert summaries_of(reader(spark, model, folder))["daily_store"] == expected
    assert summaries_of(reader(spark, model, folder)) == summaries_of(model)


def test_readers_see_whole_versions_and_old_ones_can_go(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "summaries")
    first = shop(spark, TRANSACTIONS[:4], SOLD, daily=None)
    second = shop(spark, TRANSACTIONS, SOLD, daily=None)
    kept.save(first, folder)
    with monkeypatch.context() as patch:
        patch.setattr(kept, "_publish", lambda *args: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            kept.save(second, folder)
    assert summaries_of(reader(spark, first, folder)) == summaries_of(first)
    kept.save(second, folder)
    kept.vacuum(spark, folder)
    assert summaries_of(reader(spark, first, folder)) == summaries_of(second)
    assert len([p for p in (tmp_path / "summaries").iterdir() if p.name.startswith("parts-")]) == 1


def test_nothing_sold_can_be_saved(spark, tmp_path):
    empty = shop(spark, TRANSACTIONS[:2], [], daily=None)
    kept.save(empty, str(tmp_path / "s"))
    assert summaries_of(reader(spark, empty, str(tmp_path / "s"))) == summaries_of(empty)


def opened(spark, folder, condition="true", **options):
    return warehouse.load(
        spark,
        spark.read.parquet(f"{folder}/insights"),
        spark.read.csv(f"{folder}/customers", header=True, recursiveFileLookup=True).where(condition),
        spark.read.schema(
            "transaction_id bigint, item_name string, item_flavour string, item_size string"
        ).json(f"{folder}/items"),
        inputs=[f"{folder}/{name}" for name in ("insights", "customers", "items")],
        **options,
    )


def test_two_models_over_the_same_files_have_their_own_summaries(spark, folder):
    whole = hourly.store_items(opened(spark, folder)).count()
    part = opened(spark, folder, "store = 'Uppingham'")
    assert {row["store"] for row in hourly.store_items(part).collect()} == {"Uppingham"}
    again = opened(spark, folder)
    assert hourly.store_items(again).count() == whole
    assert again.item_hours.inputFiles() == opened(spark, folder).item_hours.inputFiles()


def test_files_deeper_down_give_a_new_summary(spark, folder, tmp_path):
    for name in ("insights", "customers", "items"):
        shutil.copytree(f"{folder}/{name}", tmp_path / name)
    before = opened(spark, str(tmp_path)).store_days.agg(F.sum("n_transactions")).first()[0]
    extra = spark.createDataFrame([("99", "2022-07-06 10:00:00", "Uppingham", "1")], "transaction_id string, timestamp string, store string, time_of_day string")
    extra.write.csv(str(tmp_path / "customers" / "deeper" / "still"), header=True)
    assert opened(spark, str(tmp_path)).store_days.agg(F.sum("n_transactions")).first()[0] == before + 1


def test_tables_outside_the_inputs_are_not_kept(spark, folder):
    made = warehouse.load(
        spark, spark.read.parquet(f"{folder}/insights"), spark.read.csv(f"{folder}/customers", header=True),
        spark.read.schema("transaction_id bigint, item_name string, item_flavour string, item_size string").json(f"{folder}/items"),
        inputs=[f"{folder}/customers"],
    )
    assert any("/items/" in file for file in made.item_hours.inputFiles())


def test_ids_keep_their_type(spark, tmp_path):
    visits = spark.createDataFrame([("a1-b2", "2022-07-04 09:15:00", "Uppingham", 1)], "transaction_id string, timestamp string, store string, time_of_day int")
    sold = spark.createDataFrame([("a1-b2", "Latte", None, "Large")], "transaction_id string, item_name string, item_flavour string, item_size string")
    daily = daily_frame(spark, []).selectExpr(
        "revenue AS total_revenue_for_day", "avg_spend AS avg_spend_per_customer_for_day", "customers AS total_customers_for_day",
        "coffees AS total_coffees_sold_for_day", "day AS current_day", "store AS store_name",
    )
    made = warehouse.load(spark, daily, visits, sold)
    assert hourly.cups_by_hour_item(made).first()["cups_sold"] == 1
    kept.save(made, str(tmp_path / "s"))
    assert kept.saved(spark, str(tmp_path / "s"))["sold"].first()["transaction_id"] == "a1-b2"
    given = warehouse.load(spark, daily, visits, sold, given=kept.saved(spark, str(tmp_path / "s")))
    assert hourly.cups_by_hour_item(given).first()["cups_sold"] == 1


def test_days_are_pushed_to_times_as_text(spark, tmp_path):
    transactions_frame(spark, TRANSACTIONS).select(
        "transaction_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "store", "time_of_day"
    ).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    rows = on_day(warehouse.transactions(table, iso_text=True), "2022-07-05")
    assert rows.count() == on_day(warehouse.transactions(table), "2022-07-05").count() == 5
    assert "GreaterThanOrEqual(timestamp,2022-07-05), LessThan(timestamp,2022-07-06)" in plan(rows)


def test_zoned_times_become_those_of_the_zone(spark):
    table = spark.createDataFrame([(1, "Uppingham", 1)], "transaction_id bigint, store string, time_of_day int")
    table = table.withColumn("timestamp", F.expr("timestamp_ltz '2022-07-04 23:30:00Z'"))
    assert str(warehouse.transactions(table).first()["ts"]) == "2022-07-04 23:30:00"
    assert str(warehouse.transactions(table, zone="Europe/London").first()["ts"]) == "2022-07-05 00:30:00"


def test_summaries_go_when_the_application_ends(tmp_path):
    script = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.checkpoint.dir", {str(tmp_path)!r}).config("spark.ui.enabled", "false").getOrCreate()
from tillbook.sources import testtables
print("FILES", len(testtables.load(spark, "{TEST_DATA}/sf0.001").store_days.inputFiles()))
spark.stop()
"""
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300)
    assert "FILES" in done.stdout, done.stderr[-2000:]
    for _ in range(50):
        left = [p for p in tmp_path.rglob("*.parquet")]
        if not left:
            break
        time.sleep(0.2)
    assert not left
