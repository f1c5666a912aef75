"""The physical plans the reports should get."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as registry
from compare import TEST_DATA
from shop import shop
from tillbook import RetailModel
from tillbook.operators import summaries
from tillbook.operators.selection import of_store, on_day
from tillbook.plans import hourly, kpi, popularity, week
from tillbook.sources import kept, testtables

FOLDER = f"{TEST_DATA}/sf0.001"
# Reports that need the facts themselves and not a summary of them.
ON_FACTS = {
    "transactions_per_store",
    "items_per_kind",
    "sold_items_per_store",
}


def plan(frame) -> str:
    shown = io.StringIO()
    whole = {"spark__sql__maxMetadataStringLength": "10000"}
    with settings(frame.sparkSession, **whole), contextlib.redirect_stdout(shown):
        frame.explain()
    return shown.getvalue()


@contextlib.contextmanager
def settings(spark, **values):
    values = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


NO_BROADCAST = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The hand-made shop as parquet tables."""
    folder = tmp_path_factory.mktemp("shop")
    made = shop(spark)
    tables = {}
    for name in ("transactions", "items", "daily_store"):
        getattr(made, name).write.parquet(f"{folder}/{name}")
        tables[name] = spark.read.parquet(f"{folder}/{name}")
    return RetailModel(
        tables["transactions"],
        tables["items"],
        made.store_groups,
        given={"daily_store": tables["daily_store"]},
    )


@pytest.mark.parametrize("name", registry.REPORTS)
def test_no_product_join_and_no_python(spark, name):
    text = plan(registry.queries()[name](spark, FOLDER))
    for operator in ("CartesianProduct", "NestedLoop", "Python", "Pandas", "SinglePartition, REPARTITION"):
        assert operator not in text


@pytest.mark.parametrize("name", sorted(set(registry.REPORTS) - ON_FACTS))
def test_reports_read_summaries_only(spark, name):
    files = registry.queries()[name](spark, FOLDER).inputFiles()
    assert files
    assert all(f"{kept.shared_folder(spark)}/tillbook/" in file for file in files)


def exchanges(text):
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)", text)
    return sorted([re.findall(r"([a-z_]+)#", key) for key in keys])


def test_facts_are_shuffled_once_for_all_summaries(spark, stored, tmp_path):
    with settings(spark, **NO_BROADCAST):
        assert exchanges(plan(RetailModel(stored.transactions, stored.items).sold)) == [["transaction_id"]] * 2
    model = testtables.load(spark, FOLDER)
    kept.forget()
    for frame in (summaries.daily_store(model.sold), summaries.item_hours(model.sold)):
        assert all("/sold-" in file for file in frame.inputFiles())
    # a transaction's items are folded before they are shuffled
    text = plan(summaries.daily_store(model.sold))
    assert exchanges(text) == [["store", "day"], ["store", "day", "transaction_id"]]
    assert text.index("Exchange hashpartitioning(store#", text.index("keys=[store#")) < text.index("partial_sum(price")


def test_one_day_of_timestamps_reads_one_month(spark):
    model = testtables.load(spark, FOLDER)
    text = plan(hourly.cups_by_timestamp_item(model, "ASIA", "2024-01-15"))
    assert re.search(r"PartitionFilters: \[.*month#\d+ >= 2024-01-01.*month#\d+ <= 2024-01-01", text)
    assert "GreaterThanOrEqual(day,2024-01-15), LessThanOrEqual(day,2024-01-15)" in text
    assert "EqualTo(store,ASIA)" in text
    assert len(exchanges(text)) == 1


def test_one_week_reads_its_months(spark):
    text = plan(week.week_grid(testtables.load(spark, FOLDER), "ASIA", 5, 2024))
    assert re.search(r"PartitionFilters: \[.*month#\d+ >= 2024-01-01.*month#\d+ <= 2024-02-01", text)


@pytest.mark.parametrize(
    "name",
    [
        "store_items",
        "item_flavours",
        "sales_by_time_of_day",
        "item_popularity_without_top",
        "best_worst_by_time_of_day",
        "store_menu",
        "store_menu_availability",
    ],
)
def test_reports_without_days_read_the_table_without_days(spark, name):
    files = registry.queries()[name](spark, FOLDER).inputFiles()
    assert files and all("/item_kinds-" in file for file in files)


def test_a_menu_needs_few_shuffles(spark):
    text = plan(registry.queries()["store_menu_availability"](spark, FOLDER))
    assert len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range)", text)) <= 4


def test_weeks_of_a_store_need_two_shuffles(spark):
    text = plan(registry.queries()["store_breakdown_weekofyear"](spark, FOLDER))
    assert len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range)", text)) == 2


def test_fact_columns_are_pruned(spark):
    text = plan(testtables.load(spark, FOLDER, keep_summaries=False).sold)
    (schema,) = (s for s in re.findall(r"ReadSchema: struct<(.*?)>", text) if "l_orderkey" in s)
    assert [column.split(":")[0] for column in schema.split(",")] == ["l_orderkey", "l_partkey", "l_extendedprice"]


def test_one_day_is_pushed_to_the_transaction_scan(stored):
    text = plan(on_day(of_store(stored.transactions, "Chesterfield"), "2022-07-05"))
    pushed = next(line for line in text.splitlines() if "ReadSchema" in line and "ts:" in line)
    assert "GreaterThanOrEqual(ts,2022-07-05T00:00)" in pushed
    assert "LessThan(ts,2022-07-06T00:00)" in pushed
    assert "EqualTo(store,Chesterfield)" in pushed


def test_one_day_of_item_hours_reads_one_month(spark):
    model = testtables.load(spark, FOLDER)
    text = plan(hourly.cups_by_hour_item(model, "ASIA", "2024-01-15"))
    assert re.search(r"PartitionFilters: \[.*month#\d+ >= 2024-01-01.*month#\d+ <= 2024-01-01", text)
    assert "GreaterThanOrEqual(day,2024-01-15), LessThanOrEqual(day,2024-01-15)" in text
    assert "EqualTo(store,ASIA)" in text


@pytest.mark.parametrize(
    "report",
    [
        lambda m: kpi.kpi_day_over_day(m),
        lambda m: kpi.kpi_day_over_day(m, "2022-07-05"),
        lambda m: hourly.compare_two_items(m, "Latte", "Mocha"),
        lambda m: popularity.item_popularity(m),
        lambda m: popularity.best_worst_by_time_of_day(m),
        lambda m: week.week_availability(m),
    ],
)
def test_one_scan_per_report(spark, report):
    text = plan(report(testtables.load(spark, FOLDER)))
    assert text.count("FileScan") == 1


def test_summary_is_written_once(spark):
    first = testtables.load(spark, FOLDER).daily_store.inputFiles()
    assert testtables.load(spark, FOLDER).daily_store.inputFiles() == first
    kept.forget()
    assert testtables.load(spark, FOLDER).daily_store.inputFiles() != first


def test_changed_input_gives_a_new_summary(spark, tmp_path):
    tables = tmp_path / "tables"
    for name in testtables.INPUTS:
        spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(f"{tables}/{name}.parquet")
    before = testtables.load(spark, str(tables)).store_days.count()
    events = spark.read.parquet(f"{FOLDER}/events.parquet").where("event_id < 10")
    events.write.mode("overwrite").parquet(f"{tables}/events.parquet")
    assert testtables.load(spark, str(tables)).store_days.count() < before


def test_without_shared_folder_summaries_stay_in_the_plan(spark, monkeypatch):
    monkeypatch.setattr(kept, "shared_folder", lambda session: None)
    frame = kpi.kpi_snapshot(testtables.load(spark, FOLDER))
    assert any(file.endswith("lineitem.parquet") for file in frame.inputFiles())
    assert frame.count() == 30


def test_removed_summary_is_built_again(spark, monkeypatch):
    first = testtables.load(spark, FOLDER).daily_store.inputFiles()
    monkeypatch.setattr(kept, "_is_complete", lambda session, path: False)
    assert testtables.load(spark, FOLDER).daily_store.inputFiles() != first
