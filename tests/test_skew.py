"""Hot keys: one transaction, one customer and one part hold a third of the rows."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from compare import TEST_DATA, spark_rows, sql_rows, tables
from test_plans import NO_BROADCAST, plan, settings
from tillbook.operators import summaries
from tillbook.sources import testtables

SOURCE = f"{TEST_DATA}/sf0.01"
HOT = {
    "lineitem": {
        "l_orderkey": "CASE WHEN l_linenumber % 3 = 0 OR l_suppkey % 7 = 0 THEN 4242 ELSE l_orderkey END",
        "l_partkey": "CASE WHEN l_suppkey % 3 = 0 THEN 17 ELSE l_partkey END",
    },
    "events": {"user_id": "CASE WHEN event_id % 3 = 0 THEN 5 ELSE user_id END"},
}
# Small enough for adaptive execution to take the hot partitions of the test for
# skewed ones.
SKEWED = {
    **NO_BROADCAST,
    "spark__sql__shuffle__partitions": "16",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "16k",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "24k",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "2",
}
NAMES = (
    "transactions_per_store",
    "items_per_kind",
    "sold_items_per_store",
    "daily_store",
    "store_days",
    "item_hours",
    "cups_by_timestamp_item",
    "hourly_insights",
    "kpi_day_over_day",
    "compare_two_items_advanced",
    "best_worst_by_time_of_day",
    "store_menu_availability",
)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    target = tmp_path_factory.mktemp("hot")
    for name in testtables.INPUTS:
        rows = spark.read.parquet(f"{SOURCE}/{name}.parquet")
        hot = {column: F.expr(rule).cast("bigint") for column, rule in HOT.get(name, {}).items()}
        rows.withColumns(hot).repartition(8).write.parquet(f"{target}/{name}.parquet")
    return str(target)


@pytest.mark.parametrize("name", NAMES)
def test_hot_keys_give_the_same_rows(spark, folder, name):
    with settings(spark, **SKEWED):
        actual = spark_rows(registry.queries()[name](spark, folder))
    _, expected = sql_rows(tables(folder), registry.oracle_sql()[name])
    assert actual == expected


def test_joins_are_split_at_the_hot_keys(spark, folder):
    with settings(spark, **SKEWED):
        frame = testtables.load(spark, folder, keep_summaries=False).item_hours
        frame.collect()
        text = plan(frame)
    assert "isFinalPlan=true" in text
    final = text.split("== Initial Plan ==")[0]
    joins = [line for line in final.splitlines() if "SortMergeJoin" in line]
    for key in ("transaction_id", "l_partkey", "user_id"):
        assert any(f"[{key}#" in join and "skew=true" in join for join in joins), (key, joins)


def test_hot_transaction_is_folded_before_the_daily_shuffle(spark, folder):
    """The fold of the daily table gets one row per transaction and task at most."""
    items = testtables.items(spark, folder)
    assert items.where("transaction_id = 4242").count() > items.count() / 3
    with settings(spark, **SKEWED):
        text = plan(summaries.daily_store(testtables.load(spark, folder).sold))
    shuffled = text.index("Exchange hashpartitioning(store#", text.index("transaction_id"))
    assert text.index("partial_sum(price") > shuffled
