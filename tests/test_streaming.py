"""The daily table written by a stream equals that of a batch, over late rows and restarts."""

import glob
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from compare import TEST_DATA, spark_rows, sql_rows, tables
from shop import items_frame, transactions_frame
from tillbook.operators import summaries
from tillbook.sources import kept
from tillbook.streaming import rollup

COLUMNS = ("store", "day", "revenue", "avg_spend", "customers", "coffees")
SCHEMA = "transaction_id bigint, ts timestamp_ntz, store string, time_of_day int"


def rows_of(frame):
    return sorted(map(str, frame.select(*COLUMNS).collect()))


class Shop:
    """A folder in which slices of transactions arrive, and the stream over it."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.all = spark, str(folder), []
        self.items = items_frame(spark, [(k, "Latte" if k % 5 else None, None, "Large") for k in range(0, 400) for _ in range(1 + k % 3) if k % 11])

    def arrive(self, rows):
        self.all += rows
        transactions_frame(self.spark, rows).coalesce(1).write.mode("append").parquet(f"{self.folder}/arrivals")

    def run(self, lateness="7 days", checkpoint="checkpoint"):
        stream = self.spark.readStream.schema(SCHEMA).parquet(f"{self.folder}/arrivals")
        query = rollup.roll_up(stream, summaries.baskets(self.items), f"{self.folder}/days", f"{self.folder}/{checkpoint}", lateness)
        query.awaitTermination()
        assert query.exception() is None

    def streamed(self):
        return kept.saved(self.spark, f"{self.folder}/days")["daily_store"]

    def batch(self, rows=None):
        return summaries.daily_store(transactions_frame(self.spark, self.all if rows is None else rows), self.items)


def slice_of(ids, days):
    return [(i, f"2022-{days[k % len(days)]} {9 + i % 9:02}:15", ("Uppingham", "London Soho")[i % 2], 1) for k, i in enumerate(ids)]


@pytest.fixture
def till(spark, tmp_path):
    return Shop(spark, tmp_path)


def test_three_slices_one_late_and_a_restart(till):
    till.arrive(slice_of(range(0, 120), ["06-27", "06-28", "06-29", "06-30"]))
    till.run()
    assert rows_of(till.streamed()) == rows_of(till.batch())
    # late rows of days that are written already, over the end of a month
    till.arrive(slice_of(range(120, 200), ["06-29", "07-01", "07-02", "06-30"]))
    till.run()
    assert rows_of(till.streamed()) == rows_of(till.batch())
    before = till.streamed().inputFiles()
    till.arrive(slice_of(range(200, 260), ["07-03", "07-04"]))
    till.run()
    assert rows_of(till.streamed()) == rows_of(till.batch())
    june = {file for file in before if "month=2022-06" in file}
    assert june and june <= set(till.streamed().inputFiles())  # a month without changes stays as it is


def test_a_batch_that_failed_is_run_again_once(till, monkeypatch):
    till.arrive(slice_of(range(0, 80), ["06-30", "07-01"]))
    till.run()
    till.arrive(slice_of(range(80, 160), ["07-01", "07-02"]))
    publish = kept._publish

    def lost(*args):
        publish(*args)
        raise RuntimeError("lost after the switch")

    monkeypatch.setattr(kept, "_publish", lost)
    with pytest.raises(Exception, match="lost after the switch"):
        till.run()
    monkeypatch.setattr(kept, "_publish", publish)
    versions = kept._manifests(till.spark, f"{till.folder}/days")
    till.run()
    assert rows_of(till.streamed()) == rows_of(till.batch())
    assert kept._manifests(till.spark, f"{till.folder}/days") == versions  # the batch was there already


def test_a_batch_that_failed_before_the_switch_leaves_the_old_version(till, monkeypatch):
    till.arrive(slice_of(range(0, 80), ["06-30", "07-01"]))
    till.run()
    old = rows_of(till.streamed())
    till.arrive(slice_of(range(80, 160), ["07-01", "07-02"]))
    with monkeypatch.context() as patch:
        patch.setattr(kept, "_publish", lambda *args: 1 / 0)
        with pytest.raises(Exception, match="division"):
            till.run()
    assert rows_of(till.streamed()) == old
    till.run()
    assert rows_of(till.streamed()) == rows_of(till.batch())


def test_rows_beyond_the_lateness_are_left_to_a_refresh(till):
    early = slice_of(range(0, 60), ["06-20", "06-21"])
    till.arrive(early)
    till.run("2 days")
    till.arrive(slice_of(range(60, 120), ["07-05", "07-06"]))
    till.run("2 days")
    on_time = list(till.all)
    till.arrive(slice_of(range(120, 140), ["06-20"]))
    till.run("2 days")
    assert rows_of(till.streamed()) == rows_of(till.batch(on_time))


def test_versions_can_be_vacuumed(till):
    till.arrive(slice_of(range(0, 60), ["06-30"]))
    till.run()
    till.arrive(slice_of(range(60, 120), ["06-30"]))
    till.run()
    kept.vacuum(till.spark, f"{till.folder}/days")
    assert rows_of(till.streamed()) == rows_of(till.batch())
    assert till.streamed().where(F.col("month").isNull()).count() == 0


class Undated(Shop):
    """Transactions of the year 1900 have no time."""

    def frame(self, rows):
        return transactions_frame(self.spark, rows).withColumn("ts", F.expr("if(year(ts) = 1900, null, ts)"))

    def arrive(self, rows):
        self.all += rows
        self.frame(rows).coalesce(1).write.mode("append").parquet(f"{self.folder}/arrivals")

    def batch(self):
        return summaries.daily_store(self.frame(self.all), self.items)


def test_transactions_that_come_twice_or_without_a_time(spark, tmp_path):
    till, never = Undated(spark, tmp_path), "1900-01-01 00:00"
    rows = slice_of(range(0, 60), ["06-29", "06-30"]) + [(k, never, "Uppingham", 1) for k in (61, 62, 62)]
    till.arrive([*rows, *rows[:20], (5, "1969-07-20 20:17", "Uppingham", 1)])
    till.run()
    assert rows_of(till.streamed()) == rows_of(till.batch())
    till.arrive([*rows[10:30], (63, never, "Uppingham", 1), (62, never, "Uppingham", 1)])
    till.run()
    assert rows_of(till.streamed()) == rows_of(till.batch())


@pytest.mark.parametrize("folder", [False, True])
def test_streamed_query_over_a_file_or_a_folder_equals_its_sql(spark, tmp_path, folder):
    for path in glob.glob(f"{TEST_DATA}/sf0.001/*.parquet"):
        os.symlink(path, tmp_path / os.path.basename(path))
    if folder:
        os.unlink(tmp_path / "events.parquet")
        events = spark.read.parquet(f"{TEST_DATA}/sf0.001/events.parquet")
        events.unionAll(events.limit(50)).repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    columns, expected = sql_rows(tables(str(tmp_path)), registry.oracle_sql()["daily_store_streamed"])
    found = registry.daily_store_streamed(spark, str(tmp_path))
    assert sorted(found.columns) == columns
    assert spark_rows(found) == expected and expected
