import math
import time

from helpers import documents, odd_texts
from pyspark.sql import functions as F
from tillbook.llm.mixing import cumulative, mix, rates, uniform


def test_cumulative_is_poisson(spark):
    for rate in (0.01, 1.0, 7.5, 150.0, 300.0, 900.0, 1e6):
        row = cumulative(spark.createDataFrame([("s", rate)], "source string, rate double")).first()
        total = 0.0
        for k, value in enumerate(row["below"], row["first"]):
            total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
            assert abs(value - total) < 1e-8
        assert abs(row["below"][-1] - 1) < 1e-7
        assert row["first"] == 0 or row["below"][0] < 1e-16


def test_a_rate_of_a_million(spark):
    frame = documents(spark, [(0, "x", "en", "small"), (1, "y" * 4_000_000, "en", "large")])
    started = time.time()
    mixed = mix(frame, {"small": 1.0, "large": 3.0})
    counts = {r["source"]: (r["count"], r["copies"]) for r in mixed.groupBy("source").agg(F.count("*").alias("count"), F.countDistinct("copy").alias("copies")).collect()}
    assert abs(counts["small"][0] - 1_000_000) < 6_000 and counts["small"][0] == counts["small"][1]
    assert time.time() - started < 60


def test_rows_without_an_id_of_their_own_are_drawn_apart(spark):
    rows = spark.range(6000).selectExpr("CASE WHEN id % 3 = 1 THEN NULL WHEN id % 3 = 2 THEN 7 ELSE 10 + id END AS doc_id", "'same' AS text", "'s' AS source")
    mixed = mix(rows, epochs=3.0).withColumn("part", F.spark_partition_id())
    for condition in ("doc_id IS NULL", "doc_id = 7"):
        own = mixed.where(condition)
        assert abs(own.count() / 2000 - 3) < 0.2
        assert own.select("shuffle_key").distinct().count() == own.count()
        assert own.select("part").distinct().count() > 1
        # copies of a row count from 0, so the number of first copies is that of rows that were drawn at all
        assert abs(own.where("copy = 0").count() / 2000 - (1 - math.exp(-3))) < 0.03
    plain = spark.range(6000).selectExpr("10 + id AS doc_id", "'same' AS text", "'s' AS source").where("doc_id % 3 = 1")
    keys = {r["shuffle_key"] for r in mix(plain, epochs=3.0).collect()}
    assert keys == {r["shuffle_key"] for r in mixed.where("doc_id <> 7").select("shuffle_key").collect()}


def test_rates_meet_the_weights(spark):
    rows = [(i, "x" * 10, "en", "a") for i in range(90)] + [(100 + i, "y" * 30, "en", "b") for i in range(10)]
    frame = documents(spark, rows)
    found = {r["source"]: r["rate"] for r in rates(frame, {"a": 1.0, "b": 3.0, "zzz": 9.0}, epochs=2.0).collect()}
    assert abs(found["a"] * 900 - 2 * 1200 / 4) < 1e-9
    assert abs(found["b"] * 300 - 2 * 1200 * 3 / 4) < 1e-9
    found = {r["source"]: r["rate"] for r in rates(frame, {"b": 1.0}).collect()}
    assert found["a"] == 0


def test_counts_follow_the_rate_and_the_seed(spark):
    frame = spark.range(20_000).selectExpr("id AS doc_id", "'text' AS text", "'s' AS source")
    counts = {r["doc_id"]: r["count"] for r in mix(frame, epochs=2.5).groupBy("doc_id").count().collect()}
    assert abs(sum(counts.values()) / 20_000 - 2.5) < 0.05
    assert abs(1 - len(counts) / 20_000 - math.exp(-2.5)) < 0.01
    assert mix(frame, epochs=2.5).exceptAll(mix(frame.repartition(7), epochs=2.5)).count() == 0
    assert mix(frame, epochs=2.5, seed=1).exceptAll(mix(frame, epochs=2.5)).count() > 0


def test_copies_are_numbered_and_sorted(spark):
    frame = documents(spark, [(i, f"text {i}") for i in range(200)], extra="copy _n rate _source _cdf _part _below _first _at _shared")
    mixed = mix(frame, epochs=3.0)
    rows = mixed.withColumn("part", F.spark_partition_id()).collect()
    for part in {r["part"] for r in rows}:
        keys = [r["shuffle_key"] for r in rows if r["part"] == part]
        assert keys == sorted(keys)
    assert mixed.columns == [*(c for c in frame.columns if c != "copy"), "copy", "shuffle_key"]
    assert {r["_n"] for r in rows} == {r["_source"] for r in rows} == {"clash"}
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], set()).add(r["copy"])
    assert all(copies == set(range(len(copies))) for copies in by_doc.values())


def test_odd_rows(spark):
    texts = [(i, t, None, None) if i == 5 else (i, t, "en", "only-null" if i == 1 else "s") for i, t in odd_texts()]
    frame = documents(spark, texts)
    result = mix(frame, epochs=40.0)
    sources = {r["source"] for r in result.select("source").distinct().collect()}
    assert sources == {None, "s"}
    assert result.where("text IS NULL").count() == 0
    assert mix(frame.limit(0)).count() == 0
    assert mix(frame, weights={}).count() == 0


def test_uniform(spark):
    row = spark.range(5000).select(uniform(F.lit("x"), F.col("id")).alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= row[0] < 0.01 and 0.99 < row[1] < 1 and abs(row[2] - 0.5) < 0.02
