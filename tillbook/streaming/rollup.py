"""The daily table of every store, kept up to date by a stream of transactions.

Each micro-batch joins its transactions with their baskets and adds them to the state, one row per store
and day. Days whose totals changed replace their old rows in the folder: their months are written
anew and the folder's manifest switches to them, naming the batch, so a batch that is run again after a
failure changes nothing. State, the ids of transactions included, is dropped when the watermark has passed a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tillbook.sources import kept

#: How much later than the latest one a transaction may arrive and still be counted.
LATENESS = "7 days"


def daily_totals(transactions: DataFrame, baskets: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """The columns of ``daily_store`` from a stream of transactions, as totals of whole days so far.

    ``baskets`` is a table with one row per transaction (``summaries.baskets``). Transactions without
    a basket have sold nothing and don't count, as in the batch table. A transaction that arrives twice
    for a store and day is one customer who paid twice; those that have come are
    remembered until the watermark has passed their day. Transactions without a time are of no day; their
    totals are never late.
    """
    visits = transactions.select("transaction_id", "store", _dated(F.col("ts")).alias("dated"))
    visits = visits.withWatermark("dated", f"{lateness} 1 day")  # of whole days, so that no transaction in time is late
    paid = visits.join(baskets, "transaction_id").select("store", "dated", "revenue", "coffees", F.lit(0).alias("customers"))
    first = visits.join(baskets.select("transaction_id"), "transaction_id").dropDuplicates(["transaction_id", "store", "dated"])
    none = [F.lit(None).cast(paid.schema[name].dataType).alias(name) for name in ("revenue", "coffees")]
    totals = (
        paid.unionAll(first.select("store", "dated", *none, F.lit(1).alias("customers")))
        .groupBy("store", "dated")
        .agg(
            F.sum("revenue").cast("decimal(28,2)").alias("revenue"),
            F.sum("customers").alias("customers"),
            F.sum("coffees").alias("coffees"),
        )
    )
    return totals.select(
        "store",
        "revenue",
        (F.col("revenue") / F.col("customers")).cast("decimal(22,6)").alias("avg_spend"),
        "customers",
        "coffees",
        F.date_from_unix_date((F.unix_seconds("dated") / _DAY - _EPOCH).cast("int")).alias("day"),
    )


_DAY = 86_400
#: Days from year 1 to 1970, where a stream's watermark begins: no day may lie before it.
_EPOCH = 719_163


def _dated(ts: Column) -> Column:
    """The day of the wall-clock time as an instant, as a watermark needs one; the same in a session of any zone."""
    return F.timestamp_seconds((F.unix_date(F.to_date(ts)) + F.lit(_EPOCH)).cast("bigint") * _DAY)


def roll_up(
    transactions: DataFrame,
    baskets: DataFrame,
    folder: str,
    checkpoint: str,
    lateness: str = LATENESS,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the stream; ``kept.saved(spark, folder)`` reads what it has written, at any time.

    By default it handles what is there and ends. The folder belongs to the stream, and the checkpoint
    to the folder: a new checkpoint over an old folder begins its days again from zero and replaces them. A
    transaction later than ``lateness`` is dropped by the watermark; ``kept.refresh`` of its month adds it.
    """

    def merge(changed: DataFrame, batch: int) -> None:
        if not kept.replace_days(changed.sparkSession, folder, "daily_store", changed, checkpoint, batch):
            changed.write.format("noop").mode("overwrite").save()  # the state must be brought forward all the same

    return (
        daily_totals(transactions, baskets, lateness)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(merge)
        .start()
    )
