"""Mixing sources to target weights: each document is repeated a Poisson number of times."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillbook.llm.common import hidden, written

#: If the distributions of all sources have more numbers than this, they are joined by a shuffle and not broadcast.
BROADCAST_NUMBERS = 2_000_000
#: Target weight of a source: its share of characters to this power, if no weights are given.
TEMPERATURE = 0.7
#: Fractional digits of a hash that make a uniform number: 13 hex digits, 52 bits.
_HEX = 13


def uniform(*parts: Column) -> Column:
    """A number from [0, 1) that is a function of the parts, in 52 bits; a null part is left out."""
    text = F.concat_ws(":", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, _HEX), 16, 10).cast("double") / F.lit(2.0 ** (4 * _HEX))


def rates(
    documents: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, temperature: float = TEMPERATURE
) -> DataFrame:
    """(source, rate): how often a document of each source is to appear on average.

    The mixture has ``epochs`` times the characters of all documents, divided among the sources
    in proportion to ``weights`` (a source that is not named gets 0; a null source is named
    ``""``), or else to their characters to the power ``temperature``.
    """
    sizes = documents.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(
        F.sum(F.greatest(F.length("text"), F.lit(0))).alias("chars")
    )
    sizes = sizes.where("chars > 0")
    if weights is None:
        weight = F.pow(F.col("chars").cast("double"), F.lit(float(temperature)))
    else:
        pairs = [F.lit(x) for s, w in weights.items() for x in (s, float(w))]
        named = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
        weight = F.coalesce(F.try_element_at(named, F.col("source")), F.lit(0.0))
    sizes = written(sizes.withColumn("weight", weight), "sizes")
    all_chars = sizes.agg(F.sum("chars").cast("double")).scalar()
    all_weight = sizes.agg(F.sum("weight")).scalar()
    share = F.coalesce(F.try_divide(F.col("weight"), all_weight), F.lit(0.0))
    return sizes.select("source", (F.lit(float(epochs)) * all_chars * share / F.col("chars")).alias("rate"))


def _log_factorial(k: Column) -> Column:
    """ln(k!): listed for small numbers, else Stirling's series, right to the digits of a double."""
    small = F.array(*(F.lit(math.lgamma(n + 1)) for n in range(64)))
    x = k.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(k < 64, F.get(small, k.cast("int"))).otherwise(series)


def cumulative(rates: DataFrame) -> DataFrame:
    """(source, first, below): P(X <= k) of Poisson's distribution for k = first, first + 1, ... of each rate.

    The numbers are those within twelve standard deviations of the rate; what is left out at
    either end is less than the digits of ``uniform``, so there are some 24 square roots of the rate.
    """
    rate, away = F.col("rate"), F.lit(12.0) * F.sqrt("rate") + F.lit(40.0)
    first = F.when(rate > away + 64, F.floor(rate - away)).otherwise(F.lit(0)).cast("long")
    last = F.ceil(rate + away).cast("long")
    terms = rates.select("source", "rate", first.alias("first"), F.explode(F.sequence(first, last)).alias("k"))
    term = F.exp(-rate + F.col("k") * F.log(rate) - _log_factorial(F.col("k")))
    so_far = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    terms = terms.select("source", "first", "k", F.sum(term).over(so_far).alias("below"))
    listed = terms.groupBy("source", "first").agg(F.array_sort(F.collect_list(F.struct("k", "below"))).alias("all"))
    return listed.select("source", "first", F.col("all.below").alias("below"))


def _numbered(documents: DataFrame, part: str) -> DataFrame:
    """The documents with a column that tells apart rows whose doc_id is null or shared, null for all others.

    Only if there are such rows is the table numbered and written, so that a row keeps its number.
    """
    ids = documents.groupBy(F.col("doc_id").alias("_shared")).agg(F.count("*").alias("_rows"))
    shared = written(ids.where("_rows > 1 OR _shared IS NULL").select("_shared"), "shared_ids")
    if shared.isEmpty():
        return documents.withColumn(part, F.lit(None).cast("string"))
    numbered = written(documents.withColumn(part, F.monotonically_increasing_id()), "numbered")
    marked = F.struct("_shared").alias("_marked")
    joined = numbered.join(shared.select("_shared", marked), F.col("doc_id").eqNullSafe(F.col("_shared")), "left")
    number = F.when(F.col("_marked").isNotNull(), F.col(part).cast("string"))
    return joined.select(*(F.col(f"`{c}`") for c in documents.columns), number.alias(part))


#: Copies of a document in one array, when it is repeated more often.
_SOME = 1 << 20


def _copies(documents: DataFrame, n: str, copy: str) -> DataFrame:
    """Each row ``n`` times with its number from 0, in lists of bounded length."""
    step = documents.withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(_SOME).cast("long"))))
    last = F.least(F.col(copy) + (_SOME - 1), F.col(n) - 1)
    return step.withColumn(copy, F.explode(F.sequence(F.col(copy), last)))


def mix(
    documents: DataFrame,
    weights: dict[str, float] | None = None,
    epochs: float = 1.0,
    temperature: float = TEMPERATURE,
    seed: int = 0,
) -> DataFrame:
    """Each document as often as Poisson's distribution says, in a random order, with copy and shuffle_key.

    The mean is the rate of the document's source (``rates``). The number is the inverse of the
    distribution at a hash of the seed and doc_id, so it doesn't depend on partitions or
    retries; copy counts from 0. shuffle_key is a hash of seed, doc_id and copy; rows are dealt
    to all partitions by it and sorted by it within each, so any order of the files is a random
    order of all documents. Rows whose doc_id is null or shared, repeated rows too, are told apart by a number
    they get as the table is read, so each has a draw and keys of its own. A null source is one of its
    own; documents of a source without any character, or of weight 0, don't appear, empty texts of
    other sources do. Columns named copy and shuffle_key are replaced.

    Sizes of all sources are counted over all rows and pre-aggregated. The distributions are
    broadcast up to ``BROADCAST_NUMBERS`` numbers and else joined by a shuffle, whose hot source
    the adaptive skew join splits. Texts are read once and move once, by a key that no source
    can skew.
    """
    source, first, below, part, n, at = hidden(documents, "_source", "_first", "_below", "_part", "_n", "_at")
    table = rates(documents, weights, epochs, temperature).where("rate > 0")
    table = written(cumulative(table).toDF(source, first, below), "rates")
    numbers = table.agg(F.sum(F.size(below))).first()[0] or 0
    table = F.broadcast(table) if numbers <= BROADCAST_NUMBERS else table
    rest = [c for c in documents.columns if c not in ("copy", "shuffle_key")]
    known = _numbered(documents.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*rest, "doc_id", "source"]))), part)
    parts = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col(part)]
    u = uniform(F.lit(f"count-{seed}"), *parts)
    count = F.col(first) + F.size(F.filter(below, lambda b: b <= u))
    drawn = known.join(table, F.coalesce("source", F.lit("")) == F.col(source)).withColumn(n, count).where(F.col(n) > 0)
    key = F.md5(F.concat_ws(":", F.lit(f"order-{seed}"), *parts, F.col(at).cast("string")))
    return (
        _copies(drawn, n, at)
        .select(*(F.col(f"`{c}`") for c in rest), F.col(at).cast("int").alias("copy"), key.alias("shuffle_key"))
        .repartition("shuffle_key")
        .sortWithinPartitions("shuffle_key")
    )
