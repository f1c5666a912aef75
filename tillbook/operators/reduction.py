"""Rows of a large table that may have a partner in a smaller one, found before the large one is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Bits of the filter for each id; about one other row in BITS_PER_ID passes.
BITS_PER_ID = 16
#: Bits in one row of the filter: fixed by the bitmap functions.
ROW_BITS = 32_768
#: The largest filter that is broadcast; with more ids, rows are only restricted to the range of ids.
MAX_BITS = 1 << 29


def _position(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits)) + 1


def id_bitmaps(ids: DataFrame, key: str, bits: int) -> DataFrame:
    """(bucket, bitmap): a bit for the hash of each id, in rows of 4 kB; folded before its shuffle."""
    place = _position(F.col(key), bits)
    return ids.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap")
    )


def reduced(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` may be among the ids; rows with another key may stay, none with an id is lost.

    The least and the greatest id go down to the scan of ``rows``; a bitmap of hashed ids, of MAX_BITS / 8
    bytes at most, is broadcast and tested where the rows are read, so they keep their partitioning
    and only those that pass are shuffled. Without ids nothing stays; null keys never do.
    """
    column = F.col(key)
    known = ids.where(column.isNotNull())
    bounds = known.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n")).first()
    if not bounds["n"]:
        return rows.limit(0)
    near = rows.where(column.between(F.lit(bounds["low"]), F.lit(bounds["high"])))
    bits = max(ROW_BITS, 1 << (bounds["n"] * BITS_PER_ID - 1).bit_length())
    if bits > MAX_BITS:
        return near
    place = _position(column, bits)
    bitmaps = F.broadcast(id_bitmaps(known, key, bits))
    bit = F.bitmap_bit_position(place).cast("int")
    byte = F.ascii(F.decode(F.substring(F.col("bitmap"), F.shiftright(bit, 3) + 1, F.lit(1)), "ISO-8859-1"))
    there = F.call_function("shiftright", byte, bit.bitwiseAND(7)).bitwiseAND(1) == 1
    return near.join(bitmaps, (F.bitmap_bucket_number(place) == F.col("bucket")) & there).select(rows["*"])
