"""Bitmaps of fixed size that say which rows may have a partner, so that the others need not move.

Each value sets one bit of BITS by its hash. The bitmap is broadcast in rows of
ROW_BITS (as bitmap_construct_agg has them): 4 MB in all, however many values
there are. A row whose bit isn't set has no partner for sure; one whose bit is
set goes on to the exact join. With very many values nearly all bits are set, and
then nearly all rows move, as they would without.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, ROW_BITS = 1 << 25, 1 << 15


def bit(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(BITS)) + 1


def bitmap(values: DataFrame) -> DataFrame:
    """(bucket, bitmap), at most BITS / ROW_BITS rows, of a frame with one column."""
    at = values.select(bit(F.col(values.columns[0])).alias("x"))
    return at.groupBy(F.expr("bitmap_bucket_number(x)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(x))").alias("bitmap"))


def marked(rows: DataFrame, value: Column, bits: DataFrame, name: str) -> DataFrame:
    """rows with a column that says whether the bit of value is set."""
    with_bit = rows.withColumn("__x", bit(value)).withColumn("__bucket", F.expr("bitmap_bucket_number(__x)"))
    joined = with_bit.join(F.broadcast(bits.toDF("__bucket", "__bitmap")), "__bucket", "left")
    place = (F.col("__x") - 1) % ROW_BITS
    byte = F.conv(F.hex(F.substring("__bitmap", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1, F.lit(False))
    return joined.withColumn(name, is_set).drop("__x", "__bucket", "__bitmap")


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows whose key isn't among the one column of gone; null keys stay."""
    found = marked(rows, F.col(f"`{key}`"), bitmap(gone), "__maybe")
    left = found.where("__maybe").join(gone.toDF("__gone"), F.col(f"`{key}`") == F.col("__gone"), "left_anti")
    return found.where("not __maybe").unionByName(left).drop("__maybe")
