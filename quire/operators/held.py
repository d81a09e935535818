"""The section numbers a table holds, as bitmaps: one row per work and 32,768 numbers.

What is missing is then a join with these rows, not with every stored key. A bitmap ends with its last set bit, so a short work takes
a few bytes, and the bitmaps of several tables merge to those of their union.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Numbers of a bitmap, as Spark's bitmap functions deal them.
BUCKET = 32_768
SCHEMA = "work_id string, bucket long, bits binary, n long"


def _bucket(number: Column) -> Column:
    return F.bitmap_bucket_number(number.cast("bigint"))


def _bit(number: Column) -> Column:
    return F.bitmap_bit_position(number.cast("bigint"))


def held(sections: DataFrame, number: str = "number") -> DataFrame:
    """(work_id, bucket, bits, n): the numbers of each work; ``n`` counts them. Repeated numbers count once, null ones not at all."""
    rows = sections.filter(F.col(number).isNotNull()).select("work_id", _bucket(F.col(number)).alias("bucket"), _bit(F.col(number)).alias("_bit"))
    return _trimmed(rows.groupBy("work_id", "bucket").agg(F.bitmap_construct_agg("_bit").alias("bits"), F.max("_bit").alias("_last")))


def merged(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The bitmaps of all numbers of some tables of bitmaps."""
    rows = reduce(DataFrame.unionByName, others, first)
    return _trimmed(rows.groupBy("work_id", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"), F.max(8 * F.octet_length("bits") - 1).alias("_last")))


def _trimmed(rows: DataFrame) -> DataFrame:
    bits = F.substring(F.col("bits"), F.lit(1), F.expr("int(_last div 8) + 1"))
    return rows.select("work_id", "bucket", bits.alias("bits"), F.bitmap_count("bits").alias("n"))


def has(bits: Column, number: Column) -> Column:
    """Is the bit of ``number`` set in the bitmap of its bucket? False behind the end and without a bitmap."""
    place = _bit(number)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.expr("1") == (F.floor(byte / F.pow(F.lit(2), place % 8)).cast("int") % 2), F.lit(False))


def with_held(rows: DataFrame, table: DataFrame, name: str = "held", number: str = "number") -> DataFrame:
    """``rows`` with a flag: does the work hold the number? A hot work's rows meet its bitmaps bucket by bucket."""
    known = table.select(F.col("work_id").alias("_w"), F.col("bucket").alias("_b"), F.col("bits").alias("_bits"))
    joined = rows.withColumn("_bucket", _bucket(F.col(number))).join(known, (F.col("work_id") == F.col("_w")) & (F.col("_bucket") == F.col("_b")), "left")
    return joined.select(*rows.columns, has(F.col("_bits"), F.col(number)).alias(name))


def without_held(rows: DataFrame, table: DataFrame, number: str = "number") -> DataFrame:
    """The rows whose number the work does not hold."""
    return with_held(rows, table, "_held", number).filter(~F.col("_held")).select(*rows.columns)
