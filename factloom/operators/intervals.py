"""Ranges joined with what lies in them by equality: places in a sorted order, and a tree of blocks above them.

The different values of a key are numbered in their order, and a range becomes an interval of numbers. Blocks of 1, 2, 4, ... numbers
stand above each value; an interval is the union of at most two blocks a level, none of which overlap. So a range meets what
is in it on (key, level, block), an equal join, and meets sums of blocks instead of rows where sums are wanted: the
rows that a join makes follow the ranges and the logarithm of the values, not the pairs. A key that holds all rows is
spread over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.scan import running_sum
from factloom.sources.tables import saved

#: Sorts behind every bound.
_LAST = "\U0010ffff"


def numbered(values: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, place: the different values of each key, from 0 in their order."""
    one = running_sum(values.select(key, value).distinct(), [key], [F.col(value)], F.lit(1).cast("long"), "place")
    return saved(one.withColumn("place", F.col("place") - 1), "places")


def intervals(ranges: DataFrame, places: DataFrame, key: str, value: str, id: str) -> DataFrame:
    """id, key, first, upto: the numbers of `places` that ranges(id, key, low, low_open, high, high_open) cover, from first
    to before upto; a NULL bound is open. One running count over values and bounds together."""
    bound = lambda end, at, tie: ranges.select(key, F.col(id).alias("_id"), F.lit(end).alias("_end"), at.alias("_at"), tie.cast("int").alias("_tie"), F.lit(0).cast("long").alias("_one"))
    low = bound("first", F.coalesce("low", F.lit("")), F.when(F.col("low_open"), 2).otherwise(0))
    high = bound("upto", F.coalesce("high", F.lit(_LAST)), F.when(F.col("high").isNotNull() & F.col("high_open"), 0).otherwise(2))
    rows = places.select(key, F.lit(None).cast(ranges.schema[id].dataType).alias("_id"), F.lit(None).cast("string").alias("_end"), F.col(value).alias("_at"), F.lit(1).alias("_tie"), F.lit(1).cast("long").alias("_one"))
    counted = running_sum(rows.unionByName(low).unionByName(high), [key], [F.col("_at"), F.col("_tie"), F.col("_id"), F.col("_end")], F.col("_one"), "_n").filter("_end IS NOT NULL")
    by = counted.groupBy(F.col("_id").alias(id), key)
    return by.agg(F.max(F.when(F.col("_end") == "first", F.col("_n"))).alias("first"), F.max(F.when(F.col("_end") == "upto", F.col("_n"))).alias("upto"))


def levels(places: DataFrame) -> int:
    """Levels that blocks over these places need."""
    return int(places.agg(F.max("place")).first()[0] or 0).bit_length() + 1


def blocks_of(first: Column, upto: Column, n: int) -> Column:
    """Array of (level, block): the largest blocks that make up the numbers from first to before upto."""

    def at(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level).cast("long")
        a, b = F.floor((first + size - 1) / size).cast("long"), F.floor(upto / size).cast("long")
        left = F.when((a < b) & (a % 2 == 1), F.struct(level.alias("level"), a.alias("block")))
        right = F.when((a + a % 2 < b) & (b % 2 == 1), F.struct(level.alias("level"), (b - 1).alias("block")))
        return F.array_compact(F.array(left, right))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n)), at))


def above(place: Column, n: int) -> Column:
    """Array of (level, block): the blocks above one place."""
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.struct(k.alias("level"), F.floor(place / F.pow(F.lit(2.0), k)).cast("long").alias("block")))
