"""Running values within keys of any size: ranges are folded apart, and the state at their edges is carried.

Rows are dealt by ranges of key and order. A range is worked on alone; what it must know of the ranges of its key before it is one
row each. So a key that holds all rows runs on all tasks, and a task holds no more than its range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.tables import saved


def _dealt(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    ranges = rows.repartitionByRange(*[F.col(k) for k in keys], *order)
    return saved(ranges.withColumn("_range", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id()))


def _joined(local: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ranges with what is carried into their range."""
    named = edges.select(*[F.col(c).alias(f"_of_{i}") for i, c in enumerate(by)], "_before")
    return local.join(named, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate(by)]))


def running_sum(rows: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """rows with the sum of `value` over the rows of their key up to and with them, in an order that tells them apart; NULL
    counts as 0."""
    dealt = _dealt(rows.withColumn("_value", F.coalesce(value, F.lit(0))), keys, order)
    by = [*keys, "_range"]
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    edges = dealt.groupBy(*by).agg(F.sum("_value").alias("_sum")).select(*by, F.sum("_sum").over(before).alias("_before"))
    local = dealt.withColumn("_local", F.sum("_value").over(Window.partitionBy(*by).orderBy(*order, "_nth").rowsBetween(Window.unboundedPreceding, 0)))
    return _joined(local, edges, by).select(*rows.columns, (F.coalesce("_before", F.lit(0)) + F.col("_local")).alias(name))


def running_last(rows: DataFrame, keys: list[str], order: list[Column], value: Column, name: str, before: bool = False) -> DataFrame:
    """rows with the last `value` that is not NULL among the rows of their key up to and with them (before: only those before
    them), in an order that tells them apart."""
    dealt = _dealt(rows.withColumn("_value", F.when(value.isNotNull(), F.struct(value.alias("v")))), keys, order)
    by = [*keys, "_range"]
    inside = Window.partitionBy(*by).orderBy(*order, "_nth")
    upto = inside.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    local = dealt.withColumn("_local", F.last("_value", ignorenulls=True).over(upto)).withColumn("_edge", F.last("_value", ignorenulls=True).over(whole))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = local.groupBy(*by).agg(F.first("_edge").alias("_edge")).select(*by, F.last("_edge", ignorenulls=True).over(earlier).alias("_before"))
    return _joined(local, carried, by).select(*rows.columns, F.coalesce("_local", "_before")["v"].alias(name))
