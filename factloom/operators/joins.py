"""Joins beyond equality: as-of, ranges with unknown ends, grids, first matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.scan import running_last


def asof_forward(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, right_id: str) -> DataFrame:
    """For each left row the first right row of its key strictly later, ties by id: a union, ordered by key and time from
    the end, and the last right row so far; linear in the rows, and a key that holds all of them runs on all tasks."""

    a = left.select("*", F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[right_id].dataType).alias("_id"))
    b = right.select(F.col(key), F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.col(right_id).alias("_id"))
    both = a.unionByName(b, allowMissingColumns=True)
    # from the end, left rows come before right rows of the same time, so that what was met is strictly later
    order = [F.desc("_at"), F.desc("_side"), F.desc("_id")]
    out = running_last(both, [key], order, F.when(F.col("_side") == 0, F.struct(F.col("_at").alias("at"), F.col("_id").alias("id"))), "_next").filter("_side = 1")
    return out.select(*left.columns, F.col("_next.id").alias("next_id"), F.col("_next.at").alias("next_at"))


def fill_grid(rows: DataFrame, axes: list[DataFrame], keys: list[str], fill: dict[str, object]) -> DataFrame:
    """Every combination of the axes (short lists of distinct values), with the row there or the fill."""
    grid = axes[0]
    for axis in axes[1:]:
        grid = grid.crossJoin(axis)
    return grid.join(rows, keys, "left").fillna(fill)


def in_ranges(rows: DataFrame, ranges: DataFrame, key: str, value: Column) -> DataFrame:
    """rows joined with ranges(key, low, high) of their key; `inside` is unknown if the value is. The ranges are a rule
    table; Spark broadcasts it if it is small."""
    return rows.join(ranges, key).withColumn("inside", value.between(F.col("low"), F.col("high")))
