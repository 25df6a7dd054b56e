"""Queries on keys as large as those of larger tables."""

import duckdb
from pyspark.sql import functions as F

from factloom.plans import ALL_QUERIES, ALL_SQL
from factloom.sources import tables


def same_as_sql(spark, name, folder, made):
    for t, df in made.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
    con = duckdb.connect()
    for t in made:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    found = ALL_QUERIES[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({ALL_SQL[name]})").fetchall()
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    return want


def test_closure_on_paths_longer_than_the_sql_follows(spark, tmp_path):
    parts = spark.range(22).select(F.pow(F.lit(2.0), "id").cast("long").alias("p_partkey"))
    rows = same_as_sql(spark, "closure", tmp_path, {"part": parts})
    assert max(r[2] for r in rows) == 20


def test_uplift_labels_of_orders_with_seven_digits(spark, tmp_path):
    keys = spark.createDataFrame([(k,) for k in (7, 99_999, 149_995, 1_000_001, 1_000_002, 8_999_995, 54_000_003)], "o_orderkey long")
    same_as_sql(spark, "uplift_labels", tmp_path, {"orders": keys})


def test_dealt_rows_take_partitions_by_their_number(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    assert tables.dealt(df, 100, "k").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert tables.dealt(df, 20 * tables.TASK_ROWS, "k").rdd.getNumPartitions() == 20


def test_closure_follows_paths_to_their_end(spark, tmp_path):
    parts = spark.range(25).select(F.pow(F.lit(2.0), "id").cast("long").alias("p_partkey"))
    rows = same_as_sql(spark, "closure", tmp_path, {"part": parts})
    assert max(r[2] for r in rows) == 25  # from the largest to 1 and on to 3
    assert len(rows) == 25 * 26 // 2  # the part of n edges to 1 reaches n parts and 3


def test_closure_of_keys_beyond_what_a_double_holds(spark, tmp_path):
    parts = spark.createDataFrame([(2**55 + 6,), (2**54 + 3,), (2**53 + 1,)], "p_partkey long")
    rows = same_as_sql(spark, "closure", tmp_path, {"part": parts})
    assert (2**55 + 6, 2**54 + 3, 1) in rows and len(rows) == 6
