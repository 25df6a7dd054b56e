"""Reading the tables of a folder; scratch tables in the shared folder."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table, as JSON text, that may be broadcast; beyond it the same join shuffles.
BROADCAST_BYTES = 16 << 20

#: Rows of a task, about, where rows are dealt by their number.
TASK_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local master has one disk for all and may do
    without (a folder below the warehouse then); a cluster may not."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return named.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, label: str = "table") -> DataFrame:
    """df written to the shared folder and read back: lineage is cut, and a lost executor loses nothing."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bytes_of(df: DataFrame) -> int:
    """Bytes of the rows as JSON text: one pass, nothing is collected but the sum."""
    return df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows have at most `most` bytes, else df as it is, so that the join shuffles."""
    return F.broadcast(df) if bytes_of(df) <= most else df


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by keys over as many partitions as `rows` rows need, so that a task's share, and the memory of what is
    grouped or sorted in it, does not grow with the table. For keys that few rows share."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS)), *keys)


def paired(rows: DataFrame, rules: DataFrame, test: Column | None = None, most: int = BROADCAST_BYTES) -> DataFrame:
    """rows with each row of a rule table that passes the test (all, without one). Column names differ between both.

    A rule table of at most `most` bytes is broadcast. A larger one is dealt into parts of about that size, and rows into
    as many salts as there are shuffle partitions; each part meets each salt in one group of a shuffled join, so that no task
    holds more than a part, and no rule and no row is left out.
    """
    size = bytes_of(rules)
    if size <= most:
        small = F.broadcast(rules)
        return rows.crossJoin(small) if test is None else rows.join(small, test)
    parts, salts = math.ceil(size / most), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = lambda n: F.pmod(F.xxhash64(F.to_json(F.struct("*"))), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = rows.withColumn("_salt", hashed(salts)).withColumn("_part", every(parts))
    b = rules.withColumn("_of_part", hashed(parts)).withColumn("_of_salt", every(salts))
    same = (F.col("_salt") == F.col("_of_salt")) & (F.col("_part") == F.col("_of_part"))
    return a.join(b, same if test is None else same & test).drop("_salt", "_part", "_of_salt", "_of_part")
