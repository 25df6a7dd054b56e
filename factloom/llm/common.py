"""What several operators share: tables, shared scratch tables, distributed numbering, checked broadcasts."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a checked broadcast may hold; beyond it the same join shuffles.
BROADCAST_ROWS = 1_000_000

#: Rows of an Arrow batch of texts, at most.
BATCH_ROWS = 1_000

#: The white space of every word contract: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local master has one disk for all and may do
    without (a folder below the warehouse then, as in tests); a cluster may not."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return named.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context, so that jobs need no set-up on executors, and
    keep what goes to them at once small: a batch of whole texts is held by Spark and by the worker both."""
    context = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(BATCH_ROWS, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))))
    if getattr(context, "_factloom_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "factloom.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join("factloom", os.path.relpath(path, top)))
    context.addPyFile(target)
    context._factloom_shipped = True


def lean(function):
    """A function of batches for mapInArrow, after which its worker gives back the memory that it has freed: workers are
    kept for later tasks, and what one stage has needed should not count in the next."""

    def run(batches):
        yield from function(batches)
        give_back()

    return run


def give_back() -> None:
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows (counted without reading more), else df as it is,
    so that the join shuffles. For narrow tables that are already materialised."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The words of a text, [] for null and for texts without words."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+")
    return F.filter(parts, lambda w: w != "")


def number_within(df: DataFrame, keys: list[str], order: list[str], name: str, bucket_rows: int = 20_000) -> DataFrame:
    """A gapless number from 0 for the rows of each key, without bringing a key to one task.

    Rows are dealt into hash buckets of about bucket_rows rows within their key; a bucket is numbered on its own and
    starts where the buckets before it end. df is read twice, so it should be a saved table. `order` should tell
    rows apart; rows alike in it are interchangeable.
    """
    rows, tasks = df.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # buckets are no larger than an even share of the tasks, so that one key's rows do not make some tasks longer
    n = max(1, math.ceil(rows / bucket_rows), min(4 * tasks, rows // 200))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    by = [*keys, "_bucket"]
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select(*by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = dealt.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    same = [local[k].eqNullSafe(starts[k]) for k in by]
    out = local.join(starts, same, "inner")
    return out.select(*[local[c] for c in df.columns], (F.col("_start") + F.col("_at")).cast("long").alias(name))


def running_sums(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """df with the running sum of `value` (a long) over the rows of each key in an order, a row's own value included.

    Rows are dealt by ranges of keys and order, added up in each range, and a range starts where those of its key before it
    end: no key comes to one task. Rows alike in order may stand in any order, but in the same one for all. Null
    is a key like others; nulls in `order` come first.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.withColumn("_value", value.cast("long")).repartitionByRange(tasks, *keys, *order)
    dealt = saved(ranges.withColumn("_range", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id()), "ranges")
    by = ["_range", *keys]
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*by).agg(F.sum("_value").alias("_sum")).select(*by, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    local = dealt.withColumn("_upto", F.sum("_value").over(Window.partitionBy(*by).orderBy(*order, "_nth").rowsBetween(Window.unboundedPreceding, 0)))
    out = local.join(starts, [local[k].eqNullSafe(starts[k]) for k in by])
    return out.select(*[local[c] for c in df.columns], (F.col("_start") + local["_upto"]).cast("long").alias(name))
