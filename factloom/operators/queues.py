"""What to read again, what to keep, what to drop: refresh queues, budgets and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def classify_refresh(previous: DataFrame, listing: DataFrame, keys: list[str], watched: list[str], now: Column, ttl_hours: int) -> DataFrame:
    """Keys of both with kind: new, changed (a watched column differs, NULLs alike), due (read longer ago than the ttl),
    cached, or dropped. previous has retrieved_at."""
    old = previous.select(*keys, "retrieved_at", *[F.col(c).alias(f"_{c}") for c in watched], F.lit(True).alias("_old"))
    both = listing.select(*keys, *watched, F.lit(True).alias("_new")).join(old, keys, "full_outer")
    differs = F.lit(False)
    for c in watched:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    kind = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "dropped").when(differs, "changed").when(F.col("retrieved_at") < now - F.make_dt_interval(hours=F.lit(ttl_hours)), "due").otherwise("cached")
    return both.select(*keys, kind.alias("kind"), "retrieved_at")


def take_budget(queue: DataFrame, keys: list[str], cap: int, due_cap: int) -> DataFrame:
    """queue(keys, kind, retrieved_at) with taken: new and changed rows up to cap, then the oldest due ones up to
    due_cap. Each kind is topped by a limit, which Spark does without bringing the rest to one task."""
    first = queue.filter(F.col("kind").isin("new", "changed")).orderBy(F.col("kind").desc(), *keys).limit(cap)
    due = queue.filter("kind = 'due'").orderBy(F.col("retrieved_at").asc_nulls_first(), *keys).limit(due_cap)
    taken = first.unionByName(due).select(*keys, F.lit(True).alias("taken"))
    return queue.join(taken, keys, "left").withColumn("taken", F.coalesce("taken", F.lit(False)))


def grow_set(previous: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Incremental reads overlap: each key once, the row known before it if there is one."""
    return previous.unionByName(batch.join(previous.select(*keys), keys, "left_anti").dropDuplicates(keys))


def retain_days(rows: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Dated rows inside the window and all undated ones."""
    return rows.filter(F.col(at).isNull() | (F.col(at) >= now - F.make_dt_interval(days=F.lit(days))))


def retain_newest(rows: DataFrame, wanted: DataFrame, key: str, order: Column, n: int) -> tuple[DataFrame, DataFrame]:
    """Wanted keys and the n newest others; and what is removed."""
    others = rows.join(wanted.select(key), key, "left_anti").orderBy(order.desc(), key).limit(n)
    kept = rows.join(wanted.select(key).unionByName(others.select(key)).distinct(), key, "left_semi")
    return kept, rows.join(kept.select(key), key, "left_anti")


def reuse_immutable(previous: DataFrame, wanted: DataFrame, keys: list[str], signature: str) -> DataFrame:
    """The wanted keys still to be computed: not yet, incompletely, or by other rules."""
    done = previous.filter(F.col("complete") & (F.col("signature") == signature)).select(*keys)
    return wanted.join(done, keys, "left_anti")


def dedupe_hits(hits: DataFrame, keys: list[str], page: str) -> DataFrame:
    """The same hit on several pages: the last page's."""
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(page)))).filter("_n = 1").drop("_n")
