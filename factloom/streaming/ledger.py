"""Ledgers and queues kept by a stream, batch by batch, in tables with committed generations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.sources.generations import Generations
from factloom.sources.tables import new_folder


def _as_glob(path: str) -> str:
    """A pattern that only this path matches: a stream reads folders or patterns, and the path may be a single file."""
    return path[:-1] + "[" + path[-1] + "]"


def files(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet files of a path as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(_as_glob(path))


def run_trigger(stream: DataFrame, each: Callable[[DataFrame, int], None], state: str) -> None:
    """One trigger: what has come since the last one with the same state folder, through each(batch, number)."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


class EvidenceLedger:
    """The evidence ledger, merged batch by batch; a batch is one or more snapshots of some parts.

    A snapshot is a whole listing of a part at a time. A fact is in the ledger from the first snapshot in which it was
    tracked; it is refreshed by every later snapshot in which it is present, tracked or not, and gone from the first
    snapshot of its part without it, until it comes back. A part that a batch has no snapshot of (unread) is kept as it
    is, neither refreshed nor gone.

    Live facts lie in buckets of parts, and a batch rewrites the buckets of its parts only; facts that go are appended to
    a table of their own and not read again by later batches. So the work of a batch is that of its snapshots and of what
    was live in their parts, whatever the length of the history. A fact that came back has a row there for each time it went:
    `current` takes the first sighting of all and the state of the live row. Facts that were present but never tracked are kept
    in the same way, without a first sighting, and are not shown.

    Every batch is one generation, so that a batch that runs again does nothing.
    """

    def __init__(self, spark: SparkSession, base: str, keys: dict[str, str], at: str = "timestamp", buckets: int = 32):
        """keys: names and types of the columns that tell the facts of a part apart; at: type of the snapshots' times."""
        self.store, self.keys, self.buckets = Generations(spark, base), list(keys), buckets
        named = ", ".join(f"{k} {t}" for k, t in keys.items())
        self.live_schema = f"part string, {named}, first_seen {at}, last_seen {at}, times_seen long"
        self.gone_schema = f"{self.live_schema}, gone_since {at}"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("part"), F.lit(self.buckets)).cast("int")

    def merge(self, sightings: DataFrame, snapshots: DataFrame, number: int) -> bool:
        """Merge sightings(part, keys, at, tracked) of snapshots(part, at); False if batch `number` (from 1) was merged
        before. Snapshots need not hold a sighting; sightings of parts or times without a snapshot do not count."""
        store, by = self.store, ["part", *self.keys]
        if number <= store.number():
            return False
        taken = snapshots.select("part", "at").distinct()
        touched = sorted(r[0] for r in taken.select(self._bucket().alias("b")).distinct().collect())  # a row a bucket
        order = Window.partitionBy("part").orderBy("at")
        steps = taken.select(F.col("part").alias("_part"), F.col("at").alias("_at"), F.lead("at").over(order).alias("_next"))
        ends = taken.groupBy(F.col("part").alias("_p")).agg(F.min("at").alias("_first"))
        seen = sightings.join(taken, ["part", "at"], "left_semi").groupBy(*by).agg(F.min(F.when(F.col("tracked"), F.col("at"))).alias("_tracked"), F.max("at").alias("_last"), F.count_distinct("at").alias("_n"))
        live = store.read("live", self.live_schema, buckets=touched)
        both = live.join(seen, by, "full_outer").join(ends, F.col("part") == F.col("_p"), "left")
        both = both.join(steps, (F.col("part") == F.col("_part")) & (F.col("_last") == F.col("_at")), "left")
        # not in this batch: gone from its first snapshot; in it: from the snapshot after the last sighting, if there is one
        gone = F.when(F.col("_p").isNull(), F.lit(None)).when(F.col("_last").isNull(), F.col("_first")).otherwise(F.col("_next"))
        merged = both.select(
            *by,
            F.coalesce("first_seen", "_tracked").alias("first_seen"),
            F.coalesce("_last", "last_seen").alias("last_seen"),
            (F.coalesce("times_seen", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("long").alias("times_seen"),
            gone.alias("gone_since"),
        ).persist()
        try:
            stays = merged.filter("gone_since IS NULL").drop("gone_since").withColumn("bucket", self._bucket())
            return store.commit(number, merge={"live": (stays, touched)}, append={"gone": merged.filter("gone_since IS NOT NULL")})
        finally:
            merged.unpersist()

    def current(self) -> DataFrame:
        """part, keys, first_seen, last_seen, times_seen, gone_since as of the newest batch."""
        at = self.store.number()
        live = self.store.read("live", self.live_schema, at).withColumn("gone_since", F.lit(None).cast(self.gone_schema.rpartition(" ")[2]))
        rows = live.withColumn("_live", F.lit(True)).unionByName(self.store.read("gone", self.gone_schema, at).withColumn("_live", F.lit(False)))
        found = rows.groupBy("part", *self.keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("times_seen").alias("times_seen"), F.when(~F.bool_or("_live"), F.max("gone_since")).alias("gone_since"))
        return found.filter("first_seen IS NOT NULL")


def ledger_stream(spark: SparkSession, path: str) -> DataFrame:
    """The evidence ledger (user_id, event_type, first_seen, last_seen, times_seen, gone_since) of the events of a path,
    read as a stream; a day is a snapshot of all facts."""
    base = new_folder(spark, "ledger")
    ledger = EvidenceLedger(spark, f"{base}/ledger", {"user_id": spark.read.parquet(path).schema["user_id"].dataType.simpleString(), "event_type": "string"}, "date")

    def keep(batch: DataFrame, number: int) -> None:
        facts = batch.select(F.lit("all").alias("part"), "user_id", "event_type", F.to_date("ts").alias("at"), F.lit(True).alias("tracked")).distinct()
        ledger.merge(facts, facts.select("part", "at"), number + 1)

    run_trigger(files(spark, path), keep, f"{base}/state")
    return ledger.current().drop("part")


def ledger_in_triggers(spark: SparkSession, landed: list[DataFrame], base: str, part: str, key: str, tracked: Column) -> EvidenceLedger:
    """Tables (part, key, ts, ...) that land one after the other in the folder of a stream, one trigger each; the days of a
    part are its snapshots. The last batch is merged twice, as after a failure: the second time does nothing."""
    kinds = landed[0].schema
    ledger = EvidenceLedger(spark, f"{base}/ledger", {key: kinds[key].dataType.simpleString()}, "date")

    def keep(batch: DataFrame, number: int) -> None:
        facts = batch.select(F.col(part).alias("part"), key, F.to_date("ts").alias("at"), tracked.alias("tracked"))
        snapshots = facts.select("part", "at")
        ledger.merge(facts, snapshots, number + 1)
        if number + 1 == len(landed):
            ledger.merge(facts, snapshots, number + 1)

    for n, df in enumerate(landed):
        df.write.mode("overwrite").parquet(f"{base}/feed/trigger={n}")
        run_trigger(spark.readStream.schema(kinds).parquet(f"{base}/feed/trigger=*"), keep, f"{base}/state")
    return ledger


def deduplicated(spark: SparkSession, path: str, watermark: str = "365 days") -> DataFrame:
    """Events read as a stream, each id once within the watermark, counted by (user, kind): first and last day, n.

    Each micro-batch appends its own sums to a table in the shared folder, in a folder of its own, so that a batch
    that runs again replaces what it wrote. What comes back reads the sums of all batches.
    """
    base = new_folder(spark, "stream")
    events = files(spark, path).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", watermark).dropDuplicatesWithinWatermark(["event_id"])

    def keep(batch: DataFrame, number: int) -> None:
        day = F.to_date("at")
        sums = batch.groupBy("user_id", "event_type").agg(F.min(day).alias("first_seen"), F.max(day).alias("last_seen"), F.count(F.lit(1)).alias("n"))
        sums.write.mode("overwrite").parquet(f"{base}/sums/batch={number}")

    run_trigger(events, keep, f"{base}/state")
    sums = spark.read.parquet(f"{base}/sums")
    return sums.groupBy("user_id", "event_type").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("n").alias("n"))
