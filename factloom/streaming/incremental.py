"""Incremental reads with a stored high-water mark, revalidation queues between triggers, and values that expire by timers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import queues
from factloom.operators.scan import running_last, running_sum
from factloom.sources.generations import Generations


class IncrementalSet:
    """Keys of histories that are read again and again from a stored high-water mark, with an overlap.

    A read asks for the rows of each source since its mark minus `overlap_days`, newest first and `page_rows` of them at most; what
    is older is not read. Keys are added to the set of the source, each once. A read that stopped at the limit is
    truncated: it is a part of the truth, so the count is never lowered by it, and the next read of that source is a full
    one. `n` is the number of keys after a whole read; `full_next` says that the next read starts from the beginning.

    A read is a generation: marks and new keys are committed together, and a number that was merged before does nothing.
    New keys are appended, so a read writes what it found and never the set it adds to.
    """

    MARKS = "source string, high_water timestamp, n long, size long, full_next boolean"
    KNOWN = "source string, key string, at timestamp"

    def __init__(self, spark: SparkSession, base: str, overlap_days: int = 3):
        self.store, self.overlap = Generations(spark, base), F.make_dt_interval(days=F.lit(overlap_days))

    def marks(self) -> DataFrame:
        return self.store.read("marks", self.MARKS)

    def known(self) -> DataFrame:
        return self.store.read("known", self.KNOWN)

    def due(self, history: DataFrame, page_rows: int) -> DataFrame:
        """The rows of history(source, key, at) that a read brings now, with `truncated` of their source."""
        old = self.marks().select(F.col("source").alias("_source"), "high_water", "full_next")
        since = F.when(~F.col("full_next"), F.col("high_water") - self.overlap)
        rows = history.join(old, F.col("source") == F.col("_source"), "left").filter(since.isNull() | (F.col("at") >= since)).select("source", "key", "at")
        newest = Window.partitionBy("source").orderBy(F.desc("at"), "key")
        # one row beyond the limit tells that there is more; the rank keeps no more rows than that in any task
        few = rows.withColumn("_nth", F.row_number().over(newest)).filter(F.col("_nth") <= page_rows + 1)
        more = few.groupBy("source").agg((F.max("_nth") > page_rows).alias("truncated"))
        return few.filter(F.col("_nth") <= page_rows).join(more, "source").select("source", "key", "at", "truncated")

    def merge(self, read: DataFrame, number: int) -> bool:
        """Merge read(source, key, at, truncated) as read `number` (from 1); False if that was merged before."""
        if number <= self.store.number():
            return False
        read = read.persist()
        try:
            first = read.agg(F.min("at")).first()[0]
            fresh = read.groupBy("source", "key").agg(F.max("at").alias("at"))
            if first is not None:  # a key has one time, so that older ones cannot be among those read
                fresh = fresh.join(self.known().filter(F.col("at") >= F.lit(first)).select("source", "key"), ["source", "key"], "left_anti")
            fresh = fresh.select("source", "key", "at").persist()
            got = read.groupBy("source").agg(F.max("at").alias("_high"), F.bool_or("truncated").alias("_truncated"))
            added = fresh.groupBy("source").agg(F.count(F.lit(1)).alias("_added"))
            both = self.marks().join(got, "source", "full_outer").join(added, "source", "left")
            size = (F.coalesce("size", F.lit(0)) + F.coalesce("_added", F.lit(0))).cast("long")
            unread = F.col("_truncated").isNull()
            marks = both.select(
                "source",
                F.greatest("high_water", "_high").alias("high_water"),
                F.when(unread, F.col("n")).when(F.col("_truncated"), F.greatest("n", size)).otherwise(size).alias("n"),
                size.alias("size"),
                F.coalesce("_truncated", "full_next").alias("full_next"),
            )
            done = self.store.commit(number, replace={"marks": marks}, append={"known": fresh})
            fresh.unpersist()
            return done
        finally:
            read.unpersist()


class RevalidationQueue:
    """What to read again, kept between triggers: what is new or changed first, those that wait longest before others, then
    what was read longest ago; the rest is deferred and counted, and keeps its place.

    topics(id, watched, retrieved_at, waiting_since, deferred): watched and retrieved_at as of the last read (NULL before
    the first); waiting_since: the trigger's time since when it waits as new or changed; deferred: how often in a row it was
    put off. As every trigger takes the longest waiting ones, nothing that is due waits longer than the queue before it takes.
    """

    def __init__(self, spark: SparkSession, base: str, id_type: str, watched: dict[str, str], ttl_hours: int):
        self.store, self.watched, self.ttl = Generations(spark, base), list(watched), ttl_hours
        self.schema = ", ".join([f"id {id_type}", *(f"{k} {t}" for k, t in watched.items()), "retrieved_at timestamp, waiting_since timestamp, deferred int"])
        self.log_schema = f"id {id_type}, kind string, at timestamp"

    def topics(self) -> DataFrame:
        return self.store.read("topics", self.schema)

    def reads(self) -> DataFrame:
        """Every read so far: id, kind (new, changed or due), at."""
        return self.store.read("reads", self.log_schema)

    def trigger(self, listing: DataFrame, now: Column, number: int, cap: int, due_cap: int) -> bool:
        """One trigger over listing(id, watched): at most `cap` reads, of which `due_cap` of what is merely due; False if it
        ran before. What the listing lacks stays, and is due when its time has come."""
        if number <= self.store.number():
            return False
        old, now = self.topics(), now.cast("timestamp")
        seen = old.filter("retrieved_at IS NOT NULL")
        kinds = queues.classify_refresh(seen, listing, ["id"], self.watched, now, self.ttl)
        stale = F.col("retrieved_at") < now - F.make_dt_interval(hours=F.lit(self.ttl))
        kinds = kinds.withColumn("kind", F.when((F.col("kind") == "dropped") & stale, "due").otherwise(F.col("kind"))).drop("retrieved_at")
        was = old.select("id", F.col("retrieved_at"), F.col("waiting_since").alias("_waits"), F.col("deferred").alias("_put_off"), *[F.col(c).alias(f"_{c}") for c in self.watched])
        rows = kinds.join(was, "id", "full_outer").join(listing.select("id", *self.watched, F.lit(True).alias("_listed")), "id", "left")
        rows = rows.withColumn("kind", F.coalesce("kind", F.lit("dropped")))  # never read, and no longer listed
        eager = F.col("kind").isin("new", "changed")
        rows = rows.withColumn("waiting_since", F.when(eager, F.coalesce("_waits", now))).persist()
        try:
            first = rows.filter(eager).orderBy("waiting_since", "id").limit(cap).select("id", "kind").persist()
            rest = max(0, min(due_cap, cap - first.count()))
            due = rows.filter("kind = 'due'").orderBy("retrieved_at", "id").limit(rest).select("id", "kind")
            taken = first.unionByName(due).persist()
            out = rows.join(taken.select("id", F.lit(True).alias("_taken")), "id", "left")
            read = F.col("_taken").isNotNull()
            topics = out.select(
                "id",
                *[F.when(read & F.col("_listed"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in self.watched],
                F.when(read, now).otherwise(F.col("retrieved_at")).alias("retrieved_at"),
                F.when(~read, F.col("waiting_since")).alias("waiting_since"),
                F.when(~read & F.col("kind").isin("new", "changed", "due"), F.coalesce("_put_off", F.lit(0)) + 1).otherwise(0).cast("int").alias("deferred"),
            ).filter("retrieved_at IS NOT NULL OR waiting_since IS NOT NULL")
            done = self.store.commit(number, replace={"topics": topics}, append={"reads": taken.withColumn("at", now)})
            taken.unpersist()
            first.unpersist()
            return done
        finally:
            rows.unpersist()


#: What a read of a value can say.
READ, UNREADABLE, NOT_PUBLISHED = "read", "unreadable", "not-published"
#: Answers beside those: an earlier value stands in, or its time is over.
CARRIED, EXPIRED = "carried", "expired"


def carried_values(reads: DataFrame, last_good: DataFrame, ttl_days: int) -> DataFrame:
    """key, at, answer, value, read_at, missing_since for each of reads(key, at, position, state, value), one state a row:
    read, unreadable or not-published.

    A value that was read is the answer. After it, a read without a value is answered by the last good one, for ttl_days
    after it was read or, where that is unknown, after the first failure; later by what the read says, so that
    not-published is a determinate answer of its own. last_good(key, value, read_at, missing_since) starts each key, a row a key at
    most. Positions tell reads of a key apart at equal times. Hot keys are no burden (see scan).
    """
    order, ok = [F.col("at"), F.col("position")], F.col("state") == READ
    rows = running_sum(reads, ["key"], order, ok.cast("int"), "_epoch")
    rows = running_last(rows, ["key"], order, F.when(ok, F.struct("value", F.col("at").alias("read_at"))), "_good")
    failed = rows.filter(~ok).groupBy(F.col("key").alias("_key"), F.col("_epoch").alias("_of")).agg(F.min("at").alias("_failed"))
    rows = rows.join(failed, F.col("key").eqNullSafe(F.col("_key")) & (F.col("_epoch") == F.col("_of")), "left").drop("_key", "_of")
    start = last_good.select(F.col("key").alias("_key"), F.struct("value", "read_at").alias("_start"), F.col("missing_since").alias("_missing"))
    rows = rows.join(start, F.col("key").eqNullSafe(F.col("_key")), "left")
    initial = F.col("_epoch") == 0
    good = F.when(initial, F.col("_start")).otherwise(F.col("_good"))
    missing = F.when(initial, F.coalesce("_missing", "_failed")).otherwise(F.col("_failed"))
    fresh = F.col("at") <= F.coalesce(good["read_at"], missing) + F.make_dt_interval(days=F.lit(ttl_days))
    carried = ~ok & good.isNotNull() & fresh
    answer = F.when(ok, READ).when(carried, CARRIED).otherwise(F.col("state"))
    holds = ok | carried
    return rows.select("key", "at", "position", answer.alias("answer"), F.when(holds, good["value"]).alias("value"), F.when(holds, good["read_at"]).alias("read_at"), F.when(carried, missing).alias("missing_since"))


ANSWERS = "key string, at timestamp, position long, answer string, value double, read_at timestamp, missing_since timestamp"
#: Of a bucket of keys, key by key: the last good value, when it was read (microseconds), the first failure since (or _NONE).
_STATE = "keys array<string>, value array<double>, read_at array<long>, missing_since array<long>"
_OUT = "key string, at long, position long, answer string, value double, read_at long, missing_since long"
_NONE, _LAST = -(1 << 63), (1 << 63) - 1


def _answers(ttl_days: int):
    import numpy as np
    import pandas as pd

    ttl = ttl_days * 86_400_000_000

    def rows(bucket, frames: Iterator, state):
        """The keys of a bucket at once: held values come first in their key, then its rows in order."""
        keys, values, read, failed = state.get if state.exists else ([], [], [], [])
        held = pd.DataFrame({"key": pd.Series(keys, dtype=object), "us": np.array(read, "int64"), "position": _NONE, "state": READ, "value": np.array(values, "float64"), "failed": np.array(failed, "int64"), "new": False})
        got = [] if state.hasTimedOut else [f[["key", "us", "position", "state", "value"]].assign(failed=_NONE, new=True) for f in frames]
        every = pd.concat([f for f in [held, *got] if len(f)])
        codes = pd.factorize(every["key"], use_na_sentinel=False)[0]
        order = np.lexsort((every["position"], every["us"], every["new"], codes))
        every, code = every.iloc[order], codes[order]
        key, said, value = every["key"].to_numpy(object), every["state"].to_numpy(object), every["value"].to_numpy("float64", na_value=np.nan)
        at, failed, new = (every[c].to_numpy(t) for c, t in (("us", "int64"), ("failed", "int64"), ("new", bool)))
        n, ok = len(at), said == READ
        heads = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        nth = np.searchsorted(heads, np.arange(n), "right") - 1
        last = np.r_[heads[1:], n][nth] - 1  # last row of the key
        good = np.maximum.accumulate(np.where(ok, np.arange(n), -1))  # the row that was read last
        has, good = good >= heads[nth], np.maximum(good, 0)
        after = np.minimum(good + 1, n - 1)
        since = np.where(failed[good] != _NONE, failed[good], np.where((good < last[good]) & ~ok[after], at[after], _NONE))
        carried = ~ok & has & (at <= at[good] + ttl)
        holds = ok | carried
        out = pd.DataFrame({"key": key, "at": at, "position": every["position"].to_numpy("int64"), "answer": np.where(ok, READ, np.where(carried, CARRIED, said)), "value": np.where(holds, value[good], np.nan), "read_at": np.where(holds, at[good], _NONE), "missing_since": np.where(carried, since, _NONE)})[new]
        reads = np.flatnonzero(ok)
        following = np.r_[reads[1:], n]
        newest = following > last[reads]
        due = at[reads] + ttl
        mark = state.getCurrentWatermarkMs()
        over = (at[np.where(newest, last[reads], np.minimum(following, n - 1))] > due) | (newest & (due // 1000 < mark))
        ended = pd.DataFrame({"key": key[reads[over]], "at": due[over], "position": -1, "answer": EXPIRED, "value": np.nan, "read_at": _NONE, "missing_since": _NONE})
        kept = newest & ~over
        if kept.any():
            i = reads[kept]
            state.update((key[i].tolist(), value[i].tolist(), at[i].tolist(), since[i].tolist()))
            state.setTimeoutTimestamp(max(int(due[kept].min() // 1000), mark, 1))
        elif state.exists:
            state.remove()
        found = [f for f in (out, ended) if len(f)]
        if found:
            yield pd.concat(found)

    return rows


def expiring_stream(reads: DataFrame, ttl_days: int, late: str = "0 seconds", buckets: int = 64) -> DataFrame:
    """carried_values of a stream reads(key string, at timestamp, position long, state, value double), kept in Spark's own
    state store, with a row `expired` at the time when a value's time is over: a timer on event time fires once the
    watermark (whole milliseconds) has passed it, or the next row of the key does. After that nothing of the key is kept.

    Keys are dealt to buckets by hash; a bucket has one state, one timer at the first of its ends, and is worked on as a whole,
    as a call a key costs far more than its rows. Take as many buckets as a trigger has some ten thousand rows; they stay as they
    are while the stream goes on. `at` must not be NULL."""
    marked = reads.withWatermark("at", late).withColumn("us", F.unix_micros("at")).withColumn("position", F.coalesce("position", F.lit(_LAST))).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    found = marked.groupBy("bucket").applyInPandasWithState(_answers(ttl_days), _OUT, _STATE, "append", "EventTimeTimeout")
    time = lambda c: F.timestamp_micros(F.when(F.col(c) != _NONE, F.col(c))).alias(c)
    return found.select("key", time("at"), F.when(F.col("position") != _LAST, F.col("position")).alias("position"), "answer", "value", time("read_at"), time("missing_since"))
