"""Committed generations, and ledgers merged batch by batch against the step-by-step merge."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import merge
from factloom.sources.generations import Generations
from factloom.streaming import ledger


def ints(df):
    return sorted(r[0] for r in df.collect())


def test_readers_stay_on_the_last_whole_generation(spark, tmp_path):
    store = Generations(spark, f"{tmp_path}/store")
    one = spark.createDataFrame([(1,)], "x int")
    assert store.number() == 0 and ints(store.read("facts", "x int")) == []
    assert store.commit(1, replace={"sources": one, "facts": one}, derived=["facts"])
    broken = one.select(F.raise_error(F.lit("no disk")).cast("int").alias("x"))
    with pytest.raises(Exception, match="no disk"):  # the sources are written, the derived facts fail
        store.commit(2, replace={"sources": one.select((F.col("x") + 1).alias("x")), "facts": broken}, derived=["facts"])
    assert store.number() == 1 and ints(store.read("sources", "x int")) == ints(store.read("facts", "x int")) == [1]
    two = spark.createDataFrame([(2,)], "x int")
    assert store.commit(2, replace={"sources": two, "facts": two}, derived=["facts"])  # the same generation, written again
    assert ints(store.read("sources", "x int")) == ints(store.read("facts", "x int")) == [2]
    assert ints(store.read("facts", "x int", generation=1)) == [1]  # old readers see what they saw
    assert not store.commit(2, replace={"facts": one}) and ints(Generations(spark, f"{tmp_path}/store").read("facts", "x int")) == [2]


def test_tables_of_two_generations_are_told(spark, tmp_path):
    store = Generations(spark, f"{tmp_path}/store")
    one = spark.createDataFrame([(1,)], "x int")
    store.commit(1, replace={"sources": one, "facts": one}, derived=["facts"])
    store.check_derived("facts", ["sources"])
    store.commit(2, replace={"sources": one})
    with pytest.raises(ValueError, match="generation 2"):
        store.check_derived("facts", ["sources"])
    store.commit(3, replace={"facts": one}, derived=["facts"])
    store.check_derived("facts", ["sources"])


def test_appended_and_bucketed_tables(spark, tmp_path):
    store = Generations(spark, f"{tmp_path}/store")
    rows = lambda *xs: spark.createDataFrame([(x, x % 3) for x in xs], "x int, bucket int")
    store.commit(1, merge={"t": (rows(1, 2, 3, 4), [0, 1, 2])}, append={"log": rows(1).select("x")})
    store.commit(2, merge={"t": (rows(10, 13), [1])}, append={"log": rows(2).select("x")})
    assert ints(store.read("t", "x int")) == [2, 3, 10, 13] and ints(store.read("log", "x int")) == [1, 2]
    assert ints(store.read("t", "x int", buckets=[1])) == [10, 13] and ints(store.read("t", "x int", generation=1)) == [1, 2, 3, 4]
    store.commit(3, merge={"t": (rows().limit(0), [1, 2])})
    assert ints(store.read("t", "x int")) == [3]


def steps(spark, snapshots):
    """merge_with_hold for each time in turn: {part: {at: (tracked, present)}} -> rows."""
    held = spark.createDataFrame([], "part string, k string, first_seen int, last_seen int, gone_since int")
    parts = sorted({p for p, _ in snapshots})
    frame = lambda rows: spark.createDataFrame(rows, "part string, k string")
    for at in sorted({a for _, a in snapshots}):
        unread = spark.createDataFrame([(p,) for p in parts if (p, at) not in snapshots], "part string")
        tracked = frame([(p, k) for p in parts for k in snapshots.get((p, at), ((), ()))[0]])
        present = frame([(p, k) for p in parts for k in snapshots.get((p, at), ((), ()))[1]])
        held = merge.merge_with_hold(held, tracked, present, ["part", "k"], F.lit(at), unread, "part")
        held = spark.createDataFrame(held.collect(), held.schema)
    return sorted(tuple(r) for r in held.collect())


def test_ledger_equals_its_steps_after_every_batch(spark, tmp_path):
    rng = random.Random(1)
    snapshots = {}
    for at in range(1, 10):
        for part in "abc":
            if rng.random() < 0.75:  # else unread at that time
                tracked = [k for k in "uvwxyz" if rng.random() < 0.4]
                snapshots[part, at] = (tracked, sorted({*tracked, *(k for k in "uvwxyz" if rng.random() < 0.2)}))
    snapshots["c", 5] = ([], [])  # a snapshot without a fact
    kept = ledger.EvidenceLedger(spark, f"{tmp_path}/ledger", {"k": "string"}, "int", buckets=2)
    for number, times in enumerate(([1, 2, 3], [4], [5, 6], [7, 8, 9]), 1):
        batch = {p: v for p, v in snapshots.items() if p[1] in times}
        facts = spark.createDataFrame([(p, k, at, k in tracked) for (p, at), (tracked, present) in batch.items() for k in present], "part string, k string, at int, tracked boolean")
        taken = spark.createDataFrame(list(batch), "part string, at int")
        assert kept.merge(facts, taken, number) and not kept.merge(facts, taken, number)
        found = sorted((r.part, r.k, r.first_seen, r.last_seen, r.gone_since) for r in kept.current().collect())
        assert repr(found) == repr(steps(spark, {p: v for p, v in snapshots.items() if p[1] <= times[-1]}))


def test_a_batch_leaves_the_buckets_of_other_parts_alone(spark, tmp_path):
    kept = ledger.EvidenceLedger(spark, f"{tmp_path}/ledger", {"k": "int"}, "int", buckets=64)
    rows = lambda parts, at: spark.createDataFrame([(p, k, at, True) for p in parts for k in range(5)], "part string, k int, at int, tracked boolean")
    every = [f"p{i}" for i in range(20)]
    kept.merge(rows(every, 1), rows(every, 1), 1)
    before = {r["bucket"]: r["folder"] for r in kept.store.manifest() if r["name"] == "live"}
    kept.merge(rows(["p3"], 2), rows(["p3"], 2), 2)
    after = {r["bucket"]: r["folder"] for r in kept.store.manifest() if r["name"] == "live"}
    assert sum(before[b] != after[b] for b in before) == 1 and kept.current().filter("last_seen = 2").count() == 5
