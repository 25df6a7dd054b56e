"""Incremental reads, queues between triggers, values that expire; each against plain Python or its batch twin."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import scan
from factloom.streaming import incremental, ledger

DAY = dt.datetime(2024, 1, 1)


def day(n, hour=0):
    return DAY + dt.timedelta(days=n, hours=hour)


def test_reads_overlap_and_truncated_ones_lower_nothing(spark, tmp_path):
    kept = incremental.IncrementalSet(spark, f"{tmp_path}/set")
    history = [("a", f"k{i}", day(i)) for i in range(20)] + [("b", "x", day(1))]
    frame = lambda rows: spark.createDataFrame(rows, "source string, key string, at timestamp")
    read = kept.due(frame(history), 100)
    assert kept.merge(read, 1) and not kept.merge(read, 1)
    state = lambda: {r.source: (r.high_water, r.n, r.full_next) for r in kept.marks().collect()}
    assert state() == {"a": (day(19), 20, False), "b": (day(1), 1, False)}
    history += [("a", f"k{i}", day(i)) for i in range(20, 25)] + [("a", "late", day(17))]
    due = {r.key for r in kept.due(frame(history), 100).filter("source = 'a'").collect()}
    assert due == {"late", *(f"k{i}" for i in range(16, 25))}  # three days before the mark, and no more
    assert kept.merge(kept.due(frame(history), 4), 2)  # stops at four rows a source
    assert state()["a"] == (day(24), 24, True) and state()["b"] == (day(1), 1, False)
    due = kept.due(frame(history), 100)
    assert due.filter("source = 'a'").count() == 26  # a full one
    assert kept.merge(due, 3) and state()["a"] == (day(24), 26, False)
    assert sorted(r.key for r in kept.known().filter("source = 'a'").collect()) == sorted({k for s, k, _ in history if s == "a"})


def test_a_truncated_read_never_lowers_a_count(spark, tmp_path):
    kept = incremental.IncrementalSet(spark, f"{tmp_path}/set")
    old = spark.createDataFrame([("a", day(9), 50, 0, True)], kept.MARKS)  # a count whose keys were not kept
    kept.store.commit(1, replace={"marks": old})
    history = spark.createDataFrame([("a", f"k{i}", day(i)) for i in range(30)], "source string, key string, at timestamp")
    kept.merge(kept.due(history, 10), 2)
    assert [tuple(r)[2:] for r in kept.marks().collect()] == [(50, 10, True)]
    kept.merge(kept.due(history, 100), 3)
    assert [tuple(r)[2:] for r in kept.marks().collect()] == [(30, 30, False)]


def test_nothing_starves_over_ten_triggers(spark, tmp_path):
    queue = incremental.RevalidationQueue(spark, f"{tmp_path}/queue", "int", {"posts": "int"}, 24)
    rng, reads = random.Random(1), []
    posts = {i: 0 for i in range(60)}
    for n in range(1, 11):
        for i in rng.sample(range(60), 3):
            posts[i] += 1
        shown = {i: p for i, p in posts.items() if i % 20 or n < 3}  # some leave the listing
        listing = spark.createDataFrame(list(shown.items()), "id int, posts int")
        assert queue.trigger(listing, F.lit(day(n)), n, 12, 8) and not queue.trigger(listing, F.lit(day(n)), n, 12, 8)
        now = queue.topics().filter("deferred > 0").agg(F.max("deferred"), F.count(F.lit(1))).first()
        taken = queue.reads().filter(F.col("at") == F.lit(day(n))).collect()
        assert len(taken) <= 12 and sum(r.kind == "due" for r in taken) <= 8
        reads += [(r.id, r.kind, n) for r in taken]
        assert (now[0] or 0) <= 6
    assert {i for i, _, _ in reads} == set(range(60)) - {40}  # gone from the listing before its turn
    assert {i for i, k, _ in reads if k == "due"} >= {0, 20}  # those that left the listing are read again too
    firsts = [min(n for i, _, n in reads if i == j) for j in range(60) if j != 40]
    assert max(firsts) <= 6


READS = "key string, at timestamp, position long, state string, value double"


def answers(rows, start, ttl=30):
    """The rules, read by read."""
    held = {k: [v, read, missing] for k, v, read, missing in start}
    out = []
    for key, at, position, state, value in sorted(rows):
        good = held.get(key)
        if state == "read":
            held[key] = [value, at, None]
            out.append((key, at, position, "read", value, at, None))
            continue
        if good and good[1] is None and good[2] is None:
            good[2] = at
        if good and at - (good[1] or good[2]) <= dt.timedelta(days=ttl):
            good[2] = good[2] or at
            out.append((key, at, position, "carried", *good))
        else:
            held.pop(key, None)
            out.append((key, at, position, state, None, None, None))
    return out


def some_reads(seed, keys, n):
    rng = random.Random(seed)
    return [(rng.choice(keys), day(rng.randrange(200)), i, rng.choice(["read", "unreadable", "unreadable", "not-published"]), float(i)) for i in range(n)]


def test_carried_values_follow_the_rules(spark):
    start = [("a", 7.0, day(-5), None), ("b", 8.0, None, None), ("c", 9.0, None, day(-3)), ("d", 1.0, day(-400), None)]
    rows = [r for r in some_reads(2, ["a", "b", "c", "d", "e"], 60)] + [("hot", day(i % 90), i, "read" if i % 41 == 0 else "unreadable", float(i)) for i in range(60, 400)]
    found = incremental.carried_values(spark.createDataFrame(rows, READS), spark.createDataFrame(start, "key string, value double, read_at timestamp, missing_since timestamp"), 30)
    assert repr(sorted(tuple(r) for r in found.collect())) == repr(sorted(answers(rows, start)))


def test_timers_equal_the_batch_twin(spark, tmp_path):
    rows = some_reads(3, ["a", "b", "c", "d"], 80) + [("end", day(300), 500, "read", 1.0)]
    kinds, base = "key string, at timestamp, position long, state string, value double", str(tmp_path)
    out = []
    for n, (low, high) in enumerate(((0, 60), (60, 130), (130, 400))):
        part = [r for r in rows if day(low) <= r[1] < day(high)]
        spark.createDataFrame(part, kinds).coalesce(1).write.parquet(f"{base}/feed/t={n}")
        stream = incremental.expiring_stream(spark.readStream.schema(kinds).parquet(f"{base}/feed/t=*"), 30)
        ledger.run_trigger(stream, lambda batch, number: out.extend(tuple(r) for r in batch.collect()), f"{base}/state")
    twin = incremental.carried_values(spark.createDataFrame(rows, kinds), spark.createDataFrame([], "key string, value double, read_at timestamp, missing_since timestamp"), 30)
    assert repr(sorted(r for r in out if r[3] != "expired")) == repr(sorted(tuple(r) for r in twin.collect()))
    over = [(k, at) for k, at, _, answer, *_ in out if answer == "expired"]
    reads = sorted((k, at) for k, at, _, state, _ in rows if state == "read")
    nxt = {x: y for x, y in zip(reads, reads[1:], strict=False)}
    due = {(k, at + dt.timedelta(days=30)) for k, at in reads if k != "end" and not (nxt[k, at][0] == k and nxt[k, at][1] <= at + dt.timedelta(days=30))}
    assert len(over) == len(set(over)) and set(over) == due


def streamed(spark, base, parts):
    """Answers of a stream of 30 days in a trigger a part, and the rows of its state after the last one."""
    out, states = [], []
    for n, part in enumerate(parts):
        spark.createDataFrame(part, READS).coalesce(1).write.parquet(f"{base}/feed/t={n}")
        stream = incremental.expiring_stream(spark.readStream.schema(READS).parquet(f"{base}/feed/t=*"), 30)
        query = stream.writeStream.foreachBatch(lambda batch, number: out.extend(tuple(r) for r in batch.collect())).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    return out, states


def test_many_keys_are_few_states(spark, tmp_path):
    keys = [*(f"k{i}" for i in range(1500)), None]
    rows = [(k, day(i % 20, n), n, "read" if n % 2 == 0 else "unreadable", float(n)) for i, k in enumerate(keys) for n in range(3)]
    later = [(k, day(25 + i % 20), 9, "not-published", None) for i, k in enumerate(keys[::-3])]
    out, states = streamed(spark, str(tmp_path), [rows, later])
    assert max(states) <= 64
    order = lambda rows: sorted(rows, key=repr)
    want = [r for k in keys for r in answers([r for r in [*rows, *later] if r[0] == k], [])]
    assert order(r for r in out if r[3] != "expired") == order(want)
    over = {k: day(i % 20 + 30, 2) for i, k in enumerate(keys)}
    assert order((r[0], r[1]) for r in out if r[3] == "expired") == order((k, at) for k, at in over.items() if at < day(44))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_a_value_ends_within_a_millisecond(spark, tmp_path, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for n, (gap, over) in enumerate(((dt.timedelta(hours=-2), []), (dt.timedelta(0), []), (dt.timedelta(milliseconds=1), [("a", day(30))]))):
            out, _ = streamed(spark, f"{tmp_path}/{n}", [[("a", day(0), 1, "read", 1.0)], [("b", day(30) + gap, 2, "read", 2.0)]])
            assert [(r[0], r[1]) for r in out if r[3] == "expired"] == over
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("before", [False, True])
def test_one_hot_key_runs_in_many_ranges(spark, before):
    rows = [("k" if i % 10 else None, i, i if i % 7 == 0 else None) for i in range(3000)]
    table = spark.createDataFrame(rows, "k string, i int, v int")
    last, want, total = {}, {}, {}
    for k, i, v in rows:
        if before:
            want[i] = last.get(k)
        last[k] = v if v is not None else last.get(k)
        total[i] = total.get((k,), 0) + (v or 0)
        total[k,] = total[i]
        if not before:
            want[i] = last.get(k)
    found = scan.running_last(table, ["k"], [F.col("i")], F.col("v"), "x", before)
    assert {r.i: r.x for r in found.collect()} == want
    if not before:
        assert {r.i: r.s for r in scan.running_sum(table, ["k"], [F.col("i")], F.col("v"), "s").collect()} == {i: t for i, t in total.items() if not isinstance(i, tuple)}
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if the ranges were large
        ranges = scan._dealt(table, ["k"], [F.col("i")])
        assert ranges.filter("k = 'k'").select("_range").distinct().count() == 4
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
