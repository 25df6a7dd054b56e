"""Parsing, queues and serving queries on hand-made rows."""

from datetime import datetime

from pyspark.sql import functions as F

from factloom.functions import parse
from factloom.operators import queues
from factloom.plans import serve


def test_names_and_labels(spark):
    names = ["Release v1.97.56 (Chromium 155.0.8059.40)", "nightly  1.99.25", "Dev v1.2.3", "hot fix v1.2.4", None]
    got = [tuple(r[0]) for r in spark.createDataFrame([(n,) for n in names], "n string").select(parse.release_name(F.col("n"))).collect()]
    assert got == [("release", "1.97.56", "155.0.8059.40"), ("nightly", "1.99.25", None), (None, "1.2.3", None), (None, "1.2.4", None), (None, None, None)]
    table = spark.createDataFrame([(["a.apk", "x-win64.zip", "y.DMG"], ["QA Pass-Win64", "QA/Yes", "QA/No", "OS/Android", "OS/macOS", "QA Fail - iOS"], "1.97.x - Beta", "1.97.x")], "a array<string>, l array<string>, m string, b string")
    r = table.select(parse.asset_platforms(F.col("a")).alias("a"), parse.qa_facts(F.col("l")).alias("q"), parse.os_platforms(F.col("l")).alias("o"), parse.milestone_line(F.col("m")).alias("m"), parse.is_release_branch(F.col("b")).alias("b")).first()
    assert r.a == ["android", "macos", "windows"] and r.q.passed == ["Win64"] and r.q.failed == ["iOS"] and r.q.required is False and r.q.blocked is False
    assert r.o == ["android", "desktop"] and tuple(r.m) == ("1.97", "beta") and r.b


def test_notes_and_locks(spark):
    text = "# Notes\n## [1.2.3](u)\n### Web\n - one ([#1](u))\n * two\n## Other\n - not this\n## 1.2.2\n - three"
    got = [(r.line, r.version, r.section, r.entry) for r in parse.note_entries(spark.createDataFrame([("f", text)], "file string, text string")).orderBy("line").collect()]
    assert got == [(4, "1.2.3", "Web", "one ([#1](u))"), (5, "1.2.3", "Web", "two"), (9, "1.2.2", None, "three")]
    lock = '[[package]]\nname = "a"\nversion = "1.0"\nsource = "registry"\ndependencies = [\n "b 2.0",\n "c",\n]\n\n[[package]]\nname = "b"\nversion = "2.0"\n'
    got = [tuple(r) for r in parse.lock_packages(spark.createDataFrame([("r", lock)], "ref string, text string")).orderBy("name").collect()]
    assert got == [("r", "a", "1.0", "registry", ["b", "c"]), ("r", "b", "2.0", None, [])]


def test_queue_and_budget(spark):
    old, now = datetime(2024, 1, 1), datetime(2024, 1, 10)
    before = spark.createDataFrame([(1, "a", old), (2, "a", now), (3, "a", old), (4, None, now)], "k int, v string, retrieved_at timestamp")
    listing = spark.createDataFrame([(1, "a"), (2, "b"), (4, None), (5, "n")], "k int, v string")
    queue = queues.classify_refresh(before, listing, ["k"], ["v"], F.lit(now), 24)
    assert {r.k: r.kind for r in queue.collect()} == {1: "due", 2: "changed", 3: "dropped", 4: "cached", 5: "new"}
    assert {r.k for r in queues.take_budget(queue, ["k"], 1, 1).filter("taken").collect()} == {5, 1}
    kept, removed = queues.retain_newest(listing, spark.createDataFrame([(1,)], "k int"), "k", F.col("k"), 1)
    assert {r.k for r in kept.collect()} == {1, 5} and {r.k for r in removed.collect()} == {2, 4}


def test_search_and_detail(spark):
    index = spark.createDataFrame([(0, "Work", "big Fix", "s", "u", "big fix body"), (1, "Feature", "other", "s", "u", "a big fix"), (2, "Page", None, "s", "u", "big fix"), (3, "Odd", "big fix", "s", "u", "big fix")], "position int, kind string, title string, subtitle string, link string, haystack string")
    assert [(r.position, r.score) for r in serve.ranked_search(index, "Fix #BIG").collect()] == [(1, 5), (0, 20), (3, 90)]
    assert serve.ranked_search(index, " # ").count() == 0
    assert {r.position for r in serve.filtered(index, "fix", kind="Work").collect()} == {0}
    members = spark.createDataFrame([("g", "i1", "lead"), ("h", "i2", "lead")], "group_id string, item_id string, role string")
    events = spark.createDataFrame([("e1", ["i1", "i2"]), ("e2", ["i2"])], "id string, item_ids array<string>")
    got = {(r.part, r.id) for r in serve.item_detail("g", members, events, events.limit(0)).collect()}
    assert got == {("member", "i1"), ("event", "e1")}
