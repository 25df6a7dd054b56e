"""Status rules, caps, history merging and stored sources on hand-made rows."""

from datetime import datetime

from pyspark.sql import functions as F

from factloom.operators import history, status
from factloom.sources import envelopes


def test_stage_takes_the_first_rule_and_unknown_is_not_true(spark):
    names = ["duplicate", "contradictory", "not_planned", "has_note", "in_release", "in_beta", "in_nightly", "merged", "service_only", "open_pr", "issue_closed", "pr_led"]
    cases = [
        ({"duplicate": True, "contradictory": True, "merged": True}, "merged"),
        ({"duplicate": True, "has_note": True}, "duplicate"),
        ({"in_release": None, "in_beta": True}, "in-beta"),
        ({"merged": True, "service_only": True}, "service-change"),
        ({"issue_closed": True, "pr_led": True}, "closed-unmerged"),
        ({"issue_closed": True}, "closed-unverified"),
        ({}, "open"),
    ]
    rows = [(i, *[c.get(n) for n in names]) for i, (c, _) in enumerate(cases)]
    table = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} boolean" for n in names))
    got = {r.i: r.s for r in table.select("i", status.stage().alias("s")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_caps_follow_the_chain(spark):
    cells = spark.createDataFrame([("a", "p", 8), ("b", "p", 3), ("c", "p", 7), ("a", "q", 2), ("c", "q", 5)], "entity string, place string, rank int")
    needs = spark.createDataFrame([("a", "c"), ("c", "b")], "entity string, needed string")
    got = {(r.entity, r.place): (r.rank, r.limited_by) for r in status.cap(cells, needs, 2).collect()}
    assert got == {("a", "p"): (3, "c"), ("b", "p"): (3, None), ("c", "p"): (3, "b"), ("a", "q"): (2, None), ("c", "q"): (5, None)}


HISTORY = "id string, kind string, source_at timestamp, detected_at timestamp, basis string, title string, diff_only boolean, inputs_read boolean, rules_outdated boolean"
CANDIDATE = "id string, kind string, source_at timestamp, title string, refresh_only boolean, diff_only boolean"


def merged(spark, rebuild):
    old, now = datetime(2024, 1, 1), datetime(2024, 2, 1)
    kept = [("known", "k", old, old, "observed", "old", False, True, False), ("lost", "k", old, old, "backfill", "x", False, True, False), ("unread", "k", old, old, "backfill", "x", False, False, False), ("bad", "k", old, old, "observed", "x", False, True, False)]
    found = [("known", "k", old, "new", False, False), ("late", "k", old, "t", False, False), ("fresh", "k", now, "t", False, False), ("repair", "k", now, "t", True, False), ("bad", "k", old, "t", False, False), ("back", "k", old, "t", False, False)]
    dropped = spark.createDataFrame([("back", old, "observed")], "id string, detected_at timestamp, basis string")
    out = history.merge_history(spark.createDataFrame(kept, HISTORY), spark.createDataFrame(found, CANDIDATE), spark.createDataFrame([("bad",)], "id string"), dropped, F.lit(now), F.lit(datetime(2024, 1, 31)), rebuild)
    return {r.id: r for r in out.collect()}


def test_history_keeps_first_detection_and_retractions(spark):
    got = merged(spark, False)
    assert set(got) == {"known", "lost", "unread", "late", "fresh", "back"}
    assert got["known"].title == "old" and got["late"].basis == "backfill" and got["fresh"].basis == "observed"
    assert got["back"].detected_at == datetime(2024, 1, 1) and got["back"].basis == "observed"


def test_a_rebuild_renews_texts_and_drops_only_what_was_read(spark):
    got = merged(spark, True)
    assert set(got) == {"known", "unread", "late", "fresh", "back"}
    assert got["known"].title == "new" and got["known"].detected_at == datetime(2024, 1, 1) and got["unread"].rules_outdated


def test_readers_follow_the_manifest(spark, tmp_path):
    base = f"file://{tmp_path}"
    for run, n, at in (("r1", 1, datetime(2024, 1, 1)), ("r2", 2, datetime(2024, 1, 2))):
        envelopes.write_source(spark.range(n), base, "s", run, 3, False, at, at)
    data, warnings = envelopes.load_sources(spark, base, {"s": 3, "t": 1})
    assert data["s"].count() == 2 and warnings == ["t: never stored"]
    data, _ = envelopes.load_sources(spark, base, {"s": 3}, not_after=datetime(2024, 1, 1))
    assert data["s"].count() == 1
    assert envelopes.load_sources(spark, base, {"s": 4})[0] == {}


def test_counters_reset_with_success(spark):
    runs = spark.createDataFrame([("s", 1, "failed"), ("s", 2, "failed"), ("s", 3, "ok"), ("s", 4, "partial"), ("s", 5, "failed")], "source string, at int, outcome string")
    got = [(r.failures, r.last_success_at, r.last_complete_at) for r in status.status_counters(runs).orderBy("at").collect()]
    assert got == [(1, None, None), (2, None, None), (0, 3, 3), (0, 4, 3), (1, 4, 3)]
