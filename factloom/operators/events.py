"""Change events from items and snapshots, and what becomes of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.history import content_id, snapshot_diff

EVENT = ["id", "kind", "key", "source_at", "title", "item_ids", "refresh_only", "diff_only"]
#: Days of source time for which events are made.
WINDOW_DAYS = 365


def event(rows: DataFrame, kind: Column | str, key: Column, source_at: Column, title: Column, item_ids: Column, refresh_only: Column | bool = False, diff_only: bool = False) -> DataFrame:
    """Rows of EVENT; the id is a hash of kind and key, so that an event found again is the same one."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    refresh = F.lit(refresh_only) if isinstance(refresh_only, bool) else refresh_only
    out = rows.select(kind.alias("kind"), key.cast("string").alias("key"), source_at.alias("source_at"), title.alias("title"), item_ids.alias("item_ids"), refresh.alias("refresh_only"), F.lit(diff_only).alias("diff_only"))
    return out.withColumn("id", content_id(F.col("kind"), F.col("key"))).select(*EVENT)


def in_window(events: DataFrame, now: Column, days: int = WINDOW_DAYS) -> DataFrame:
    """Events of the last `days` of source time, and undated ones."""
    return events.filter(F.col("source_at").isNull() | ((F.col("source_at") >= now - F.make_dt_interval(days=F.lit(days))) & (F.col("source_at") <= now)))


def issue_events(issues: DataFrame, timeline: DataFrame) -> DataFrame:
    """item-tracked, issue-closed, issue-reopened, qa-passed and regression-flagged, of issues(id, title, created_at,
    relevance) and timeline(id, type, label, at). What only mentions the subject gives events that repair what is kept and
    are never added (refresh_only)."""
    i = issues.select("id", "title", "created_at", (F.col("relevance") == "mention").alias("quiet"))
    tracked = event(i, "item-tracked", F.col("id"), F.col("created_at"), F.col("title"), F.array("id"), F.col("quiet"))
    t = timeline.join(i, "id")
    passed, flagged = F.col("label").rlike(r"(?i)\AQA\s*Pass"), F.lower("label") == "regression"
    kind = F.when(F.col("type") == "closed", "issue-closed").when(F.col("type") == "reopened", "issue-reopened").when((F.col("type") == "labeled") & passed, "qa-passed").when((F.col("type") == "labeled") & flagged, "regression-flagged")
    rest = event(t.withColumn("kind", kind).filter("kind IS NOT NULL"), F.col("kind"), F.concat_ws("|", "id", F.coalesce("label", F.lit("")), F.date_format("at", "yyyy-MM-dd HH:mm:ss")), F.col("at"), F.col("title"), F.array("id"), F.col("quiet"))
    return tracked.unionByName(rest)


def pull_events(pulls: DataFrame) -> DataFrame:
    """pr-merged, uplift-merged and pr-closed-unmerged of pulls(id, title, state, is_draft, is_uplift, merged_at, closed_at,
    relevance); drafts give none."""
    kind = F.when((F.col("state") == "merged") & F.col("is_uplift"), "uplift-merged").when(F.col("state") == "merged", "pr-merged").when(F.col("state") == "closed", "pr-closed-unmerged")
    rows = pulls.filter(~F.coalesce("is_draft", F.lit(False))).withColumn("kind", kind).filter("kind IS NOT NULL")
    return event(rows, F.col("kind"), F.col("id"), F.coalesce("merged_at", "closed_at"), F.col("title"), F.array("id"), F.col("relevance") == "mention")


def with_release_date(notes: DataFrame, releases: DataFrame) -> DataFrame:
    """notes(version, platform, ..) with the date of the first release(version, published_at); undated ones go."""
    dates = releases.groupBy("version").agg(F.min("published_at").alias("released_at")).filter("released_at IS NOT NULL")
    return notes.join(dates, "version")


def release_events(notes: DataFrame, releases: DataFrame, tracked: DataFrame) -> DataFrame:
    """released: notes(note_id, version, platform, text, refs, topical) that are topical or name something tracked(id), with
    a known release date."""
    named = notes.select("note_id", F.explode("refs").alias("id")).join(tracked.select("id"), "id", "left_semi").select("note_id").distinct().withColumn("_named", F.lit(True))
    dated = with_release_date(notes.join(named, "note_id", "left").filter(F.col("topical") | F.col("_named")), releases)
    return event(dated, "released", F.concat_ws("|", "platform", "version", "note_id"), F.col("released_at"), F.col("text"), F.col("refs"))


#: What a changed fact of each section of a snapshot is called.
DIFF_KINDS = {"build": "in-build", "flag": "flag-changed", "study": "study-added", "pin": "dependency-bumped", "readiness": "dependency-bumped", "height": "upstream-height", "doc": "doc-changed", "cell": "capability-changed", "switch": "capability-changed", "gone": "release-evidence-changed"}


def diff_events(before: DataFrame, now: DataFrame, at: Column) -> DataFrame:
    """Events of what differs between two snapshots(section, entity, cell, value).

    build and readiness: only false to true (unknown to true is no news); flag: known in both and another value, NULL being
    one; study and gone: new; pin, height, doc, cell, switch: another value in both."""
    d = snapshot_diff(before, now)
    s, changed = F.col("section"), F.col("what") == "changed"
    news = (
        F.when(s.isin("build", "readiness"), changed & F.coalesce((F.col("was") == "false") & (F.col("value") == "true"), F.lit(False)))
        .when(s.isin("study", "gone"), F.col("what") == "added")
        .otherwise(changed)
    )
    kind = F.coalesce(*[F.when(s == k, v) for k, v in DIFF_KINDS.items()], F.lit("changed"))
    rows = d.filter(news).withColumn("kind", kind)
    title = F.concat_ws(" ", "entity", "cell", F.concat(F.coalesce("was", F.lit("unknown")), F.lit(" -> "), F.coalesce("value", F.lit("unknown"))))
    return event(rows, F.col("kind"), F.concat_ws("|", "section", "entity", "cell", F.coalesce("value", F.lit(""))), at, title, F.array("entity"), diff_only=True)


def upstream_events(releases: DataFrame, important: DataFrame) -> DataFrame:
    """upstream-release of releases(package, version, published_at, yanked) of important(package), yanked ones left out."""
    rows = releases.filter(~F.coalesce("yanked", F.lit(False))).join(important.select("package"), "package", "left_semi")
    return event(rows, "upstream-release", F.concat_ws("@", "package", "version"), F.col("published_at"), F.concat_ws(" ", "package", "version"), F.array("package"))


def advisory_events(advisories: DataFrame, since: Column) -> DataFrame:
    """advisory of advisories(advisory_id, summary, published_at, updated_at, packages: names): by publication, or, if that
    is before `since`, by its update after it."""
    at = F.when((F.col("published_at") < since) & (F.col("updated_at") >= since), F.col("updated_at")).otherwise(F.col("published_at"))
    return event(advisories, "advisory", F.col("advisory_id"), at, F.col("summary"), F.col("packages"))


def community_events(topics: DataFrame) -> DataFrame:
    """community-report of topics(topic_id, title, created_at, refs)."""
    return event(topics, "community-report", F.col("topic_id"), F.col("created_at"), F.col("title"), F.col("refs"))


def all_events(parts: list[DataFrame], now: Column) -> DataFrame:
    """The union of generated events inside the window, each id once: of several the first list's, which `position` keeps."""
    placed = [in_window(df, now).withColumn("position", F.lit(k)) for k, df in enumerate(parts)]
    every = reduce(DataFrame.unionByName, placed)
    first = F.min_by(F.struct(*[c for c in EVENT if c != "id"], "position"), F.struct("position", "source_at", "title"))
    return every.groupBy("id").agg(first.alias("e")).select("id", "e.*")


def build_snapshot(sections: dict[str, DataFrame]) -> DataFrame:
    """section, entity, cell, value: sections of (entity, cell, value) in long form; values as text, unknown as NULL."""
    parts = [df.select(F.lit(name).alias("section"), F.col("entity").cast("string").alias("entity"), F.col("cell").cast("string").alias("cell"), F.col("value").cast("string").alias("value")) for name, df in sections.items()]
    return reduce(DataFrame.unionByName, parts)


def inputs_read(events: DataFrame, sources_of: DataFrame, status: DataFrame, unread_items: DataFrame) -> DataFrame:
    """events with inputs_read: whether every source that its kind needs, sources_of(kind, source_id), was read in full in
    this run, status(source_id, complete), and none of its items is in unread_items(id)."""
    read = sources_of.join(status, "source_id", "left").groupBy("kind").agg(F.bool_and(F.coalesce("complete", F.lit(False))).alias("_read"))
    touched = events.select("id", F.explode("item_ids").alias("_item")).join(unread_items.select(F.col("id").alias("_item")), "_item", "left_semi").select("id").distinct().withColumn("_unread", F.lit(True))
    joined = events.join(read, "kind", "left").join(touched, "id", "left")
    return joined.withColumn("inputs_read", F.coalesce("_read", F.lit(True)) & F.col("_unread").isNull()).drop("_read", "_unread")


def dropped_ledger(history: DataFrame, kept: DataFrame, ledger: DataFrame, now: Column, days: int = WINDOW_DAYS, most: int = 5_000) -> DataFrame:
    """id, detected_at, basis, source_at of what history had and kept has not any more, together with the ledger's rows that
    did not come back; the first detection counts; inside the window, the newest `most`."""
    gone = history.join(kept.select("id"), "id", "left_anti").select("id", "detected_at", "basis", "source_at")
    still = ledger.join(kept.select("id"), "id", "left_anti").select("id", "detected_at", "basis", "source_at")
    first = gone.unionByName(still).groupBy("id").agg(F.min_by(F.struct("detected_at", "basis", "source_at"), F.struct("detected_at", "basis", "source_at")).alias("f")).select("id", "f.*")
    inside = first.filter(F.col("source_at").isNull() | (F.col("source_at") >= now - F.make_dt_interval(days=F.lit(days))))
    return inside.orderBy(F.desc("detected_at"), "id").limit(most)


def compare_with_now(events: DataFrame, cells: DataFrame) -> DataFrame:
    """events(id, entity, place, state: the new state that was recorded) with now and verdict against cells(entity, place,
    state): same, changed-since, or not-shown."""
    held = cells.select("entity", "place", F.col("state").alias("now"))
    verdict = F.when(F.col("now").isNull(), "not-shown").when(F.col("now") == F.col("state"), "same").otherwise("changed-since")
    return events.join(held, ["entity", "place"], "left").withColumn("verdict", verdict)
