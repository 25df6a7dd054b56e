"""Change history: diffs of snapshots, and merging candidates into what is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_id(*parts: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, digits)


def snapshot_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """snapshot_fact(section, entity, cell, value) of two runs -> rows with was and value, and what happened: added,
    removed, changed. NULL is a value: unknown to known is a change, two unknowns are none."""
    keys = ["section", "entity", "cell"]
    a = before.select(*keys, F.col("value").alias("was"), F.lit(True).alias("_a"))
    b = now.select(*keys, "value", F.lit(True).alias("_b"))
    both = a.join(b, keys, "full_outer")
    what = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("value")), "changed")
    return both.withColumn("what", what).filter("what IS NOT NULL").drop("_a", "_b")


def diff_allowed(before: DataFrame, now: DataFrame) -> bool:
    """Diffs only between snapshots that the same version of the rules made: one value each."""
    a, b = (df.agg(F.min("rules_version"), F.max("rules_version")).first() for df in (before, now))
    return a[0] is not None and a[0] == a[1] == b[0] == b[1]


def merge_history(history: DataFrame, candidates: DataFrame, retracted: DataFrame, dropped: DataFrame, now: Column, last_run: Column | None, rebuild: bool) -> DataFrame:
    """history and candidates(id, kind, source_at, title, refresh_only, diff_only), merged by id. Of candidates with one
    id the first counts: by `position`, if they have that column, then by kind, time and title.

    history(id, kind, source_at, detected_at, basis, title, diff_only, inputs_read, rules_outdated). A known id keeps
    detection and basis, and its title unless this is a rebuild or it was outdated. New ones are observed if their
    source time is not older than six hours before the last run, or missing, else backfill; those that only repair
    are never added; an id in the dropped ledger gets its first detection back. On a rebuild a backfill row that
    was not generated again goes if its inputs were read, and is outdated otherwise. Retracted ids never come back.
    """
    first = F.min_by(F.struct("kind", "source_at", "title", "refresh_only", "diff_only"), F.struct(*([F.col("position")] if "position" in candidates.columns else []), "kind", "source_at", "title"))
    c = candidates.join(retracted, "id", "left_anti").groupBy("id").agg(first.alias("c")).select("id", "c.*")
    h = history.join(retracted, "id", "left_anti")
    fresh = c.select("id", F.col("kind").alias("_kind"), F.col("source_at").alias("_source"), F.col("title").alias("_title"), F.col("refresh_only").alias("_refresh"), F.col("diff_only").alias("_diff"))
    ledger = dropped.select("id", F.col("detected_at").alias("_detected"), F.col("basis").alias("_basis"))
    both = h.withColumn("_known", F.lit(True)).join(fresh, "id", "full_outer").join(ledger, "id", "left")
    known, again = F.coalesce(F.col("_known"), F.lit(False)), F.col("_kind").isNotNull()
    gone = known & ~again & F.lit(rebuild) & (F.col("basis") == "backfill") & ~F.col("diff_only") & F.col("inputs_read")
    both = both.filter((known & ~gone) | (~known & ~F.coalesce(F.col("_refresh"), F.lit(False))))
    renewed = again & (F.lit(rebuild) | F.coalesce(F.col("rules_outdated"), F.lit(False)))
    recent = F.lit(True) if last_run is None else F.col("_source").isNull() | (F.col("_source") >= last_run - F.expr("INTERVAL 6 HOURS"))
    basis = F.lit("backfill") if last_run is None else F.when(recent, "observed").otherwise("backfill")
    return both.select(
        "id",
        F.coalesce("kind", "_kind").alias("kind"),
        F.coalesce("source_at", "_source").alias("source_at"),
        F.when(known, F.col("detected_at")).otherwise(F.coalesce("_detected", now)).alias("detected_at"),
        F.when(known, F.col("basis")).otherwise(F.coalesce("_basis", basis)).alias("basis"),
        F.when(~known | renewed, F.col("_title")).otherwise(F.col("title")).alias("title"),
        F.coalesce("diff_only", "_diff").alias("diff_only"),
        F.when(renewed | ~known, False).when(F.lit(rebuild) & ~F.col("diff_only"), True).otherwise(F.col("rules_outdated")).alias("rules_outdated"),
    )


def bounded(events: DataFrame, now: Column, days: int, most: int) -> DataFrame:
    """What is kept: inside the window, undated rows too, the newest `most` by source or detection time and id."""
    inside = events.filter(F.col("source_at").isNull() | (F.col("source_at") >= now - F.make_dt_interval(days=F.lit(days))))
    return inside.orderBy(F.coalesce("source_at", "detected_at").desc(), "id").limit(most)
