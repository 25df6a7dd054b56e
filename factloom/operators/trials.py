"""Trials: which builds a study's filter lets in, and what its cohorts set; NULL is unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from factloom.functions.kleene import kleene_all
from factloom.functions.versions import in_version_range, version_key
from factloom.sources.tables import broadcast_if_small, paired

#: The keys of a filter that are understood.
KNOWN_KEYS = ["platform", "channel", "min_version", "max_version", "start", "end", "country", "locale"]


def as_list(text: Column) -> Column:
    """A JSON list of strings, or a scalar as a list of one; NULL stays NULL."""
    return F.when(text.rlike(r"\A\s*\["), F.from_json(text, "array<string>")).when(text.isNotNull(), F.array(F.replace(F.trim(text), F.lit('"'), F.lit(""))))


def date_value(text: Column) -> Column:
    """Seconds since 1970 or an ISO time, as a timestamp; NULL if it is neither."""
    seconds = F.when(text.rlike(r"\A[0-9]{1,11}\z"), F.timestamp_seconds(text.cast("long")))
    return F.coalesce(seconds, F.try_to_timestamp(text))


def clauses(studies: DataFrame) -> DataFrame:
    """study, clause (key of the filter), value (JSON text) of studies(study, filter: map of key to JSON text)."""
    return studies.select("study", F.explode("filter").alias("clause", "value"))


def applicability(studies: DataFrame, builds: DataFrame, now: Column) -> DataFrame:
    """study, build_id, clause, met: each clause of each filter against builds(build_id, platform, channel, version), three-
    valued. Keys that are not understood, and values that depend on the user, are unknown."""
    rows = paired(clauses(studies), builds)
    c, v = F.col("clause"), F.col("value")
    scalar, when = F.replace(v, F.lit('"'), F.lit("")), date_value(F.replace(v, F.lit('"'), F.lit("")))
    among = lambda column: F.when(F.col(column).isNotNull(), F.array_contains(F.transform(as_list(v), lambda x: F.lower(x)), F.lower(F.col(column))))
    met = (
        F.when(c == "platform", among("platform"))
        .when(c == "channel", among("channel"))
        .when(c == "min_version", in_version_range(F.col("version"), scalar, F.lit(None).cast("string")))
        .when(c == "max_version", in_version_range(F.col("version"), F.lit(None).cast("string"), scalar))
        .when(c == "start", when <= now)
        .when(c == "end", when >= now)
    )
    return rows.select("study", "build_id", "clause", met.alias("met"))


def study_verdicts(judged: DataFrame) -> DataFrame:
    """study, build_id, applies (all clauses, three-valued), deciding (the clauses that exclude, else those unknown)."""
    by = judged.groupBy("study", "build_id").agg(kleene_all(F.col("met")).alias("applies"), F.array_sort(F.collect_set(F.when(~F.col("met"), F.col("clause")))).alias("_no"), F.array_sort(F.collect_set(F.when(F.col("met").isNull(), F.col("clause")))).alias("_open"))
    return by.select("study", "build_id", "applies", F.when(F.col("applies"), F.array().cast("array<string>")).when(F.col("applies").isNull(), F.col("_open")).otherwise(F.col("_no")).alias("deciding"))


def merge_reasons(verdicts: DataFrame, builds: DataFrame) -> DataFrame:
    """study, channel, applies, reasons: verdicts of per-system builds(build_id, channel, platform) put together by outcome,
    each clause with the systems it holds for."""
    met = verdicts.join(broadcast_if_small(builds), "build_id")
    each = met.select("study", "channel", "applies", "platform", F.explode_outer("deciding").alias("clause"))
    by_clause = each.groupBy("study", "channel", "applies", "clause").agg(F.array_join(F.array_sort(F.collect_set("platform")), ", ").alias("systems"))
    return by_clause.groupBy("study", "channel", "applies").agg(F.array_sort(F.collect_list(F.concat_ws(": ", F.coalesce("clause", F.lit("all")), "systems"))).alias("reasons"))


def cohort_settings(cohorts: DataFrame) -> DataFrame:
    """study, setting, value, share, agreement of cohorts(study, cohort, weight, settings: map): share is the weight of the
    cohorts that set this value, in percent of all, two decimals; agreement says whether all enrolled cohorts set it alike
    (common), only some set it (mixed), or cohorts set it differently (conflicting). No weight gives no share."""
    total = cohorts.groupBy("study").agg(F.sum("weight").alias("_total"), F.count_if(F.col("weight") > 0).alias("_cohorts"))
    rows = cohorts.filter("weight > 0").select("study", "cohort", "weight", F.explode("settings").alias("setting", "value")).join(total, "study")
    by = rows.groupBy("study", "setting", "value").agg(F.round(F.sum("weight") * 100 / F.max("_total"), 2).alias("share"), F.count(F.lit(1)).alias("_n"), F.max("_cohorts").alias("_cohorts"))
    w = Window.partitionBy("study", "setting")
    agreement = F.when(F.count(F.lit(1)).over(w) > 1, "conflicting").when(F.sum("_n").over(w) < F.col("_cohorts"), "mixed").otherwise("common")
    return by.select("study", "setting", "value", "share", agreement.alias("agreement"))


def trial_builds(pointers: DataFrame, platforms: DataFrame, releases: DataFrame) -> DataFrame:
    """platform, channel, system, version, engine: a row a system of pointers(platform, channel, system, version,
    not_published) where one is known ('not published' only where there is nothing else), else the build of
    platforms(platform, channel, version), else the newest of releases(channel, version, engine). The engine comes from the
    release of that version."""
    read = pointers.filter("version IS NOT NULL OR not_published")
    better = read.filter("NOT not_published").select("platform", "channel").distinct()
    own = read.filter("NOT not_published").unionByName(read.filter("not_published").join(better, ["platform", "channel"], "left_anti")).select("platform", "channel", "system", "version")
    rest = platforms.join(own.select("platform", "channel").distinct(), ["platform", "channel"], "left_anti")
    newest = releases.groupBy("channel").agg(F.max_by("version", version_key(F.col("version"))).alias("_newest"))
    filled = rest.join(newest, "channel", "left").select("platform", "channel", F.lit(None).cast("string").alias("system"), F.coalesce("version", "_newest").alias("version"))
    engines = releases.groupBy("version").agg(F.max("engine").alias("engine"))
    return own.unionByName(filled).join(engines, "version", "left").select("platform", "channel", "system", "version", "engine")


def map_marketing_version(wanted: DataFrame, notes: DataFrame, releases: DataFrame, trusted: list[str]) -> DataFrame:
    """marketing, build: the build that the newest note(marketing, build, author, at) of a trusted author names, if a
    release(version) of it exists."""
    known = notes.filter(F.col("author").isin(trusted)).join(releases.select(F.col("version").alias("build")).distinct(), "build", "left_semi")
    return wanted.join(known, "marketing").groupBy("marketing").agg(F.max_by("build", F.struct("at", "build")).alias("build"))
