"""Serving queries, with their filters as arguments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The order of kinds in search results.
KIND_ORDER = {"Feature": 0, "Page": 1, "Work": 2, "Release note": 3, "Community": 4}


def terms(query: str) -> list[str]:
    return query.lower().replace("#", " ").split()


def _has_all(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, w: a & F.contains(text, F.lit(w)), words, F.lit(True))


def ranked_search(index: DataFrame, query: str, most: int = 40) -> DataFrame:
    """index(position, kind, title, subtitle, link, haystack): entries with every term; kinds in order, titles with
    all terms first, then by position. No terms find nothing; rows without a text field are not entries."""
    words = terms(query)
    entries = index.dropna(subset=["kind", "title", "subtitle", "link", "haystack"])
    if not words:
        return entries.limit(0).withColumn("score", F.lit(0))
    order = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in KIND_ORDER.items()], F.lit(9))
    score = order * 10 + F.when(_has_all(F.lower("title"), words), 0).otherwise(5)
    return entries.filter(_has_all(F.col("haystack"), words)).withColumn("score", score).orderBy("score", "position").limit(most)


def filtered(rows: DataFrame, text: str = "", haystack: str = "haystack", **facets: str | None) -> DataFrame:
    """Rows with all words of `text` and the given value in each facet (None: any)."""
    out = rows.filter(_has_all(F.col(haystack), terms(text)))
    for column, value in facets.items():
        if value is not None:
            out = out.filter(F.col(column) == value)
    return out


def new_since(events: DataFrame, seen: Column, stale: bool) -> DataFrame:
    """What was detected after the last visit; nothing while the data is stale."""
    return events.limit(0) if stale else events.filter(F.col("detected_at") > seen)


def item_detail(group_id: str, members: DataFrame, events: DataFrame, reports: DataFrame) -> DataFrame:
    """Members, events and reports of one group as rows(part, id, role)."""
    own = members.filter(F.col("group_id") == group_id)
    parts = [own.select(F.lit("member").alias("part"), F.col("item_id").alias("id"), "role")]
    for part, rows in (("event", events), ("report", reports)):
        linked = rows.select("id", F.explode("item_ids").alias("item_id")).join(own.select("item_id"), "item_id", "left_semi")
        parts.append(linked.select(F.lit(part).alias("part"), "id", F.lit(None).cast("string").alias("role")).distinct())
    return reduce(DataFrame.unionByName, parts)


def report_list(topics: DataFrame, text: str = "", linked: bool | None = None) -> DataFrame:
    """topics(haystack, refs, ..) with all words of `text`; with or without links to tracked items (None: any)."""
    out = topics.filter(_has_all(F.col("haystack"), terms(text)))
    has = F.size(F.coalesce("refs", F.array().cast("array<string>"))) > 0
    return out if linked is None else out.filter(has if linked else ~has)


def change_feed(events: DataFrame, text: str = "", **facets: str | None) -> DataFrame:
    """kind, n, highlights: events(haystack, kind, highlight) that pass the filters, counted by kind."""
    return filtered(events, text, **facets).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("highlight")).alias("highlights"))


def notes_by_version(notes: DataFrame, key) -> DataFrame:
    """platform, version, place (from 1, the newest first), lines: notes(platform, version, text), each text once."""
    from factloom.operators.graph import rank_within

    by = notes.select("platform", "version", "text").distinct().groupBy("platform", "version").agg(F.array_sort(F.collect_list("text")).alias("lines"))
    return rank_within(by, "platform", [key(F.col("version")).desc(), F.col("version")], "place")


def releases_view(notes: DataFrame, current: DataFrame, key, platform: str | None = None) -> DataFrame:
    """notes_by_version with current: whether it is a current version, current(platform, channel, version), and of which
    channels; of one platform (None: all)."""
    channels = current.groupBy("platform", "version").agg(F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"))
    out = notes_by_version(notes, key).join(channels, ["platform", "version"], "left")
    return out if platform is None else out.filter(F.col("platform") == platform)


def readiness(facts: DataFrame) -> DataFrame:
    """facts(name, value: nullable boolean) as known yes, known no or unknown."""
    return facts.withColumn("readiness", F.when(F.col("value"), "yes").when(F.col("value").isNull(), "unknown").otherwise("no"))


def status_counts(cells: DataFrame, keys: list[str], states: list[str]) -> DataFrame:
    """How many cells of each state the keys have, a column a state."""
    return cells.groupBy(*keys).agg(*[F.count_if(F.col("state") == s).alias(s.replace("-", "_")) for s in states])


def sources_table(status: DataFrame, now: Column, hours: int = 6) -> DataFrame:
    """status(source_id, outcome, last_success_at) with age, stale and failing; a failing source is not counted as stale."""
    from factloom.operators.status import staleness

    marked = staleness(status, now, hours).withColumn("failing", F.col("outcome") == "failed")
    return marked.withColumn("counts_as", F.when(F.col("failing"), "failing").when(F.col("stale"), "stale").otherwise("fresh"))


def overview(groups: DataFrame, events: DataFrame, affected: DataFrame, recent: int = 6) -> DataFrame:
    """part, label, n: counts of the overview page: groups(state, kind, regression), the `recent` latest events(kind,
    source_at, id) by kind, and advisories that affect (affected NULL is unknown)."""
    g = groups.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") == "open").alias("open"), F.count_if((F.col("state") == "open") & (F.col("kind") == "bug")).alias("open_bugs"), F.count_if(F.col("regression")).alias("regressions"))
    counts = g.select(F.explode(F.create_map(*[x for c in g.columns for x in (F.lit(c), F.col(c))])).alias("label", "n")).select(F.lit("work").alias("part"), "label", "n")
    latest = events.orderBy(F.desc("source_at"), "id").limit(recent).groupBy(F.col("kind").alias("label")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("recent").alias("part"), "label", "n")
    verdict = F.when(F.col("affected"), "affected").when(F.col("affected").isNull(), "unknown").otherwise("not-affected")
    advisories = affected.groupBy(verdict.alias("label")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("advisories").alias("part"), "label", "n")
    return counts.unionByName(latest).unionByName(advisories)


def upstream_view(resolved: DataFrame, verdicts: DataFrame, ranges: DataFrame) -> DataFrame:
    """snapshot, name, highest, adopted, n_advisories, n_affecting: packages of each build with what is known against them;
    ranges(advisory_id, package) ties advisories to packages."""
    known = ranges.select("advisory_id", F.col("package").alias("name")).distinct().join(verdicts.select("advisory_id", "affected"), "advisory_id")
    counts = known.groupBy("name").agg(F.count(F.lit(1)).alias("n_advisories"), F.count_if(F.col("affected")).alias("n_affecting"))
    return resolved.join(counts, "name", "left").fillna(0, ["n_advisories", "n_affecting"]).select("snapshot", "name", "highest", "adopted", "n_advisories", "n_affecting")
