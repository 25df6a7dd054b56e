"""Status rules: first match wins, and unknown never becomes false."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.graph import walk

#: Ranks of matrix states, for caps.
RANKS = {"available": 8, "in-build": 7, "opt-in": 6, "off": 5, "hidden": 4, "service-off": 3, "absent": 2, "not-verified": 1, "not-planned": 0}


def first_match(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    chain = F.when(F.coalesce(rules[0][0], F.lit(False)), rules[0][1])
    for test, name in rules[1:]:
        chain = chain.when(F.coalesce(test, F.lit(False)), name)
    return chain.otherwise(otherwise)


def stage(prs_closed: Column | None = None) -> Column:
    """The stage of a work group from its facts: duplicate, contradictory, not_planned, has_note, in_release, in_beta,
    in_nightly, merged, service_only, open_pr, issue_closed, pr_led (nullable booleans). prs_closed: all pull requests are
    closed and none is merged; a group that one leads has no issue, and by default issue_closed says it."""
    c = F.col
    return first_match(
        [
            (c("duplicate") & ~F.coalesce(c("contradictory"), F.lit(False)), "duplicate"),
            (c("not_planned"), "not-planned"),
            (c("has_note"), "released"),
            (c("in_release"), "in-release-build"),
            (c("in_beta"), "in-beta"),
            (c("in_nightly"), "in-nightly"),
            (c("merged") & c("service_only"), "service-change"),
            (c("merged"), "merged"),
            (c("open_pr"), "in-progress"),
            (c("issue_closed") & ~F.coalesce(c("pr_led"), F.lit(False)), "closed-unverified"),
            (c("pr_led") & (c("issue_closed") if prs_closed is None else prs_closed), "closed-unmerged"),
        ],
        "open",
    )


def flag_state(state: Column) -> Column:
    """Aggregate over several flags: missing before off before unknown before on."""
    rank = F.when(state == "missing", 0).when(state == "off", 1).when(state.isNull() | (state == "unknown"), 2).otherwise(3)
    return F.element_at(F.array(*[F.lit(x) for x in ("missing", "off", "unknown", "on")]), F.min(rank) + 1)


def cell_state() -> Column:
    """A matrix cell from: service_on, blocked, not_planned, has_note, required_present, channel, flag, opt_in, built,
    note_here (the note is of this build's version or an older one), built_defined, tagged (nullable). A note corroborates a
    tagged build of its version or a newer one, and none from which the implementing work is known to be missing."""
    c = F.col
    release, flag = c("channel") == "release", F.coalesce(c("flag"), F.lit("none"))
    note_holds = F.coalesce(c("note_here"), F.lit(False)) & F.coalesce(c("tagged"), F.lit(False)) & F.coalesce(c("built"), F.lit(True))
    corroborated = note_holds | F.coalesce(c("built"), F.lit(False)) | ~F.coalesce(c("built_defined"), F.lit(False))
    early = F.when(F.coalesce(c("has_note"), F.lit(False)), note_holds).otherwise(c("built"))
    return first_match(
        [
            (~c("service_on"), "service-off"),
            (c("blocked"), "hidden"),
            (c("not_planned") & ~F.coalesce(c("has_note"), F.lit(False)), "not-planned"),
            (~c("required_present"), "absent"),
            (release & c("has_note") & ~flag.isin("off", "missing"), "available"),
            ((flag == "off") & c("opt_in"), "opt-in"),
            (flag == "off", "off"),
            (flag == "missing", "absent"),
            ((flag == "on") & corroborated & release & c("has_note"), "available"),
            ((flag == "on") & corroborated, "in-build"),
            ((flag == "none") & ~release & c("tagged") & early, "in-build"),
            ((flag == "none") & release & c("built") & ~F.coalesce(c("has_note"), F.lit(False)), "in-build"),
        ],
        "not-verified",
    )


def rank_of(state: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in RANKS.items() for x in p]), state)


def cap(cells: DataFrame, needs: DataFrame, depth: int) -> DataFrame:
    """cells(entity, place, rank) never above what they need, needs(entity, needed), for chains of `depth` steps.

    One join a level, prerequisites first; limited_by names the entity that set a rank."""
    now = cells.withColumn("limited_by", F.lit(None).cast(cells.schema["entity"].dataType))
    for _ in range(depth):
        upper = now.select(F.col("entity").alias("needed"), "place", F.col("rank").alias("_rank"))
        least = needs.join(upper, "needed").groupBy("entity", "place").agg(F.min(F.struct("_rank", "needed")).alias("_low"))
        joined = now.join(least, ["entity", "place"], "left")
        lower = F.coalesce(F.col("_low._rank") < F.col("rank"), F.lit(False))
        now = joined.select("entity", "place", F.when(lower, F.col("_low._rank")).otherwise(F.col("rank")).alias("rank"), F.when(lower, F.col("_low.needed")).otherwise(F.col("limited_by")).alias("limited_by"))
    return now


def demote_unknown(cells: DataFrame, unknown: DataFrame, keys: list[str]) -> DataFrame:
    """Usable states of cells whose required probe is unknown become not-verified; the found state stays as found."""
    usable = F.col("state").isin("available", "in-build", "opt-in", "off")
    marked = cells.join(unknown.select(*keys).distinct().withColumn("_unknown", F.lit(True)), keys, "left")
    return marked.withColumn("found", F.col("state")).withColumn("state", F.when(usable & F.col("_unknown"), "not-verified").otherwise(F.col("state"))).drop("_unknown")


def note_bound(note: Column, current: Column, key) -> Column:
    """within, same-line or newer: a note's version against the current one (full, or two parts: a line)."""
    full = current.rlike(r"\A[0-9]+(\.[0-9]+){2,}\z")
    line = current.rlike(r"\A[0-9]+\.[0-9]+\z")
    note_line = F.regexp_extract(note, r"\A([0-9]+\.[0-9]+)", 1)
    return (
        F.when(full, F.when(key(note) <= key(current), "within").otherwise("newer"))
        .when(line, F.when(key(note_line) == key(current), "same-line").when(key(note_line) < key(current), "within").otherwise("newer"))
    )


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node, reachable over edges(src, dst, matches): an edge that matches several targets proves none. What is not
    reached is unknown if such an edge starts at something that may be reached, else false."""
    nodes = reduce(DataFrame.unionByName, [edges.select(F.col("src").alias("node")), edges.select(F.col("dst").alias("node")), roots.select("node")]).distinct()
    found = walk(edges.filter("matches = 1"), roots).select("node").withColumn("_found", F.lit(True))
    maybe = walk(edges, roots).select("node").withColumn("_maybe", F.lit(True))
    verdict = F.when(F.col("_found"), True).when(F.col("_maybe"), None).otherwise(False)
    return nodes.join(found, "node", "left").join(maybe, "node", "left").select("node", verdict.alias("reachable"))


def staleness(sources: DataFrame, now: Column, hours: int = 6) -> DataFrame:
    """sources with stale (its last success is older than the window, or it never had one) and its age in hours."""
    age = F.timestamp_diff("HOUR", F.col("last_success_at"), now)
    return sources.withColumn("age_hours", age).withColumn("stale", F.coalesce(F.col("last_success_at") < now - F.make_dt_interval(hours=F.lit(hours)), F.lit(True)))


def status_counters(runs: DataFrame) -> DataFrame:
    """runs(source, at, outcome): failures in a row before and with each run, last success and last complete time."""
    order = Window.partitionBy("source").orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    marked = runs.withColumn("_block", F.sum((F.col("outcome") == "ok").cast("int")).over(upto))
    failing = F.sum((F.col("outcome") == "failed").cast("int")).over(Window.partitionBy("source", "_block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return marked.select("source", "at", "outcome", failing.alias("failures"), F.max(F.when(F.col("outcome").isin("ok", "partial"), F.col("at"))).over(upto).alias("last_success_at"), F.max(F.when(F.col("outcome") == "ok", F.col("at"))).over(upto).alias("last_complete_at"))


def run_outcome(outcome: Column) -> Column:
    """Aggregate: success if all sources are ok, partial if any is ok or partial, else failed."""
    return F.when(F.bool_and(outcome == "ok"), "success").when(F.bool_or(outcome.isin("ok", "partial")), "partial").otherwise("failed")
