"""Relations between work items: edges, duplicates, epics, groups; all by joins, whatever the order of the input.

Items are (id, repo, number, kind, ...). Where the lowest id counts, ids are compared as they are, so that they should
sort by repository and number, as struct(repo, number) or whole numbers do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import title_tokens
from factloom.operators import graph
from factloom.operators.scan import running_last
from factloom.sources.tables import saved


def lowest_id(repo: Column, number: Column, id: Column) -> Column:
    """Aggregate: the id with the lowest repository, then number."""
    return F.min(F.struct(repo.alias("repo"), number.alias("number"), id.alias("id")))["id"]


def discover(channels: dict[str, DataFrame]) -> DataFrame:
    """id, tags: the union of discovery channels, with the names of those that found each id."""
    tagged = [df.select("id", F.lit(name).alias("tag")) for name, df in channels.items()]
    return reduce(DataFrame.unionByName, tagged).groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def accept_weak_links(links: DataFrame, items: DataFrame, stop: list[str]) -> DataFrame:
    """links(src, dst) between items whose titles share a significant token."""
    tokens = items.select("id", title_tokens(F.col("title"), stop).alias("tokens"))
    a, b = tokens.select(F.col("id").alias("src"), F.col("tokens").alias("_a")), tokens.select(F.col("id").alias("dst"), F.col("tokens").alias("_b"))
    return links.join(a, "src").join(b, "dst").filter(F.arrays_overlap("_a", "_b")).select("src", "dst")


def build_edges(items: DataFrame, timeline: DataFrame, stop: list[str]) -> DataFrame:
    """edges(kind, src, dst) between tracked items.

    items(id, kind, title, is_uplift, closes, mentions, branch_refs, uplift_of, children: arrays of ids), timeline(id,
    type, ref). uplift: an uplift and what it names; one that names nothing and that pull requests' timelines
    cross-reference hangs below those. resolves: pull requests and issues they close, by body or by the issue's timeline
    (`closed_by`), or by branch name where the titles share a token; uplifts inherit the issues of all above them.
    mentions: what is mentioned and not resolved. epic: epics and children; the lowest epic wins a child.
    """
    items = saved(items)  # read many times below
    known = items.select(F.col("id").alias("dst"), F.col("kind").alias("_dst_kind"))

    def of(column: str, which: Column) -> DataFrame:
        links = items.filter(which).select(F.col("id").alias("src"), F.explode(column).alias("dst")).filter("src <> dst").distinct()
        return links.join(known, "dst").select("src", "dst", "_dst_kind")

    pull, issue = F.col("kind") == "pr", F.col("_dst_kind") == "issue"
    named = of("uplift_of", F.col("is_uplift")).filter("_dst_kind = 'pr'").select("src", "dst")
    crossed = timeline.filter("type = 'cross_referenced'").select(F.col("ref").alias("src"), F.col("id").alias("dst"))
    crossed = crossed.join(items.filter(F.col("is_uplift")).select(F.col("id").alias("src")), "src", "left_semi").join(items.filter(pull).select(F.col("id").alias("dst")), "dst", "left_semi")
    uplift = saved(named.unionByName(crossed.join(named.select("src").distinct(), "src", "left_anti").filter("src <> dst").select("src", "dst")).distinct())
    closed = timeline.filter("type = 'closed_by'").select(F.col("ref").alias("src"), F.col("id").alias("dst"))
    closed = closed.join(items.filter(pull).select(F.col("id").alias("src")), "src", "left_semi").join(items.filter("kind = 'issue'").select(F.col("id").alias("dst")), "dst", "left_semi")
    sure = of("closes", pull).filter(issue).select("src", "dst").unionByName(closed.select("src", "dst"))
    branch = accept_weak_links(of("branch_refs", pull).filter(issue).select("src", "dst"), items, stop)
    direct = saved(sure.unionByName(branch).distinct())
    down = uplift.select(F.col("dst").alias("parent"), F.col("src").alias("child"))
    inherited = graph.pushed(down, direct.select(F.col("src").alias("node"), F.col("dst").alias("label"))).select(F.col("node").alias("src"), F.col("label").alias("dst"))
    resolves = saved(direct.unionByName(inherited).distinct())
    mentions = of("mentions", F.lit(True)).filter(issue).select("src", "dst").join(resolves, ["src", "dst"], "left_anti")
    epics = of("children", F.col("kind") == "issue").groupBy("dst").agg(F.min("src").alias("src"))
    parts = (("uplift", uplift), ("resolves", resolves), ("mentions", mentions), ("epic", epics))
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), "src", "dst") for kind, df in parts])


def active_duplicates(timeline: DataFrame) -> DataFrame:
    """duplicate, canonical, at: for each pair the latest mark, if it is none of an unmark; of equal times the duplicate's
    own side wins, then the later row. timeline(id, type, ref, at, position): marked_duplicate (id is the duplicate),
    has_duplicate (ref is), unmarked_duplicate (clears the pair both ways)."""
    t = timeline.filter(F.col("ref").isNotNull() & (F.col("ref") != F.col("id")))

    def side(type: str, active: bool, duplicate: str, own: int) -> DataFrame:
        canonical = "ref" if duplicate == "id" else "id"
        return t.filter(F.col("type") == type).select(F.col(duplicate).alias("duplicate"), F.col(canonical).alias("canonical"), F.lit(active).alias("active"), F.struct("at", F.lit(own).alias("own"), "position").alias("order"))

    rows = [side("marked_duplicate", True, "id", 1), side("has_duplicate", True, "ref", 0), side("unmarked_duplicate", False, "id", 1), side("unmarked_duplicate", False, "ref", 0)]
    last = reduce(DataFrame.unionByName, rows).groupBy("duplicate", "canonical").agg(F.max_by("active", "order").alias("active"), F.max("order").alias("order"))
    return last.filter("active").select("duplicate", "canonical", F.col("order.at").alias("at"), F.col("order.position").alias("position"))


def running_marks(timeline: DataFrame) -> DataFrame:
    """timeline(id, type, ref, at, position) of marked_duplicate and unmarked_duplicate rows with marked and canonical, the
    state of each id after the row: a mark sets both; an unmark of the canonical that holds clears them, others do nothing.
    Positions tell rows of an id apart at equal times. An id that holds all rows is worked on by all tasks."""
    order = [F.col("at"), F.col("position")]
    rows = timeline.filter(F.col("type").isin("marked_duplicate", "unmarked_duplicate"))
    mark = F.when(F.col("type") == "marked_duplicate", F.struct("ref", F.col("at").alias("since"), F.col("position").alias("nth")))
    rows = running_last(rows, ["id"], order, mark, "_mark").select("*", F.col("_mark.since").alias("_since"), F.col("_mark.nth").alias("_of"))
    undone = F.when((F.col("type") == "unmarked_duplicate") & (F.col("ref") == F.col("_mark.ref")), F.lit(True))
    rows = running_last(rows, ["id", "_since", "_of"], order, undone, "_undone")
    marked = F.col("_mark").isNotNull() & F.col("_undone").isNull()
    return rows.select(*timeline.columns, marked.alias("marked"), F.when(marked, F.col("_mark.ref")).alias("canonical"))


def duplicate_of(items: DataFrame, marks: DataFrame) -> DataFrame:
    """id, canonical (NULL if none is known), basis of issues that are duplicates: closed as one, closed with a comment
    that says so, marked, or labelled, in that order. items(id, kind, state, state_reason, comment_duplicate_of, labels);
    marks as active_duplicates finds them, the latest counts; references to itself do not."""
    latest = marks.groupBy(F.col("duplicate").alias("id")).agg(F.max_by("canonical", F.struct("at", "position")).alias("_marked"))
    other = lambda c: F.when(c != F.col("id"), c)
    said, marked = other(F.col("comment_duplicate_of")), F.col("_marked")
    basis = (
        F.when(F.col("state_reason") == "duplicate", "closed as duplicate")
        .when((F.col("state") == "closed") & said.isNotNull(), "closing comment")
        .when(marked.isNotNull(), "marked as duplicate")
        .when(F.array_contains("labels", "closed/duplicate"), "label")
    )
    canonical = F.when(F.col("basis") == "closing comment", said).otherwise(F.coalesce(marked, F.when(F.col("basis") == "closed as duplicate", said)))
    return items.filter("kind = 'issue'").join(latest, "id", "left").withColumn("basis", basis).filter("basis IS NOT NULL").select("id", canonical.alias("canonical"), "basis")


def epics(items: DataFrame) -> DataFrame:
    """Issues that gather others: by sub-issues, a label, or a title that says so with two listed issues at least.
    items(id, kind, title, labels, sub_issues, listed: arrays of ids) -> id, children."""
    by_title = F.col("title").rlike(r"(?i)\b(?:epic|meta|tracking)\b") & (F.size("listed") >= 2)
    is_epic = (F.size("sub_issues") > 0) | F.exists("labels", lambda x: F.lower(x).contains("epic")) | by_title
    return items.filter((F.col("kind") == "issue") & is_epic).select("id", F.array_distinct(F.concat("sub_issues", "listed")).alias("children"))


def groups(items: DataFrame, edges: DataFrame, duplicates: DataFrame) -> DataFrame:
    """group_id, item_id, role (lead, duplicate, pr, uplift, mention): every item is in one group at least.

    items(id, kind, is_uplift), edges of build_edges, duplicates(id, canonical). Issues fold into the issue at the end of
    their chain of duplicates (into the lowest of a cycle), with the pull requests that resolve any of them, all uplifts
    below those, and what mentions them otherwise. Pull requests without an issue lead a group with the uplifts below
    whose root they are; what is left leads a group alone.
    """
    items = saved(items.select("id", "kind", "is_uplift"))
    issues, pulls = items.filter("kind = 'issue'").select("id"), items.filter("kind = 'pr'").select("id", "is_uplift")
    chain = duplicates.join(issues, "id", "left_semi").join(issues.select(F.col("id").alias("canonical")), "canonical", "left_semi").filter("id <> canonical")
    found = graph.canonical(chain.select(F.col("id").alias("node"), F.col("canonical").alias("parent")))
    rooted = saved(issues.join(found, issues["id"] == found["node"], "left").select("id", F.coalesce("root", "id").alias("group_id")))
    own = rooted.select("group_id", F.col("id").alias("item_id"), F.when(F.col("id") == F.col("group_id"), "lead").otherwise("duplicate").alias("role"))
    uplift = saved(edges.filter("kind = 'uplift'").select(F.col("dst").alias("parent"), F.col("src").alias("child")).distinct())
    of_issue = lambda kind: edges.filter(F.col("kind") == kind).select(F.col("src").alias("item_id"), F.col("dst").alias("id")).join(rooted, "id").select("group_id", "item_id").distinct()
    linked = of_issue("resolves").join(pulls, F.col("item_id") == pulls["id"]).select("group_id", "item_id", F.when(F.col("is_uplift"), "uplift").otherwise("pr").alias("role"))
    marks = linked.select(F.col("item_id").alias("node"), F.struct("group_id", "item_id").alias("label"))
    lifted = graph.pushed(uplift, marks).filter("node <> label.item_id").select(F.col("label.group_id").alias("group_id"), F.col("node").alias("item_id"), F.lit("uplift").alias("role"))
    # what is both linked and below another is an uplift
    members = saved(own.unionByName(linked.unionByName(lifted).groupBy("group_id", "item_id").agg(F.max("role").alias("role"))))
    mentions = of_issue("mentions").join(members, ["group_id", "item_id"], "left_anti").withColumn("role", F.lit("mention"))
    free = saved(pulls.join(members.select(F.col("item_id").alias("id")).distinct(), "id", "left_anti"))
    tops = saved(graph.roots_of(uplift))
    leads = free.join(tops.select(F.col("node").alias("id")).distinct(), "id", "left_anti").unionByName(free.filter(~F.col("is_uplift")).join(tops.select(F.col("node").alias("id")).distinct(), "id", "left_semi"))
    leads = saved(leads.select("id").distinct())
    under = tops.join(leads, tops["root"] == leads["id"]).select("id", F.col("node").alias("below"))
    led = leads.select(F.col("id").alias("group_id"), F.col("id").alias("item_id"), F.lit("lead").alias("role")).unionByName(under.select(F.col("id").alias("group_id"), F.col("below").alias("item_id"), F.lit("uplift").alias("role")))
    covered = saved(members.unionByName(led))
    alone = items.join(covered.select(F.col("item_id").alias("id")).distinct(), "id", "left_anti").select(F.col("id").alias("group_id"), F.col("id").alias("item_id"), F.lit("lead").alias("role"))
    return covered.unionByName(mentions).unionByName(alone)


def expand_links(direct: DataFrame, edges: DataFrame, known: DataFrame, cap: int) -> DataFrame:
    """id, strong: one step from direct(id) over edges(src, dst, strong) to items that are not known(id) yet; weak links
    count only to what is an uplift of something direct (is_uplift_of of the edge); the `cap` lowest ids, strong ones
    first."""
    step = edges.join(direct.select(F.col("id").alias("src")), "src", "left_semi").filter(F.col("strong") | F.col("is_uplift_of"))
    found = step.groupBy(F.col("dst").alias("id")).agg(F.bool_or("strong").alias("strong"))
    new = found.join(known.select("id"), "id", "left_anti").join(direct.select("id"), "id", "left_anti")
    return new.orderBy(F.desc("strong"), "id").limit(cap)


def group_of(rows: DataFrame, members: DataFrame) -> DataFrame:
    """rows(id, item_ids) with the group of the first role in the order lead, pr, uplift, duplicate that one of their items
    has, the lowest group of several."""
    roles = ("lead", "pr", "uplift", "duplicate")
    lowest = [F.min(F.when(F.col("role") == r, F.col("group_id"))) for r in roles]  # plain minima, so that rows are not sorted
    met = rows.select("id", F.explode("item_ids").alias("item_id")).join(members, "item_id")
    return met.groupBy("id").agg(F.coalesce(*lowest, F.min("group_id")).alias("group_id"))


def inherit_topic(topics: DataFrame, edges: DataFrame) -> DataFrame:
    """topics(id, topic) where children of an epic take the epic's topic."""
    of = edges.filter("kind = 'epic'").select(F.col("dst").alias("id"), F.col("src").alias("_epic"))
    theirs = topics.select(F.col("id").alias("_epic"), F.col("topic").alias("_topic"))
    return topics.join(of, "id", "left").join(theirs, "_epic", "left").select("id", F.coalesce("_topic", "topic").alias("topic"))


def latest_switch_change(items: DataFrame, pattern: str) -> DataFrame:
    """The last merged pull request whose title matches: one row at most, ties by id."""
    return items.filter("kind = 'pr' AND state = 'merged'").filter(F.col("title").rlike(pattern)).orderBy(F.desc("merged_at"), F.desc("id")).limit(1)


def severity_order(groups: DataFrame) -> DataFrame:
    """Known issues, open and direct bugs: regressions first, then by priority label, then the latest; ties by id."""
    rank = F.coalesce(*[F.when(F.array_contains("labels", f"priority/P{k}"), k) for k in range(1, 6)], F.lit(9))
    found = groups.filter("state = 'open' AND relevance = 'direct' AND kind = 'bug'")
    return found.withColumn("severity", F.when(F.col("regression"), 0).otherwise(rank)).orderBy("severity", F.desc("updated_at"), "id")


def sort_work(rows: DataFrame, mode: str) -> DataFrame:
    """rows(id, number, created_at, updated_at) in the order that a user chose: updated, created or number."""
    by = {"updated": "updated_at", "created": "created_at", "number": "number"}[mode]
    return rows.orderBy(F.desc(by), "id")


def display_groups(rows: DataFrame, order: DataFrame, otherwise: str = "more") -> DataFrame:
    """rows(id, ...) with the display group and place of order(id, display, place); what it lacks goes behind the rest."""
    placed = rows.join(order, "id", "left")
    return placed.withColumn("display", F.coalesce("display", F.lit(otherwise))).withColumn("place", F.coalesce("place", F.lit(2**31 - 1)))


def group_facets(members: DataFrame) -> DataFrame:
    """Facets of groups by rows(group_id, role, kind, state, is_draft, merged_at, updated_at, assignees, author, labels,
    platforms, relevance, title): implementation state and earliest merge, owners, authors, platforms, last update, flags."""
    master, pull = F.col("role") == "pr", F.col("kind") == "pr"
    own = F.col("role").isin("lead", "duplicate", "pr", "uplift")
    is_master = master | (pull & (F.col("role") == "lead"))
    merged, open_ = is_master & (F.col("state") == "merged"), is_master & (F.col("state") == "open")
    some = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    state = F.when(some(merged), "merged").when(some(open_ & ~F.coalesce("is_draft", F.lit(False))), "open").when(some(open_), "draft").when(some(is_master), "closed-unmerged").otherwise("none")
    flat = lambda array: F.array_sort(F.array_distinct(F.flatten(F.collect_list(array))))
    labels = F.transform(F.coalesce("labels", F.array().cast("array<string>")), lambda x: F.lower(x))
    return members.filter(own).groupBy("group_id").agg(
        state.alias("implementation"),
        F.min(F.when(merged, F.col("merged_at"))).alias("merged_at"),
        F.max("updated_at").alias("last_updated"),
        flat(F.when(F.col("kind") == "issue", F.coalesce("assignees", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))).alias("owners"),
        F.array_sort(F.collect_set(F.when(pull, F.col("author")))).alias("authors"),
        flat(F.coalesce("platforms", F.array().cast("array<string>"))).alias("platforms"),
        some(F.array_contains(labels, "regression")).alias("regression"),
        some(F.array_contains(labels, "security")).alias("security"),
        F.when(some(F.col("relevance") == "direct"), "direct").when(some(F.col("relevance") == "mention"), "mention").otherwise("linked").alias("relevance"),
    )
