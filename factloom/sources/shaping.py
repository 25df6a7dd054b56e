"""Landed API pages turned into tables, and the bookkeeping of runs. Fetching is the caller's job."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.parse import asset_platforms, release_name
from factloom.operators.merge import upsert


@dataclass
class Collected:
    """What a source gives: its tables, and how far it got."""

    data: dict[str, DataFrame]
    partial: bool = False
    limitations: list[str] = field(default_factory=list)
    removed: DataFrame | None = None
    stale_since: object = None


class Source(Protocol):
    """A source of evidence. Sources run after those they depend on."""

    id: str
    schema: int
    budget: int
    depends_on: list[str]
    carry_on_partial: list[str]

    def collect(self, spark: SparkSession, previous: dict[str, DataFrame]) -> Collected: ...


def in_order(sources: list[Source]) -> list[Source]:
    """Sources with those they depend on before them, else as listed; an unknown or circular dependency is an error."""
    done: list[Source] = []
    left = list(sources)
    while left:
        ready = [s for s in left if set(s.depends_on) <= {d.id for d in done}]
        if not ready:
            raise ValueError("sources depend on each other or on unknown ones: " + ", ".join(s.id for s in left))
        done.append(ready[0])
        left.remove(ready[0])
    return done


ITEM_PAGE = "array<struct<number:long,title:string,body:string,state:string,state_reason:string,merged_at:string,is_draft:boolean,labels:array<struct<name:string>>,assignees:array<struct<login:string>>,user:struct<login:string>,head:struct<ref:string>,base:struct<ref:string>,created_at:string,updated_at:string,closed_at:string,pull_request:string,timeline:array<struct<event:string,created_at:string,label:struct<name:string>,source:string>>>>"


def flatten_items(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages(repo, page, json) -> items and timeline, a row an item and an event; the same item on several pages counts
    once, the last page's. State: merged, closed or open; labels and assignees by name; events without a time go."""
    rows = pages.select("repo", "page", F.explode(F.from_json("json", ITEM_PAGE)).alias("i"))
    last = rows.groupBy("repo", F.col("i.number").alias("number")).agg(F.max_by("i", F.struct("page", F.col("i.updated_at"))).alias("i"))
    state = F.when(F.col("i.merged_at").isNotNull(), "merged").otherwise(F.lower("i.state"))
    item_id = F.concat(F.lower("repo"), F.lit("#"), F.col("number"))
    items = last.select(
        item_id.alias("id"), "repo", "number", F.when(F.col("i.pull_request").isNotNull() | F.col("i.merged_at").isNotNull(), "pr").otherwise("issue").alias("kind"),
        F.col("i.title").alias("title"), F.col("i.body").alias("body"), state.alias("state"), F.lower("i.state_reason").alias("state_reason"), F.coalesce("i.is_draft", F.lit(False)).alias("is_draft"),
        F.transform(F.coalesce("i.labels", F.array().cast("array<struct<name:string>>")), lambda x: x["name"]).alias("labels"), F.transform(F.coalesce("i.assignees", F.array().cast("array<struct<login:string>>")), lambda x: x["login"]).alias("assignees"),
        F.col("i.user.login").alias("author"), F.col("i.head.ref").alias("head_ref"), F.col("i.base.ref").alias("base_ref"),
        *[F.try_to_timestamp(F.col(f"i.{c}")).alias(c) for c in ("created_at", "updated_at", "closed_at", "merged_at")],
    )
    events = last.select(item_id.alias("id"), F.posexplode("i.timeline").alias("position", "e"))
    timeline = events.select("id", "position", F.lower("e.event").alias("type"), F.col("e.label.name").alias("label"), F.lower("e.source").alias("ref"), F.try_to_timestamp("e.created_at").alias("at")).filter("at IS NOT NULL")
    return items, timeline


RELEASE_PAGE = "array<struct<name:string,tag_name:string,draft:boolean,published_at:string,assets:array<struct<name:string>>>>"


def flatten_releases(pages: DataFrame) -> DataFrame:
    """pages(json) -> tag, channel, version, engine, platforms, published_at; drafts go, a tag counts once."""
    rows = pages.select(F.explode(F.from_json("json", RELEASE_PAGE)).alias("r")).filter(~F.coalesce("r.draft", F.lit(False)))
    named = rows.withColumn("n", release_name(F.col("r.name")))
    files = F.transform(F.coalesce("r.assets", F.array().cast("array<struct<name:string>>")), lambda a: a["name"])
    out = named.select(F.col("r.tag_name").alias("tag"), "n.channel", "n.version", "n.engine", asset_platforms(files).alias("platforms"), F.try_to_timestamp("r.published_at").alias("published_at"))
    return out.groupBy("tag").agg(F.max_by(F.struct("channel", "version", "engine", "platforms", "published_at"), F.struct("published_at", "version")).alias("r")).select("tag", "r.*")


def flatten_advisories(world: DataFrame, repository: DataFrame, tree: DataFrame) -> DataFrame:
    """advisory_id, aliases, summary, packages, published_at, updated_at, url of two feeds with these columns (url apart): the
    repository's row overrides the world's, aliases of both are kept; tree(advisory_id, path) gives the place of its file."""
    columns = ["advisory_id", "aliases", "summary", "packages", "published_at", "updated_at"]
    both = world.select("advisory_id", F.col("aliases").alias("_other")).join(repository.select("advisory_id", F.col("aliases").alias("_own")), "advisory_id", "full_outer")
    none = F.array().cast("array<string>")
    named = both.groupBy("advisory_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat(F.coalesce("_own", none), F.coalesce("_other", none)))))).alias("_aliases"))
    rows = upsert(world.select(*columns), repository.select(*columns), ["advisory_id"])
    place = tree.groupBy("advisory_id").agg(F.min("path").alias("path"))
    return rows.join(named, "advisory_id").join(place, "advisory_id", "left").select("advisory_id", F.col("_aliases").alias("aliases"), "summary", "packages", "published_at", "updated_at", "path")


def flatten_upstream(index: DataFrame, feed: DataFrame, previous: DataFrame) -> DataFrame:
    """(package, version, published_at, yanked) of a package index and a release feed, each version once; a missing date is
    the other's or the one known before; yanked if either says so."""
    rows = index.select("package", "version", "published_at", "yanked").unionByName(feed.select("package", "version", "published_at", F.lit(False).alias("yanked")))
    one = rows.groupBy("package", "version").agg(F.min("published_at").alias("_at"), F.bool_or(F.coalesce("yanked", F.lit(False))).alias("yanked"))
    old = previous.groupBy("package", "version").agg(F.min("published_at").alias("_old"))
    return one.join(old, ["package", "version"], "left").select("package", "version", F.coalesce("_at", "_old").alias("published_at"), "yanked")


TOPIC_PAGE = "struct<topic_list:struct<topics:array<struct<id:long,title:string,created_at:string,last_posted_at:string,category_id:long,tags:array<string>>>>>"


def flatten_topics(pages: DataFrame, details: DataFrame) -> DataFrame:
    """topic_id, title, created_at, last_post_at, category, tags (sorted), text of forum pages(page, json) and
    details(topic_id, posts: array of texts); a topic on several pages counts once, the last page's."""
    rows = pages.select("page", F.explode(F.from_json("json", TOPIC_PAGE)["topic_list"]["topics"]).alias("t"))
    last = rows.groupBy(F.col("t.id").alias("topic_id")).agg(F.max_by("t", F.struct("page", F.col("t.last_posted_at"))).alias("t"))
    text = details.select("topic_id", F.concat_ws("\n\n", "posts").alias("text"))
    return last.join(text, "topic_id", "left").select("topic_id", F.col("t.title").alias("title"), F.try_to_timestamp("t.created_at").alias("created_at"), F.try_to_timestamp("t.last_posted_at").alias("last_post_at"), F.col("t.category_id").alias("category"), F.array_sort(F.coalesce("t.tags", F.array().cast("array<string>"))).alias("tags"), "text")


def validate(df: DataFrame, rules: dict[str, Column], key: str | None = None) -> DataFrame:
    """df, after one pass that counts the rows that break a rule (its column must be true, so NULL breaks it) and repeats of
    the key; raises with the counts before anything is written."""
    counts = [F.count_if(~F.coalesce(test, F.lit(False))).alias(name) for name, test in rules.items()]
    if key is not None:
        counts.append((F.count(F.lit(1)) - F.count_distinct(key)).alias(f"repeated {key}"))
    bad = {k: n for k, n in df.agg(*counts).first().asDict().items() if n}
    if bad:
        raise ValueError("malformed rows: " + ", ".join(f"{k}: {n}" for k, n in sorted(bad.items())))
    return df


def validate_status(status: DataFrame) -> DataFrame:
    """Bookkeeping of sources(source_id, outcome, failures, last_success_at, last_complete_at)."""
    known = F.col("outcome").isin("ok", "partial", "failed")
    order = F.coalesce(F.col("last_complete_at") <= F.col("last_success_at"), F.col("last_complete_at").isNull())
    return validate(status, {"source_id": F.col("source_id") != "", "outcome": known, "failures": F.col("failures") >= 0, "times": order}, "source_id")


def validate_runs(runs: DataFrame) -> DataFrame:
    """Bookkeeping of runs(run_id, started_at, ended_at, outcome)."""
    known = F.col("outcome").isin("success", "partial", "failed")
    return validate(runs, {"run_id": F.col("run_id") != "", "outcome": known, "times": F.coalesce(F.col("ended_at") >= F.col("started_at"), F.col("ended_at").isNull())}, "run_id")


def append_run(runs: DataFrame, run: DataFrame, most: int = 300) -> DataFrame:
    """runs with a new one, which replaces one of the same run_id; the newest `most`."""
    return upsert(runs, run, ["run_id"]).orderBy(F.desc("started_at"), F.desc("run_id")).limit(most)


def generation(manifest: DataFrame, generated_at: Column) -> DataFrame:
    """The manifest rows that a derivation of that time may have read: the newest of each source not after it. A source that
    has only newer ones is missing, and its absence is for the caller to refuse."""
    return manifest.filter(F.col("retrieved_at") <= generated_at).groupBy("source_id").agg(F.max_by(F.struct("run_id", "retrieved_at"), F.struct("retrieved_at", "run_id")).alias("m")).select("source_id", "m.*")
