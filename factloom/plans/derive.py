"""Queries on the driver's tables that run the operators for relations, matrices, exposure, trials and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import items as it
from factloom.functions.versions import version_key
from factloom.operators import events as ev
from factloom.operators import exposure, history, matrix, merge, relations, status, trials
from factloom.sources import shaping
from factloom.sources.tables import dealt, saved, table

C = F.col
#: Ways of shipping, by the part of a line.
MODES = ["AIR", "MAIL", "REG AIR", "SHIP", "RAIL", "FOB", "TRUCK"]


def _at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order and line number; the tables repeat some."""
    rows = table(spark, sf_dir, "lineitem")
    columns = ("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate", "l_suppkey", "l_partkey")
    return dealt(rows.select(*columns), rows.count(), "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("line_status"), F.max("l_shipdate").alias("shipdate"), F.max("l_suppkey").alias("suppkey"), F.max("l_partkey").alias("partkey")).withColumn("shipmode", F.element_at(F.array(*[F.lit(m) for m in MODES]), (C("partkey") % 7 + 1).cast("int")))




def item_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as issues and their lines as pull requests: lines from the fifth are uplifts of the line before; returned and
    accepted lines resolve the order, others mention it; pending orders duplicate the customer's order before."""
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), saved(_lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "flag"), "lines")
    from pyspark.sql import Window

    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    duplicates = orders.withColumn("b", before).filter("o_orderstatus = 'P' AND b IS NOT NULL").select((C("o_orderkey") * 10).alias("id"), (C("b") * 10).alias("canonical"))
    pulls = lines.select((C("l_orderkey") * 10 + C("l_linenumber")).alias("id"), (C("l_orderkey") * 10).alias("issue"), "l_linenumber", "flag")
    item = orders.select((C("o_orderkey") * 10).alias("id"), F.lit("issue").alias("kind"), F.lit(False).alias("is_uplift")).unionByName(pulls.select("id", F.lit("pr").alias("kind"), (C("l_linenumber") >= 5).alias("is_uplift")))
    uplift = pulls.filter("l_linenumber >= 5").select("id", (C("id") - 1).alias("dst")).join(pulls.select(C("id").alias("dst")), "dst").select(F.lit("uplift").alias("kind"), C("id").alias("src"), "dst")
    first = pulls.filter("l_linenumber < 5").join(orders.select((C("o_orderkey") * 10).alias("issue")), "issue", "left_semi")
    rest = first.select(F.when(C("flag") == "N", "mentions").otherwise("resolves").alias("kind"), C("id").alias("src"), C("issue").alias("dst"))
    return relations.groups(item, saved(uplift.unionByName(rest), "edges"), duplicates)


def marked_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors mark (user, k) as a pair, sign-ups take marks back: the pairs whose latest event is a mark."""
    rows = table(spark, sf_dir, "events").filter("event_type IN ('error', 'signup')")
    timeline = rows.select(C("user_id").cast("long").alias("id"), (F.get_json_object("props", "$.k").cast("long") + 1_000_000_000).alias("ref"), F.when(C("event_type") == "error", "marked_duplicate").otherwise("unmarked_duplicate").alias("type"), C("ts").alias("at"), C("event_id").alias("position"))
    return relations.active_duplicates(timeline)


def cell_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix cell for each part, its facts made from the key and the size."""
    k, s = C("p_partkey"), C("p_size")
    facts = table(spark, sf_dir, "part").select(
        "p_partkey", (k % 50 != 0).alias("service_on"), (k % 11 == 0).alias("blocked"), (k % 13 == 0).alias("not_planned"), (k % 3 != 0).alias("has_note"), (k % 7 != 0).alias("required_present"),
        F.when(k % 4 == 0, "nightly").when(k % 4 == 1, "beta").otherwise("release").alias("channel"), F.when(k % 5 == 1, "on").when(k % 5 == 2, "off").when(k % 5 == 3, "missing").when(k % 5 == 4, "unknown").alias("flag"),
        (s % 2 == 0).alias("opt_in"), F.when(s % 3 == 0, True).when(s % 3 == 1, False).alias("built"), ((k % 3 != 0) & (k % 2 == 0)).alias("note_here"), (s > 10).alias("built_defined"), (k % 17 != 0).alias("tagged"),
    )
    return facts.select("p_partkey", status.cell_state().alias("state"))


def work_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage of each order by its lines, as of a work group."""
    lines = _lines(spark, sf_dir)
    some = lambda test: F.bool_or(test)
    facts = lines.groupBy("l_orderkey").agg(
        some((C("l_linenumber") == 7) & (C("flag") == "R")).alias("duplicate"), some((C("l_linenumber") == 6) & (C("flag") == "A")).alias("contradictory"), F.lit(None).cast("boolean").alias("not_planned"),
        some(C("shipmode") == "REG AIR").alias("has_note"), some(F.when(C("line_status") == "F", C("shipmode") == "AIR")).alias("in_release"), some(C("shipmode") == "MAIL").alias("in_beta"), some(C("shipmode") == "SHIP").alias("in_nightly"),
        some(C("flag") == "A").alias("merged"), F.bool_and(C("shipmode") == "RAIL").alias("service_only"), some(C("shipmode") == "FOB").alias("open_pr"), F.bool_and(C("line_status") == "F").alias("issue_closed"), (F.max("l_linenumber") == 1).alias("pr_led"),
    )
    return facts.select("l_orderkey", status.stage().alias("stage"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five entities, each needing the one before, in every brand; states and dates from counts."""
    n = table(spark, sf_dir, "part").groupBy(C("p_brand").alias("place"), F.least(F.floor(C("p_size") / 10), F.lit(4)).cast("int").alias("entity")).agg(F.sum("p_partkey").alias("n"))
    state = F.element_at(F.array(*[F.lit(s) for s in status.RANKS]), (C("n") % 9 + 1).cast("int"))
    return n.select("entity", "place", state.alias("state"), F.when(state == "available", (C("n") % 20).cast("int")).alias("since"), (C("n") % 4 == 0).alias("contrary"), (C("n") % 6 == 0).alias("pending"))


def _needs(cells: DataFrame) -> DataFrame:
    return cells.select("entity").distinct().filter("entity > 0").withColumn("needed", C("entity") - 1)


def lifted_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    return matrix.lift(cells, _needs(cells)).select("entity", "place", "state", "since", "implied_by")


def capped_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    return matrix.cap_states(cells.select("entity", "place", "state", "since"), _needs(cells))


def conditional_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part needs the first of its size, if a probe finds the need in its version (its container); parts of a size
    share a place."""
    parts = table(spark, sf_dir, "part")
    state = F.element_at(F.array(*[F.lit(s) for s in status.RANKS]), (C("p_partkey") % 9 + 1).cast("int"))
    cells = parts.select(C("p_partkey").alias("entity"), C("p_size").alias("place"), (C("p_partkey") % 8).alias("version"), state.alias("state"))
    needs = parts.groupBy("p_size").agg(F.min("p_partkey").alias("needed")).join(parts.select("p_size", C("p_partkey").alias("entity"), (C("p_partkey") % 5).alias("probe")), "p_size").filter("entity <> needed").select("entity", "needed", "probe")
    probes = cells.select((C("entity") % 5).alias("probe"), "version").distinct().filter((C("probe") + C("version")) % 3 != 0).withColumn("present", (C("probe") + C("version")) % 3 == 1)
    return matrix.cap_if(cells, needs, probes)


def unknown_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts need the part of half their number; every 97th has a switch that could not be read."""
    parts = table(spark, sf_dir, "part")
    state = F.element_at(F.array(*[F.lit(s) for s in status.RANKS]), (C("p_partkey") % 9 + 1).cast("int"))
    cells = parts.select(C("p_partkey").alias("entity"), C("p_brand").alias("place"), state.alias("state"))
    needs = parts.filter("p_partkey > 1").select(C("p_partkey").alias("entity"), F.floor(C("p_partkey") / 2).cast("long").alias("needed"))
    switches = parts.filter("p_partkey % 97 = 5").select(C("p_partkey").alias("entity"), F.when(C("p_partkey") % 2 == 0, True).alias("on"))
    return matrix.apply_unknown_switch(cells, switches, needs)


def limited_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that decides a cell, its own or that of the cell that limits it, up to five links on."""
    cells = _cells(spark, sf_dir)
    cells = cells.select("entity", "place", "state", F.when((C("entity") > 0) & C("state").isin("absent", "off", "in-build", "available"), C("entity") - 1).alias("limited_by"))
    parts = table(spark, sf_dir, "part")
    evidence = parts.select(F.least(F.floor(C("p_size") / 10), F.lit(4)).cast("int").alias("entity"), C("p_brand").alias("place"), F.substring_index("p_type", " ", -1).alias("kind"), F.concat_ws(" ", "p_name", "p_partkey").alias("text"))
    priority = parts.select(F.substring_index("p_type", " ", -1).alias("kind")).distinct().crossJoin(cells.select("state").distinct()).withColumn("place_in_order", F.when(C("kind") == "STEEL", 0).otherwise(F.length("kind") + F.length("state") % 3))
    return matrix.deciding_evidence(cells, evidence, priority)


def channel_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a beta or nightly ranks above the release: customers' orders, channels by priority."""
    o = table(spark, sf_dir, "orders")
    channel = F.when(C("o_orderpriority") == "1-URGENT", "nightly").when(C("o_orderpriority") == "2-HIGH", "beta").otherwise("release")
    cells = o.select(C("o_custkey").alias("entity"), (C("o_orderkey") % 3).alias("platform"), channel.alias("channel"), C("o_orderstatus").alias("state"))
    return matrix.coming_next(cells, {"F": 3, "O": 2, "P": 1})


def fix_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The furthest channel on each platform in which an order's lines are included."""
    builds = _lines(spark, sf_dir).select(C("l_orderkey").alias("group_id"), (C("suppkey") % 3).alias("platform"), F.when(C("shipmode") == "AIR", "release").when(C("shipmode") == "MAIL", "beta").otherwise("nightly").alias("channel"), F.when(C("flag") == "R", True).when(C("flag") == "A", False).alias("included"))
    return matrix.fix_facts(builds, ["release", "beta", "nightly"]).select("group_id", "fixed", F.explode_outer("furthest").alias("platform", "channel"))


def build_inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence of orders' lines in builds (regions as lines of versions), by bounds and carriers."""
    lines = saved(_lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "flag", "suppkey", "partkey"), "lines")
    pulls = lines.select(C("l_orderkey").alias("group_id"), (C("l_orderkey") * 10 + C("l_linenumber")).alias("id"), (C("l_linenumber") == 3).alias("on_feature_branch"))
    carriers = lines.filter("l_linenumber = 3 AND flag = 'R'").select((C("l_orderkey") * 10 + 3).alias("id"), (C("l_orderkey") * 10 + 4).alias("carrier"))
    bounds = lines.filter("flag <> 'N'").select((C("l_orderkey") * 10 + C("l_linenumber")).alias("id"), (C("suppkey") % 2).alias("line"), F.when(C("flag") == "R", C("partkey") % 5).alias("low"), F.when(C("flag") == "A", C("partkey") % 5).alias("high"))
    builds = table(spark, sf_dir, "region").select(C("r_regionkey").alias("build_id"), (C("r_regionkey") % 2).cast("long").alias("line"), C("r_regionkey").cast("long").alias("version"))
    return matrix.build_verdicts(pulls, dealt(bounds, lines.count(), "id"), carriers, builds)


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = C("p_partkey")
    rows = table(spark, sf_dir, "part").select((k % 4).alias("snapshot"), C("p_brand").alias("name"), F.concat_ws(".", "p_size", F.lit("0"), k % 3).alias("version"), F.when(k % 5 == 0, None).otherwise(k % 5 != 1).alias("reachable"))
    return exposure.linked_versions(rows)


def advisory_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advisories, one a type and brand of part, against the versions (sizes) of brands in four snapshots, of which a fifth
    build has none."""
    ranges = table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.min("p_size").alias("low"), F.count(F.lit(1)).alias("n"))
    ranges = ranges.select(F.concat_ws("|", "p_type", "p_brand").alias("advisory_id"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("package"), F.when(C("low") % 7 == 0, "all versions").otherwise(F.concat(F.lit(">= "), C("low"), F.lit(", < "), C("low") + 4)).alias("range"), (C("low") % 5 != 0).alias("checkable"))
    linked = _linked(spark, sf_dir).withColumn("name", F.replace("name", F.lit("#"), F.lit("-")))
    exposed = exposure.exposure(ranges.select("advisory_id", "package", "range"), linked)
    builds = table(spark, sf_dir, "region").select(C("r_regionkey").alias("build_id"), F.when(C("r_regionkey") < 4, C("r_regionkey").cast("long")).alias("snapshot"), (C("r_regionkey") == 0).alias("main"))
    builds = builds.filter("snapshot IS NOT NULL")
    return exposure.advisory_verdict(ranges.select("advisory_id", "checkable"), exposed, builds)


def adopted_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest version surely linked of each brand and snapshot, and whether 40 or more was adopted."""
    found = exposure.adopted(exposure.resolved_version(_linked(spark, sf_dir), version_key), "40", version_key)
    return found.select("snapshot", "name", "highest", F.size("versions").alias("n_versions"), F.size("possible").alias("n_possible"), "adopted")


def proven_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers absent from orders: proven only where the order's list of suppliers is whole."""
    lines, orders = _lines(spark, sf_dir), table(spark, sf_dir, "orders")
    names = lines.filter("flag <> 'A'").select(C("l_orderkey").alias("snapshot"), C("suppkey").alias("name"))
    covers = exposure.list_covers(lines.filter("l_linenumber <= 2").select(C("l_orderkey").alias("snapshot"), C("suppkey").alias("name")), names)
    lists = orders.select(C("o_orderkey").alias("snapshot"), (C("o_orderstatus") != "P").alias("complete"), (C("o_orderkey") % 9 == 0).alias("ambiguous")).join(covers, "snapshot", "left").select("snapshot", "complete", F.coalesce("usable", F.lit(True)).alias("consistent"), "ambiguous")
    wanted = orders.select(C("o_orderkey").alias("snapshot"), (C("o_orderkey") % 10 + 1).alias("name"))
    return exposure.proven_absent(wanted, names, lists)


def merged_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tax a part, unknown where lines disagree."""
    return exposure.merge_declarations(table(spark, sf_dir, "lineitem").select("l_partkey", F.when(C("l_linenumber") < 6, C("l_tax")).alias("mode")), ["l_partkey"], "mode")


def lowest_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest version of each brand, carried values without a publication put aside where others were read."""
    k = C("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_brand", F.concat_ws("-", "p_name", k).alias("pointer"), F.when(k % 6 != 0, F.concat_ws(".", "p_size", k % 20)).alias("version"), (k % 2 == 0).alias("carried"), (k % 4 == 0).alias("not_published"))
    return exposure.lowest_version(rows, ["p_brand"], version_key)


def cohort_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' buckets as studies, event types as cohorts: what they set, and with what share."""
    w = table(spark, sf_dir, "events").groupBy((C("user_id") % 10).alias("study"), C("event_type").alias("cohort")).agg(F.count(F.lit(1)).alias("weight"))
    settings = F.create_map(F.lit("same"), F.lit("x"), F.lit("half"), F.when(C("weight") % 2 == 0, "y").otherwise("z"), F.when(C("cohort") == "click", "clicks").otherwise("rest"), F.lit("v"))
    return trials.cohort_settings(w.withColumn("settings", settings))


def trial_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as studies against builds of three systems: what applies, and which clauses decide."""
    k = C("n_nationkey")
    studies = table(spark, sf_dir, "nation").select(C("n_name").alias("study"), F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("platform").alias("key"), F.when(k % 2 == 0, '["Linux", "windows"]').when(k % 5 != 1, "macos").alias("value")), F.struct(F.lit("channel").alias("key"), F.when(k % 3 == 0, "release").alias("value")),
        F.struct(F.lit("min_version").alias("key"), F.concat(k.cast("string"), F.lit(".*")).alias("value")), F.struct(F.lit("country").alias("key"), F.when(k % 7 == 0, "de").alias("value"))), lambda x: x["value"].isNotNull())).alias("filter"))
    builds = table(spark, sf_dir, "region").select(C("r_regionkey").alias("build_id"), F.element_at(F.array(F.lit("linux"), F.lit("macos"), F.lit("windows")), (C("r_regionkey") % 3 + 1).cast("int")).alias("platform"), F.when(C("r_regionkey") < 3, "release").otherwise("beta").alias("channel"), F.concat(C("r_regionkey") * 5, F.lit(".1")).alias("version"))
    verdicts = trials.study_verdicts(trials.applicability(studies, builds, _at("2024-01-01 00:00:00")))
    return trials.merge_reasons(verdicts, builds)


def typed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of orders as issues and of lines as pull requests, in the window of a year."""
    orders, lines = table(spark, sf_dir, "orders"), _lines(spark, sf_dir)
    now = _at("1998-06-01 00:00:00")
    issues = orders.select(C("o_orderkey").cast("string").alias("id"), C("o_orderpriority").alias("title"), C("o_orderdate").alias("created_at"), F.when(C("o_orderstatus") == "P", "mention").otherwise("direct").alias("relevance"))
    kinds = F.when(C("flag") == "R", "closed").when(C("flag") == "A", "reopened").otherwise("labeled")
    timeline = lines.select(C("l_orderkey").cast("string").alias("id"), kinds.alias("type"), F.when(kinds == "labeled", F.when(C("l_linenumber") % 2 == 0, "QA Pass - Linux").when(C("l_linenumber") == 1, "Regression").otherwise("other")).alias("label"), C("shipdate").alias("at"))
    pulls = lines.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("id"), C("shipmode").alias("title"), F.when(C("flag") == "R", "merged").when(C("flag") == "A", "closed").otherwise("open").alias("state"), (C("l_linenumber") == 4).alias("is_draft"), (C("l_linenumber") >= 5).alias("is_uplift"), F.when(C("flag") == "R", C("shipdate")).alias("merged_at"), C("shipdate").alias("closed_at"), F.lit("direct").alias("relevance"))
    found = ev.all_events([ev.issue_events(issues, timeline), ev.pull_events(pulls)], now)
    return found.select("id", "kind", "key", "source_at", "title", "refresh_only")


def _facts(spark: SparkSession, sf_dir: str, last: str) -> DataFrame:
    """A snapshot of orders up to a day: what is built, the flag, and the documents of each customer."""
    o = table(spark, sf_dir, "orders").filter(C("o_orderdate") < _at(last)).groupBy("o_custkey").agg(F.count_if(C("o_orderstatus") == "F").alias("done"), F.count(F.lit(1)).alias("n"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))
    built = o.select(C("o_custkey").alias("entity"), F.lit("built").alias("cell"), F.when(C("n") % 5 != 0, C("done") * 2 > C("n")).alias("value"))
    flag = o.select(C("o_custkey").alias("entity"), F.lit("flag").alias("cell"), F.when(C("status") != "P", C("status")).alias("value"))
    doc = o.select(C("o_custkey").alias("entity"), F.lit("hash").alias("cell"), (C("n") % 3).alias("value"))
    study = o.filter("n > 8").select(C("o_custkey").alias("entity"), F.lit("study").alias("cell"), F.lit("new").alias("value"))
    return ev.build_snapshot({"build": built, "flag": flag, "doc": doc, "study": study})


def snapshot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = _at("1998-01-01 00:00:00")
    return ev.diff_events(_facts(spark, sf_dir, "1997-01-01 00:00:00"), _facts(spark, sf_dir, "1998-01-01 00:00:00"), now).select("id", "kind", "key", "title")


def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.snapshot_diff(_facts(spark, sf_dir, "1997-01-01 00:00:00"), _facts(spark, sf_dir, "1998-01-01 00:00:00"))


def _detected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").filter("event_type IN ('error', 'signup')")
    e = e.select(history.content_id(C("event_type"), C("event_id").cast("string")).alias("id"), C("event_type").alias("kind"), C("ts").alias("source_at"), C("event_id").alias("n"))
    run = _at("2024-01-10 00:00:00")
    kept = e.filter((C("source_at") < run) & (C("n") % 5 != 0)).select("id", "kind", "source_at", run.alias("detected_at"), F.lit("backfill").alias("basis"), F.lit("old").alias("title"), (C("n") % 4 == 0).alias("diff_only"), (C("n") % 2 == 0).alias("inputs_read"), (C("n") % 6 == 0).alias("rules_outdated"))
    found = e.filter((C("source_at") < _at("2024-01-20 00:00:00")) & (C("n") % 3 != 0)).select("id", "kind", "source_at", F.lit("new").alias("title"), (C("n") % 8 == 1).alias("refresh_only"), (C("n") % 4 == 0).alias("diff_only"))
    return e, kept, found


def merged_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rebuild of the history: first detections kept, texts renewed, what was read and not found again gone."""
    e, kept, found = _detected(spark, sf_dir)
    dropped = e.filter("n % 10 = 5").select("id", _at("2024-01-02 00:00:00").alias("detected_at"), F.lit("observed").alias("basis"))
    return history.merge_history(kept, found, e.filter("n % 17 = 0").select("id"), dropped, _at("2024-01-20 00:00:00"), _at("2024-01-10 00:00:00"), True)


def dropped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of what a run dropped, with the first detection of each."""
    e, kept, found = _detected(spark, sf_dir)
    old = e.filter("n % 7 = 0").select("id", _at("2024-01-03 00:00:00").alias("detected_at"), F.lit("observed").alias("basis"), "source_at")
    return ev.dropped_ledger(kept, found, old, _at("2024-01-20 00:00:00"))


def carried_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by market segment as fields: a partial read, what is carried and what is dropped."""
    rows = table(spark, sf_dir, "customer").select(C("c_mktsegment").alias("field"), C("c_custkey").alias("key"), C("c_nationkey").alias("value"))
    fresh = rows.filter("key % 3 <> 0").unionByName(rows.filter("key % 15 = 0").withColumn("field", F.lit("MOVED")))
    stored, dropped = merge.carry_fields(rows, fresh, rows.filter("key % 7 = 0"), ["BUILDING", "MACHINERY"])
    return stored.withColumn("fate", F.lit("stored")).unionByName(dropped.withColumn("fate", F.lit("dropped")))


def archived_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text changed, that were removed, or that matched no more, for the archive."""
    docs = table(spark, sf_dir, "documents").select(C("doc_id").alias("id"), F.md5(C("text").cast("binary")).alias("hash"))
    fresh = docs.filter("id % 4 <> 3").withColumn("hash", F.when(C("id") % 5 == 0, F.md5(C("hash").cast("binary"))).otherwise(C("hash"))).withColumn("matches", C("id") % 6 != 0)
    return merge.archive_versions(docs, fresh, docs.filter("id % 8 = 3").select("id"))


def upstream_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an index and lines as a feed of releases, dates filled in from what was known."""
    o = table(spark, sf_dir, "orders")
    index = o.select(C("o_custkey").alias("package"), C("o_orderkey").alias("version"), F.when(C("o_orderkey") % 4 != 0, C("o_orderdate")).alias("published_at"), (C("o_orderstatus") == "P").alias("yanked"))
    feed = index.filter("version % 3 = 0").withColumn("published_at", F.when(C("version") % 2 == 0, C("published_at")))
    previous = o.filter("o_orderkey % 8 = 0").select(C("o_custkey").alias("package"), C("o_orderkey").alias("version"), C("o_orderdate").alias("published_at"))
    return shaping.flatten_upstream(index, feed, previous)


def source_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns in documents: languages are candidate files, English before French; the first line that matches."""
    texts = table(spark, sf_dir, "documents").select(C("source").alias("ref"), C("lang").alias("file"), "doc_id", "text")
    first = texts.groupBy("ref", "file").agg(F.min_by("text", "doc_id").alias("text"))
    nations = table(spark, sf_dir, "nation").limit(1)  # a row to make the rule table from
    rules = nations.select(F.explode(F.array(*[F.struct(F.lit(i).alias("check_id"), F.lit(p).alias("pattern"), F.lit(f).alias("file"), F.lit(r).alias("file_rank")) for i, p, f, r in _CHECKS])).alias("r")).select("r.*")
    return it.probe(first, rules, "rules-1").drop("signature")


_CHECKS = [("license", "[Ll]icense", "en", 0), ("license", "[Ll]icense", "fr", 1), ("mail", "@", "fr", 0), ("mail", "@", "en", 1), ("none", "x", "xx", 0)]


def group_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets of orders as groups: state of the work, earliest merge, owners, flags."""
    lines = _lines(spark, sf_dir)
    members = lines.select(C("l_orderkey").alias("group_id"), F.when(C("l_linenumber") == 1, "lead").when(C("l_linenumber") == 7, "mention").otherwise("pr").alias("role"), F.when(C("l_linenumber") == 1, "issue").otherwise("pr").alias("kind"),
        F.when(C("flag") == "R", "merged").when(C("flag") == "A", "closed").otherwise("open").alias("state"), (C("suppkey") % 2 == 0).alias("is_draft"), C("shipdate").alias("merged_at"), C("shipdate").alias("updated_at"), F.array(C("shipmode")).alias("assignees"), C("suppkey").cast("string").alias("author"),
        F.array(F.when(C("partkey") % 9 == 0, "Regression").otherwise("other")).alias("labels"), F.array(C("shipmode")).alias("platforms"), F.when(C("partkey") % 2 == 0, "mention").otherwise("linked").alias("relevance"))
    out = relations.group_facets(members)
    return out.select("group_id", "implementation", "merged_at", "last_updated", F.array_join("owners", ",").alias("owners"), F.size("authors").alias("n_authors"), "regression", "security", "relevance")


def discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts found by three channels, with the channels."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    found = relations.discover({"large": parts.filter("p_size > 30").select(C("p_partkey").alias("id")), "returned": lines.filter("l_returnflag = 'R'").select(C("l_partkey").alias("id")), "many": lines.filter("l_quantity > 45").select(C("l_partkey").alias("id"))})
    return found.select("id", F.array_join("tags", ",").alias("tags"))


def topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and open orders of every customer, those without any too."""
    o = table(spark, sf_dir, "orders").groupBy(C("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("total"), F.count_if(C("o_orderstatus") == "O").alias("open"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").fillna(0, ["total", "open"])


QUERIES = {
    f.__name__: f
    for f in (
        item_groups, marked_duplicates, cell_decisions, work_stages, lifted_cells, capped_cells, conditional_caps, unknown_switches, limited_evidence, channel_leads, fix_presence, build_inclusion, advisory_exposure,
        adopted_versions, proven_absence, merged_declarations, lowest_pointer, cohort_agreement, trial_reasons, typed_events, snapshot_events, snapshot_changes, merged_history, dropped_events, carried_fields,
        archived_versions, upstream_releases, source_probes, group_rollup, discovered, topic_counts,
    )
}
