"""Items, shaping, exposure, trials and groups on hand-made rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from factloom.functions import items, text, versions
from factloom.operators import events, exposure, graph, history, matrix, merge, queues, relations, status, trials
from factloom.plans import serve
from factloom.sources import envelopes, shaping

C = F.col


def one(spark, *columns, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} string" for n in names)).select(*columns).first()


def test_references_and_addresses(spark):
    r = one(spark, items.parse_item_id(C("a")).alias("p"), items.parse_item_id(C("b")).alias("q"), items.short_ref(C("a")).alias("s"), items.split_package(C("c")).alias("e"), items.is_package_name(C("d")).alias("n"), items.qa_platform(C("e")).alias("w"), a="own/x#12", b="x 12", c="NPM:left", d="a b", e="Win64")
    assert (r.p.repo, r.p.number, r.q, r.s, r.e.ecosystem, r.e.name, r.n, r.w) == ("own/x", 12, None, "x#12", "npm", "left", False, "desktop")
    r = one(spark, items.safe_url(C("a")).alias("a"), items.safe_url(C("b")).alias("b"), items.safe_target(C("c")).alias("c"), items.safe_target(C("d")).alias("d"), a="HTTPS://x.org/a?b=1", b="javascript:alert(1)", c="/p/1", d="//evil.org")
    assert tuple(r) == ("HTTPS://x.org/a?b=1", None, "/p/1", None)


def test_numeric_entities(spark):
    r = one(spark, items.decode_numeric(C("a")).alias("a"), a="x&#65;&#x1F600;&#xe9; &#0; &#xD800; &amp; &#99999999;")
    assert r.a == "xA\U0001f600é � � &amp; &#99999999;"


def test_ages_and_shares(spark):
    now = datetime(2024, 1, 2, 12)
    times = [datetime(2024, 1, 2, 12), datetime(2024, 1, 2, 11, 59), datetime(2024, 1, 2, 10), datetime(2023, 12, 31, 12), None]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, at timestamp")
    assert [r.a for r in table.orderBy("i").select(items.ago_text(C("at"), F.lit(now)).alias("a")).collect()] == ["just now", "1 minute ago", "2 hours ago", "2 days ago", None]
    assert one(spark, items.share_percent(F.lit(1), F.lit(3)).alias("a"), items.share_percent(F.lit(1), F.lit(0)).alias("b"), x="")[:] == ("33.33%", None)
    assert one(spark, items.excluded_reason(C("a"), "(?i)tracking", "wallet").alias("a"), items.excluded_reason(C("b"), "(?i)tracking", "wallet").alias("b"), a="Tracking all", b="Tracking wallet")[:] == ("meta issue", None)


def test_duplicates_said_in_comments(spark):
    rows = [("a", 1, 5, "Duplicate of #7"), ("a", 2, 5, "maybe a duplicate of #8"), ("a", 3, 5, "duplicate of #5"), ("b", 1, 6, "nothing"), ("c", 1, 9, "Closing in favour; duplicate in favor of own/x#4"), ("c", 2, 9, "A possible duplicate. duplicate of #3"), ("d", 1, 9, "not sure. It is a Duplicate with https://h.org/a/b/issues/8")]
    table = spark.createDataFrame(rows, "id string, position int, own long, text string")
    assert [(r.id, r.number) for r in items.duplicate_from_comments(table).orderBy("id").collect()] == [("a", 7), ("c", 4), ("d", 8)]


def test_notes_constants_and_rules(spark):
    texts = spark.createDataFrame([("f", "# x\n## v1.3.0\n- a\n## [1.2.9] now\nPIN = 'abc'\nPIN = 'abc'")], "file string, text string")
    assert [(r.nth, r.version) for r in items.note_versions(texts).orderBy("nth").collect()] == [(1, "1.3.0"), (2, "1.2.9")]
    assert [(r.name, r.value) for r in items.constants(texts, {"pin": "PIN = '([^']*)'"}).collect()] == [("pin", "abc")]
    rules = spark.createDataFrame([(1, "PIN", None), (2, "PIN", "abc")], "rule_id int, pattern string, exclude string")
    assert [r.rule_id for r in matrix.rule_matches(texts, C("text"), rules).collect()] == [1]


def test_private_references_are_removed(spark):
    raw = "see own/open#1, own/shut#2 and https://host.org/own/shut/issues/3 or https://host.org/own/open/pull/4; own/open-not#5; a@b.org"
    table = spark.createDataFrame([(raw, None)], "t string, n string")
    clean = text.redact_columns(table, ["t", "n"], ["own/open"]).first()
    assert clean.t == "see own/open#1, [private reference] and [private link] or https://host.org/own/open/pull/4; [private reference]; [mail]" and clean.n is None


def test_ranges(spark):
    cases = [("1.5", ">= 1.2, < 2", True), ("2.0", ">= 1.2, < 2", False), ("v1.2.0", "= 1.2", True), ("1.2", "1.3", False), ("1.0", ">= 1.2, odd", False), ("1.3", ">= 1.2, odd", None), ("x", "> 1", None), ("1", None, None), ("1", " ", None)]
    table = spark.createDataFrame([(i, v, r) for i, (v, r, _) in enumerate(cases)], "i int, v string, r string")
    got = [x.s for x in table.orderBy("i").select(versions.satisfies_range(C("v"), C("r")).alias("s")).collect()]
    assert got == [w for _, _, w in cases]
    inside = [("139.5", "139.*", "152.*", True), ("153", "139.1", "152.*", False), ("152.9.9", None, "152.*", True), ("odd", "1", "2", None)]
    table = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(inside)], "i int, v string, a string, b string")
    assert [x.s for x in table.orderBy("i").select(versions.in_version_range(C("v"), C("a"), C("b")).alias("s")).collect()] == [c[3] for c in inside]


def test_attribution_of_ranges(spark):
    rows = [("a", [("npm", "left"), ("npm", "left-pad")], ["left-pad < 2", "left >= 1"]), ("b", [("npm", "x"), ("pip", "y")], ["< 1", "< 2"]), ("c", [("npm", "z"), ("pip", "z")], ["z < 1"]), ("d", [("npm", "q")], ["< 1", "< 2"])]
    table = spark.createDataFrame(rows, "advisory_id string, packages array<struct<ecosystem:string,name:string>>, ranges array<string>")
    got = sorted((r.advisory_id, r.package or "", r.range) for r in exposure.attribute_ranges(table).collect())
    assert got == [("a", "left", ">= 1"), ("a", "left-pad", "< 2"), ("b", "x", "< 1"), ("b", "y", "< 2"), ("c", "", "z < 1"), ("d", "", "< 1"), ("d", "", "< 2")]


def test_exposure_is_three_valued(spark):
    ranges = spark.createDataFrame([("a", "Left_Pad", "< 2"), ("b", "right", "< 2"), ("c", "left-pad", "odd")], "advisory_id string, package string, range string")
    packages = spark.createDataFrame([(1, "left_pad", "1.0", True), (2, "left-pad", "3.0", True), (2, "left-pad", "1.0", None), (1, "right", "1.0", False)], "snapshot int, name string, version string, reachable boolean")
    found = exposure.exposure(ranges, exposure.linked_versions(packages))
    assert {(r.advisory_id, r.snapshot): r.affected for r in found.collect()} == {("a", 1): True, ("a", 2): None, ("b", 1): False, ("c", 1): None, ("c", 2): None}
    builds = spark.createDataFrame([(1, 1, False), (2, 2, False)], "build_id int, snapshot int, main boolean")
    advisories = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", True)], "advisory_id string, checkable boolean")
    got = {r.advisory_id: (r.affected, r.reasons) for r in exposure.advisory_verdict(advisories, found, builds).collect()}
    assert got == {"a": (True, []), "b": (False, []), "c": (None, ["not-checkable", "possibly-affected"]), "d": (False, [])}
    main = builds.withColumn("main", F.lit(True))
    assert {r.advisory_id: r.affected for r in exposure.advisory_verdict(advisories, found, main).collect()}["b"] is None


def test_server_methods_adoption_and_limits(spark):
    advisories = spark.createDataFrame([("s", "A crash in getTxOut and z_send_many"), ("t", "none")], "advisory_id string, summary string")
    methods = spark.createDataFrame([("get_tx_out",), ("zSendMany",), ("other",)], "name string")
    assert {r.advisory_id: (r.methods, r.affected) for r in exposure.server_exposure(advisories, methods).collect()} == {"s": (["get_tx_out", "zSendMany"], None), "t": ([], None)}
    terms = spark.createDataFrame([("left",), ("pad",), ("none",)], "term string")
    packages, mentions = spark.createDataFrame([("LeftPad",)], "name string"), spark.createDataFrame([("x", True), (None, True)], "text string, complete boolean")
    assert {r.term: r.verdict for r in exposure.adoption(terms, packages, mentions).collect()} == {"left": "evidence", "pad": "evidence", "none": None}
    assert {r.term: r.verdict for r in exposure.adoption(terms, packages, mentions.dropna()).collect()}["none"] == "none-found"
    own = spark.createDataFrame([("s", ["late", "late"])], "source_id string, limitations array<string>")
    assert sorted(r.text for r in exposure.limitations(own, spark.createDataFrame([("old schema",)], "text string")).collect()) == ["old schema", "s: late"]


def test_trial_builds_and_values(spark):
    pointers = spark.createDataFrame([("desktop", "release", "mac", "1.2", False), ("desktop", "release", "win", None, True), ("ios", "release", "ios", None, True)], "platform string, channel string, system string, version string, not_published boolean")
    platforms = spark.createDataFrame([("desktop", "release", "9"), ("android", "release", None), ("android", "beta", "1.4")], "platform string, channel string, version string")
    releases = spark.createDataFrame([("release", "1.2", "120"), ("release", "1.10", "121")], "channel string, version string, engine string")
    got = sorted((r.platform, r.channel, r.system or "", r.version or "", r.engine or "") for r in trials.trial_builds(pointers, platforms, releases).collect())
    assert got == [("android", "beta", "", "1.4", ""), ("android", "release", "", "1.10", "121"), ("desktop", "release", "mac", "1.2", "120"), ("ios", "release", "ios", "", "")]
    r = one(spark, trials.as_list(C("a")).alias("a"), trials.as_list(C("b")).alias("b"), trials.date_value(C("c")).alias("c"), trials.date_value(C("d")).alias("d"), trials.date_value(C("b")).alias("e"), a='["x","y"]', b="z", c="0", d="2024-01-02T00:00:00Z")
    assert (r.a, r.b, r.e) == (["x", "y"], ["z"], None) and (r.d - r.c).days == 19724
    notes = spark.createDataFrame([("1.2", "1.2.3", "ann", 1), ("1.2", "1.2.9", "ann", 2), ("1.2", "1.2.4", "eve", 3)], "marketing string, build string, author string, at int")
    wanted = spark.createDataFrame([("1.2",)], "marketing string")
    built = spark.createDataFrame([("1.2.3",), ("1.2.4",)], "version string")
    assert [r.build for r in trials.map_marketing_version(wanted, notes, built, ["ann"]).collect()] == ["1.2.3"]


def test_bookkeeping_is_checked_before_anything_is_written(spark):
    good = spark.createDataFrame([("s", "ok", 0, 2, 1)], "source_id string, outcome string, failures int, last_success_at int, last_complete_at int")
    assert shaping.validate_status(good).count() == 1
    with pytest.raises(ValueError, match="failures: 1.*repeated source_id: 1"):
        shaping.validate_status(good.union(good.withColumn("failures", F.lit(-1))))
    runs = spark.createDataFrame([("a", 1, 2, "success"), ("b", 2, 3, "failed")], "run_id string, started_at int, ended_at int, outcome string")
    new = spark.createDataFrame([("c", 3, None, "partial"), ("b", 2, 4, "success")], "run_id string, started_at int, ended_at int, outcome string")
    kept = shaping.validate_runs(shaping.append_run(runs, new, 2))
    assert sorted((r.run_id, r.outcome) for r in kept.collect()) == [("b", "success"), ("c", "partial")]
    with pytest.raises(ValueError, match="times: 1"):
        shaping.validate_runs(runs.withColumn("ended_at", F.when(C("run_id") == "a", 0).otherwise(9)))


class Plugin:
    schema, budget, carry_on_partial = 1, 10, []

    def __init__(self, id, depends_on):
        self.id, self.depends_on = id, depends_on

    def collect(self, spark, previous):
        return shaping.Collected({self.id: spark.range(1)})


def test_sources_run_after_what_they_need(spark):
    assert [s.id for s in shaping.in_order([Plugin("c", ["a", "b"]), Plugin("b", ["a"]), Plugin("a", [])])] == ["a", "b", "c"]
    with pytest.raises(ValueError, match="a, b"):
        shaping.in_order([Plugin("a", ["b"]), Plugin("b", ["a"])])
    assert Plugin("a", []).collect(spark, {}).data["a"].count() == 1


def test_advisories_and_topics(spark):
    schema = "advisory_id string, aliases array<string>, summary string, packages array<string>, published_at int, updated_at int"
    world = spark.createDataFrame([("a", ["x"], "far", ["p"], 1, 1), ("b", [], "only", ["q"], 1, 1)], schema)
    own = spark.createDataFrame([("a", ["y"], "near", ["p"], 2, 2)], schema)
    tree = spark.createDataFrame([("a", "adv/a.md")], "advisory_id string, path string")
    assert sorted((r.advisory_id, r.aliases, r.summary, r.path) for r in shaping.flatten_advisories(world, own, tree).collect()) == [("a", ["x", "y"], "near", "adv/a.md"), ("b", [], "only", None)]
    page = '{"topic_list":{"topics":[{"id":1,"title":"%s","created_at":"2024-01-01T00:00:00Z","last_posted_at":"2024-01-0%dT00:00:00Z","category_id":5,"tags":["b","a"]}]}}'
    pages = spark.createDataFrame([(1, page % ("old", 1)), (2, page % ("new", 2))], "page int, json string")
    details = spark.createDataFrame([(1, ["one", "two"])], "topic_id long, posts array<string>")
    r = shaping.flatten_topics(pages, details).collect()
    assert len(r) == 1 and (r[0].title, r[0].tags, r[0].text, r[0].last_post_at.day) == ("new", ["a", "b"], "one\n\ntwo", 2)
    manifest = spark.createDataFrame([("s", "r1", 1), ("s", "r2", 5), ("t", "r3", 9)], "source_id string, run_id string, retrieved_at int")
    assert [(r.source_id, r.run_id) for r in shaping.generation(manifest, F.lit(4)).collect()] == [("s", "r1")]


def test_roots_levels_and_walks(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (7, 8), (8, 7), (8, 6)], "parent long, child long")
    assert sorted((r.node, r.root) for r in graph.roots_of(edges).collect()) == [(2, 1), (3, 1), (3, 9), (6, 7), (8, 7)]
    needs = spark.createDataFrame([("c", "b"), ("b", "a"), ("c", "a")], "entity string, needed string")
    assert sorted((r.entity, r.level) for r in graph.levels(needs).collect()) == [("a", 0), ("b", 1), ("c", 2)]
    with pytest.raises(ValueError, match="cycle"):
        graph.levels(needs.union(spark.createDataFrame([("a", "c")], "entity string, needed string")))
    roots = spark.createDataFrame([(1,)], "node long")
    walked = graph.walk(spark.createDataFrame([(1, 2), (2, 1), (2, 3), (4, 5)], "src long, dst long"), roots)
    assert sorted((r.node, r.depth) for r in walked.collect()) == [(1, 0), (2, 1), (3, 2)]


def test_epics_links_and_orders(spark):
    rows = [("e", "issue", "All", ["Epic"], [], []), ("t", "issue", "Tracking: x", [], [], ["a", "b"]), ("u", "issue", "Tracking: y", [], [], ["a"]), ("s", "issue", "z", [], ["c"], ["c", "d"])]
    found = relations.epics(spark.createDataFrame(rows, "id string, kind string, title string, labels array<string>, sub_issues array<string>, listed array<string>"))
    assert sorted((r.id, r.children) for r in found.collect()) == [("e", []), ("s", ["c", "d"]), ("t", ["a", "b"])]
    topics = spark.createDataFrame([("e", "steel"), ("a", "other")], "id string, topic string")
    epic = spark.createDataFrame([("epic", "e", "a")], "kind string, src string, dst string")
    assert sorted((r.id, r.topic) for r in relations.inherit_topic(topics, epic).collect()) == [("a", "steel"), ("e", "steel")]
    links = spark.createDataFrame([("d", "n1", True, False), ("d", "n2", False, False), ("d", "n3", False, True), ("d", "k", True, False), ("x", "n4", True, False)], "src string, dst string, strong boolean, is_uplift_of boolean")
    direct, known = spark.createDataFrame([("d",)], "id string"), spark.createDataFrame([("k",)], "id string")
    assert [(r.id, r.strong) for r in relations.expand_links(direct, links, known, 600).collect()] == [("n1", True), ("n3", False)]
    assert [r.id for r in relations.expand_links(direct, links, known, 1).collect()] == ["n1"]
    work = spark.createDataFrame([("a", 1, 5, 9), ("b", 2, 4, 8)], "id string, number int, created_at int, updated_at int")
    assert [[r.id for r in relations.sort_work(work, m).collect()] for m in ("updated", "created", "number")] == [["a", "b"], ["a", "b"], ["b", "a"]]
    order = spark.createDataFrame([("b", "first", 1)], "id string, display string, place int")
    assert [(r.id, r.display) for r in relations.display_groups(work, order).orderBy("place", "id").collect()] == [("b", "first"), ("a", "more")]
    pulls = spark.createDataFrame([("p", "pr", "merged", "Flip switch", 3), ("q", "pr", "merged", "Flip switch", 5), ("r", "pr", "open", "Flip switch", 9)], "id string, kind string, state string, title string, merged_at int")
    assert [r.id for r in relations.latest_switch_change(pulls, "(?i)switch").collect()] == ["q"]
    ids = spark.createDataFrame([("b", 2, "b#2"), ("a", 10, "a#10"), ("a", 9, "a#9")], "repo string, number int, id string")
    assert ids.agg(relations.lowest_id(C("repo"), C("number"), C("id")).alias("x")).first().x == "a#9"


def test_groups_fold_cycles_and_cover_everything(spark):
    item = spark.createDataFrame([(1, "issue", False), (2, "issue", False), (3, "issue", False), (10, "pr", False), (11, "pr", True), (12, "pr", True), (20, "pr", False), (21, "pr", True), (30, "pr", True)], "id long, kind string, is_uplift boolean")
    edges = spark.createDataFrame([("resolves", 10, 2), ("uplift", 11, 10), ("uplift", 12, 11), ("uplift", 21, 20), ("mentions", 20, 1), ("mentions", 11, 1)], "kind string, src long, dst long")
    duplicates = spark.createDataFrame([(1, 2), (2, 1), (3, 99)], "id long, canonical long")
    got = sorted((r.group_id, r.item_id, r.role) for r in relations.groups(item, edges, duplicates).collect())
    assert got == [(1, 1, "lead"), (1, 2, "duplicate"), (1, 10, "pr"), (1, 11, "uplift"), (1, 12, "uplift"), (1, 20, "mention"), (3, 3, "lead"), (20, 20, "lead"), (20, 21, "uplift"), (30, 30, "lead")]


def test_unmarks_clear_both_ways(spark):
    rows = [(1, "marked_duplicate", 2, 1, 1), (2, "has_duplicate", 3, 5, 2), (3, "unmarked_duplicate", 2, 5, 3), (4, "marked_duplicate", 5, 1, 4), (5, "unmarked_duplicate", 4, 2, 5), (6, "marked_duplicate", 6, 1, 6)]
    found = relations.active_duplicates(spark.createDataFrame(rows, "id long, type string, ref long, at int, position int"))
    assert sorted((r.duplicate, r.canonical) for r in found.collect()) == [(1, 2)]


def test_carried_parts(spark):
    files = spark.createDataFrame([("hello\n", "ce013625030ba8dba906f756967f9e9ca394464a"), ("hello", "00"), (None, "00")], "content string, listed string").withColumn("content", C("content").cast("binary"))
    assert [(r.verified, r.content is None) for r in merge.verified(files).collect()] == [(True, False), (False, True), (False, True)]
    old = spark.createDataFrame([("r", "a", "1", 1), ("r", "b", "1", 1)], "ref string, component string, value string, read_at int")
    new = spark.createDataFrame([("r", "a", "2", 2), ("r", "b", None, 2)], "ref string, component string, value string, read_at int")
    assert sorted((r.component, r.value, r.read_at) for r in merge.carry_components(old, new).collect()) == [("a", "2", 2), ("b", "1", 1)]
    a, b = spark.createDataFrame([("x", 5), ("y", 1)], "key string, n int"), spark.createDataFrame([("x", 3), ("z", 1)], "key string, n int")
    assert sorted((r.key, r.n) for r in merge.grow_counts(a, b, True).collect()) == [("x", 5), ("y", 1), ("z", 1)]
    assert sorted((r.key, r.n) for r in merge.grow_counts(a, b, False).collect()) == [("x", 3), ("y", 1), ("z", 1)]
    listing = spark.createDataFrame([("d", "f", "1"), ("d", "g", "2"), ("e", "h", "1")], "dir string, name string, hash string")
    before = spark.createDataFrame([("d", "f", "1"), ("d", "g", "1"), ("e", "h", "1")], "dir string, name string, hash string")
    assert [(r.dir, r.name) for r in merge.pending_files(listing, before, "dir", "name").collect()] == [("d", "g")]


def test_held_parts_and_queues(spark):
    ledger = spark.createDataFrame([("a", "f", 1, 1, None), ("b", "g", 1, 1, None)], "k string, file string, first_seen int, last_seen int, gone_since int")
    none = ledger.select("k", "file").limit(0)
    out = merge.merge_with_hold(ledger, none, none, ["k", "file"], F.lit(2), spark.createDataFrame([("g",)], "file string"), "file")
    assert sorted((r.k, r.gone_since) for r in out.collect()) == [("a", 2), ("b", None)]
    before, batch = spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int")
    assert sorted((r.k, r.v) for r in queues.grow_set(before, batch, ["k"]).collect()) == [("a", 1), ("b", 3)]
    hits = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, page int, v string")
    assert [r.v for r in queues.dedupe_hits(hits, ["k"], "page").collect()] == ["y"]
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    done = spark.createDataFrame([("a", True, "s2"), ("b", True, "s1"), ("c", False, "s2")], "k string, complete boolean, signature string")
    assert sorted(r.k for r in queues.reuse_immutable(done, wanted, ["k"], "s2").collect()) == ["b", "c"]
    dated = spark.createDataFrame([("a", datetime(2024, 1, 1)), ("b", datetime(2023, 1, 1)), ("c", None)], "k string, at timestamp")
    assert sorted(r.k for r in queues.retain_days(dated, "at", F.lit(datetime(2024, 1, 10)), 30).collect()) == ["a", "c"]
    kept, removed = queues.retain_newest(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "k string, v int"), spark.createDataFrame([("a",)], "k string"), "k", C("v"), 1)
    assert (sorted(r.k for r in kept.collect()), sorted(r.k for r in removed.collect())) == (["a", "d"], ["b", "c"])


def test_status_helpers(spark):
    states = spark.createDataFrame([("g", "on"), ("g", None), ("h", "on"), ("i", "off"), ("i", "missing"), ("j", "off"), ("j", "unknown")], "k string, s string")
    assert {r.k: r.f for r in states.groupBy("k").agg(status.flag_state(C("s")).alias("f")).collect()} == {"g": "unknown", "h": "on", "i": "missing", "j": "off"}
    cells = spark.createDataFrame([("a", "p", "available"), ("b", "p", "absent")], "entity string, place string, state string")
    marked = status.demote_unknown(cells, spark.createDataFrame([("a",), ("b",)], "entity string"), ["entity"])
    assert sorted((r.entity, r.state, r.found) for r in marked.collect()) == [("a", "not-verified", "available"), ("b", "absent", "absent")]
    notes = [("1.2.3", "1.2.3", "within"), ("1.2.4", "1.2.3", "newer"), ("1.2.9", "1.2", "same-line"), ("1.1.9", "1.2", "within"), ("1.3.0", "1.2", "newer"), ("1.0.0", "soon", None)]
    table = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(notes)], "i int, a string, b string")
    assert [r.x for r in table.orderBy("i").select(status.note_bound(C("a"), C("b"), versions.version_key).alias("x")).collect()] == [n[2] for n in notes]
    outcomes = spark.createDataFrame([("r", "ok"), ("r", "failed"), ("s", "ok"), ("t", "failed")], "run string, o string")
    assert {r.run: r.x for r in outcomes.groupBy("run").agg(status.run_outcome(C("o")).alias("x")).collect()} == {"r": "partial", "s": "success", "t": "failed"}
    facts = spark.createDataFrame([(1, "old", "t1"), (2, "new", "t2")], "k int, fact string, tag string")
    assert [r.inferred for r in matrix.inferred_facts(spark.createDataFrame([("x", "t2")], "c string, inferred_tag string"), facts).collect()] == [["new"]]
    # a note that is newer than the build says nothing of it, though the work is in
    cell = spark.createDataFrame([("nightly", True, False, True), ("nightly", True, True, True), ("nightly", False, False, True)], "channel string, has_note boolean, note_here boolean, built boolean")
    for name in ("service_on", "required_present", "tagged"):
        cell = cell.withColumn(name, F.lit(True))
    for name in ("blocked", "not_planned", "opt_in", "built_defined"):
        cell = cell.withColumn(name, F.lit(False))
    assert [r.s for r in cell.withColumn("flag", F.lit(None).cast("string")).select(status.cell_state().alias("s")).collect()] == ["not-verified", "in-build", "in-build"]


def test_events_and_history_bounds(spark):
    now = datetime(2024, 2, 1)
    advisories = spark.createDataFrame([("a", "s", datetime(2020, 1, 1), datetime(2024, 1, 20), ["p"]), ("b", "s", datetime(2024, 1, 5), datetime(2024, 1, 20), ["p"])], "advisory_id string, summary string, published_at timestamp, updated_at timestamp, packages array<string>")
    assert sorted((r.key, r.source_at.day) for r in events.advisory_events(advisories, F.lit(datetime(2023, 2, 1))).collect()) == [("a", 20), ("b", 5)]
    releases = spark.createDataFrame([("p", "1", now, False), ("p", "2", now, True), ("q", "1", now, False)], "package string, version string, published_at timestamp, yanked boolean")
    assert [r.key for r in events.upstream_events(releases, spark.createDataFrame([("p",)], "package string")).collect()] == ["p@1"]
    topics = spark.createDataFrame([("t", "x", now, ["a#1"])], "topic_id string, title string, created_at timestamp, refs array<string>")
    assert [r.kind for r in events.community_events(topics).collect()] == ["community-report"]
    notes = spark.createDataFrame([("n", "1.2", "mac", "t", ["i"], False), ("m", "1.2", "mac", "t", ["x"], False), ("o", "9", "mac", "t", ["i"], True)], "note_id string, version string, platform string, text string, refs array<string>, topical boolean")
    dates = spark.createDataFrame([("1.2", now), ("9", None)], "version string, published_at timestamp")
    assert [r.key for r in events.release_events(notes, dates, spark.createDataFrame([("i",)], "id string")).collect()] == ["mac|1.2|n"]
    rows = spark.createDataFrame([("a", datetime(2024, 1, 1), now), ("b", datetime(2022, 1, 1), now), ("c", None, now)], "id string, source_at timestamp, detected_at timestamp")
    assert [r.id for r in history.bounded(rows, F.lit(now), 365, 2).collect()] == ["c", "a"]
    assert history.diff_allowed(spark.createDataFrame([(1,)], "rules_version int"), spark.createDataFrame([(1,)], "rules_version int"))
    assert not history.diff_allowed(spark.createDataFrame([(1,)], "rules_version int"), spark.createDataFrame([(2,)], "rules_version int"))


def test_served_lists(spark, tmp_path):
    topics = spark.createDataFrame([(1, "big wallet", ["a#1"]), (2, "wallet", []), (3, "other", None)], "id int, haystack string, refs array<string>")
    assert [[r.id for r in serve.report_list(topics, "wallet", linked).collect()] for linked in (None, True, False)] == [[1, 2], [1], [2]]
    facts = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "name string, value boolean")
    assert [r.readiness for r in serve.readiness(facts).orderBy("name").collect()] == ["yes", "no", "unknown"]
    events_ = spark.createDataFrame([("e", 1), ("f", 3)], "id string, detected_at int")
    assert [r.id for r in serve.new_since(events_, F.lit(2), False).collect()] == ["f"] and serve.new_since(events_, F.lit(2), True).count() == 0
    resolved = spark.createDataFrame([(1, "p", "2", True), (1, "q", "1", None)], "snapshot int, name string, highest string, adopted boolean")
    verdicts, ranges = spark.createDataFrame([("a", True), ("b", None)], "advisory_id string, affected boolean"), spark.createDataFrame([("a", "p"), ("b", "p")], "advisory_id string, package string")
    assert sorted((r.name, r.n_advisories, r.n_affecting) for r in serve.upstream_view(resolved, verdicts, ranges).collect()) == [("p", 2, 1), ("q", 0, 0)]
    envelopes.publish({"t": facts}, f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out/t").count() == 3
    (tmp_path / "a.txt").write_text("x\ny")
    assert [r.text for r in envelopes.read_texts(spark, f"file://{tmp_path}/a.txt").collect()] == ["x\ny"]
