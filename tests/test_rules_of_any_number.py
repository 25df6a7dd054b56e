"""Rule tables of any size: no rule is lost, neither where they are broadcast nor where both sides are dealt out."""

import re

from pyspark.sql import functions as F

from factloom.operators import exposure, matrix, rule_index, trials
from factloom.sources import tables


def test_both_forms_of_pairing_lose_nothing(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(300)], "x int, t string")
    rules = spark.createDataFrame([(i, "p" * 50) for i in range(200)], "y int, p string")
    for most in (1 << 20, 2000):  # broadcast; dealt into several parts
        assert tables.paired(rows, rules, most=most).select("x", "y").distinct().count() == tables.paired(rows, rules, most=most).count() == 60_000
        found = tables.paired(rows, rules, F.col("x") % 100 == F.col("y"), most)
        assert sorted((r.x, r.y) for r in found.collect()) == [(x, x % 100) for x in range(300)] and found.columns == ["x", "t", "y", "p"]
    plan = tables.paired(rows, rules, most=2000)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_what_a_pattern_spells_out(spark):
    shown = {
        "license": [["license"]], r"\bLicen[sc]e\b": None, "(?i)Send Zec": [["send", "zec"]], "abc|defg+h": [["abc"], ["defg"]], "abc|de": None,
        r"v\d\.\d key": [["key"]], "ab": None, "abc?d": None, "x.*yyy": None, "^wallet.ready$": [["wallet", "ready"]], r"a\|bcd": [["bcd"]],
    }
    table = spark.createDataFrame([(p,) for p in shown], "p string")
    assert {r.p: r.runs for r in table.select("p", rule_index.spelled_out(F.col("p")).alias("runs")).collect()} == shown


def test_twenty_thousand_rules_give_all_matches(spark):
    texts = [(i, f"note {i}: Wallet{i * 41 % 20_000:05d} and more, é😀 {'the ' * (i % 5)}") for i in range(400)] + [(900, None), (901, ""), (902, "ab")]
    rules = [(f"r{i}", f"wallet{i:05d}" if i % 2 else f"(?i)wallet{i:05d}") for i in range(20_000)] + [("all", "(?i)the .*the"), ("class", "[ab]b"), ("none", None), ("either", "note 1:|note 22:")]
    found = rule_index.matching(spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame(rules, "rule_id string, pattern string"))
    by_code = {int(p[-5:]): (r, p) for r, p in rules[:20_000]}
    want = set()
    for i, text in texts:
        for r, p in [*[by_code[int(c)] for c in re.findall(r"allet(\d{5})", text or "")], *((r, p) for r, p in rules[20_000:] if p)]:
            if text is not None and re.search(p, text):
                want.add((i, r))
    got = [(r.text_id, r.rule_id) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) and {r for _, r in want} >= {"all", "class", "either"}


def test_rule_tables_beyond_any_cap(spark):
    rules = spark.createDataFrame([(i, f"word{i:05d}", "no" if i % 7 == 0 else None) for i in range(10_050)], "rule_id int, pattern string, exclude string")
    rows = spark.createDataFrame([(i, f"a word{i:05d} here" + (" no" if i % 14 == 0 else "")) for i in range(10_000, 10_050)], "n int, body string")
    found = matrix.rule_matches(rows, F.col("body"), rules)
    assert sorted((r.n, r.rule_id) for r in found.collect()) == [(i, i) for i in range(10_000, 10_050) if i % 14]
    notes = spark.createDataFrame([(1, "a word10049 here", []), (2, None, ["x#10048"]), (3, "no x#7", ["x#7"])], "note_id int, text string, refs array<string>")
    more = rules.withColumn("issues", F.array(F.concat(F.lit("x#"), F.col("rule_id").cast("string"))))
    assert sorted((r.note_id, r.rule_id) for r in matrix.note_matches(notes, more).collect()) == [(1, 10049), (2, 10048)]


def test_builds_and_terms_beyond_any_cap(spark):
    builds = spark.createDataFrame([(i, i, i > 10_040, "desktop", "release", f"1.{i}") for i in range(10_050)], "build_id int, snapshot int, main boolean, platform string, channel string, version string")
    advisories = spark.createDataFrame([("a", True), ("b", True)], "advisory_id string, checkable boolean")
    exposed = spark.createDataFrame([("a", 10_049, True)], "advisory_id string, snapshot int, affected boolean")
    found = {r.advisory_id: r.affected for r in exposure.advisory_verdict(advisories, exposed, builds.select("build_id", "snapshot", "main")).collect()}
    assert found == {"a": True, "b": False}
    studies = spark.createDataFrame([("s", {"min_version": '"1.10049"'})], "study string, filter map<string,string>")
    judged = trials.applicability(studies, builds.select("build_id", "platform", "channel", "version"), F.lit("2024-01-01").cast("timestamp"))
    assert [r.build_id for r in judged.filter("met").collect()] == [10_049] and judged.count() == 10_050
    terms = spark.createDataFrame([(f"crate{i:05d}",) for i in range(10_050)] + [("zk",)], "term string")
    packages = spark.createDataFrame([("lib-CRATE10049",)], "name string")
    mentions = spark.createDataFrame([("uses crate10048 for Zk proofs", True), (None, True)], "text string, complete boolean")
    told = exposure.adoption(terms, packages, mentions)
    assert sorted(r.term for r in told.filter("verdict = 'evidence'").collect()) == ["crate10048", "crate10049", "zk"] and told.count() == 10_051
    assert told.filter("verdict IS NULL").count() == 10_048
