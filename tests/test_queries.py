"""Every query with SQL against DuckDB on the smallest tables, and operators on hand-made rows."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.functions import kleene, text, versions
from factloom.operators import graph, joins, merge
from factloom.plans import ALL_QUERIES, ALL_SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return connection


@pytest.mark.parametrize("name", sorted(ALL_SQL))
def test_query_equals_sql(spark, duck, name):
    found = ALL_QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    result = duck.execute(ALL_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(row[names.index(c)] for c in columns)) for row in result.fetchall())
    assert sorted(repr(tuple(row[c] for c in columns)) for row in found.collect()) == want


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_kleene_over_groups(spark):
    table = spark.createDataFrame([("t", True), ("t", None), ("u", None), ("u", False), ("f", False), ("n", None)], "k string, v boolean")
    got = {r.k: (r.any, r.all, r.built) for r in table.groupBy("k").agg(kleene.kleene_any(F.col("v")).alias("any"), kleene.kleene_all(F.col("v")).alias("all"), kleene.built(F.col("v")).alias("built")).collect()}
    assert got == {"t": (True, None, True), "u": (None, False, False), "f": (False, False, False), "n": (None, None, None)}


def test_version_orders(spark):
    listed = ["1.2", "1.9", "1.9.30", "1.10.2", "2", "02.1", "10.0.0.1"]
    table = spark.createDataFrame([(v,) for v in reversed(listed)], "v string")
    assert [r.v for r in table.orderBy(versions.version_key(F.col("v"))).collect()] == listed
    same = spark.sql("SELECT '1.2' a, '1.2.0' b").select((versions.version_key(F.col("a")) == versions.version_key(F.col("b"))).alias("x")).first().x
    assert same
    example = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0"]
    table = spark.createDataFrame([(v,) for v in reversed(example)], "v string")
    assert [r.v for r in table.orderBy(versions.semver_key(F.col("v"))).collect()] == example


def test_ledger_steps_fold_to_the_snapshot_form(spark):
    days = {1: ["a", "b"], 2: ["a"], 3: ["a", "c"], 4: ["b", "c"]}
    facts = spark.createDataFrame([(k, d) for d, ks in days.items() for k in ks], "k string, day int")
    ledger = spark.createDataFrame([], "k string, first_seen int, last_seen int, gone_since int")
    for day, keys in days.items():
        seen = spark.createDataFrame([(k,) for k in keys], "k string")
        ledger = merge.merge_evidence(ledger, seen, seen, ["k"], F.lit(day))
        ledger = spark.createDataFrame(ledger.collect(), ledger.schema)
    folded = merge.ledger_of_snapshots(facts, facts.select("day"), ["k"], "day")
    assert rows(ledger, "k", "first_seen", "last_seen") == rows(folded, "k", "first_seen", "last_seen")
    assert {r.k for r in ledger.filter("gone_since IS NOT NULL").collect()} == {r.k for r in folded.filter("gone_since IS NOT NULL").collect()} == {"a"}


def test_graphs_with_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)], "src long, dst long")
    assert rows(graph.closure(edges), "src", "dst", "depth") == [(1, 2, 1), (1, 3, 2), (1, 4, 3), (2, 1, 2), (2, 3, 1), (2, 4, 2), (3, 1, 1), (3, 2, 2), (3, 4, 1)]
    parents = spark.createDataFrame([(9, 8), (8, 7), (3, 1), (1, 2), (2, 3), (5, 3)], "node long, parent long")
    assert rows(graph.canonical(parents), "node", "root") == [(1, 1), (2, 1), (3, 1), (5, 1), (8, 7), (9, 7)]


def test_as_of_is_strict_and_breaks_ties_by_id(spark):
    left = spark.createDataFrame([("u", 1, 5), ("u", 2, 9), ("v", 3, 1)], "k string, id long, at int")
    right = spark.createDataFrame([("u", 20, 5), ("u", 31, 7), ("u", 30, 7)], "k string, rid long, t int")
    got = rows(joins.asof_forward(left, right.withColumnRenamed("t", "rt"), "k", "at", "rt", "rid").fillna(-1), "id", "next_id", "next_at")
    assert got == [(1, 30, 7), (2, -1, -1), (3, -1, -1)]


def test_references(spark):
    body = "Fixes #1234, see Owner/Repo#9 and https://host.org/a/b/issues/77 and x#999 #12; Closes: A/b#3 prefixes c/d#4 resolved <https://host.org/E/f/issues/5> fix https://host.org/g/h/pull/6"
    got = spark.createDataFrame([(body,)], "t string").select(text.extract_refs(F.col("t"), F.lit("Own/Def")).alias("r"), text.resolves_refs(F.col("t")).alias("c")).first()
    assert got.r == ["a/b#77", "e/f#5", "g/h#6", "owner/repo#9", "a/b#3", "c/d#4", "own/def#1234"] and got.c == ["a/b#3", "e/f#5"]


def test_partial_reads_lose_nothing(spark):
    before = spark.createDataFrame([(i, f"v{i}") for i in range(6)], "k long, v string")
    after = before.filter("k < 2")
    removed = before.filter("k = 5")
    fate = {r.k: r.fate for r in merge.carry_forward(before, after, removed, ["k"]).collect()}
    assert fate == {0: "in_next", 1: "in_next", 2: "carried", 3: "carried", 4: "carried", 5: "removed"}
