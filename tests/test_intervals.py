"""Ranges against versions through blocks, and as every pair says."""

import random

from pyspark.sql import functions as F

from factloom.functions import versions
from factloom.functions.kleene import kleene_any
from factloom.functions.parse import name_key
from factloom.operators import exposure, intervals


def by_pairs(ranges, linked):
    met = ranges.withColumn("name", name_key(F.col("package"))).join(linked, "name")
    inside = versions.satisfies_range(F.col("version"), F.col("range"))
    verdict = F.when(F.coalesce(~inside, F.lit(False)), False).when(F.col("linked").isNotNull() & ~F.col("linked"), False).otherwise(inside & F.col("linked"))
    return met.select("advisory_id", "snapshot", verdict.alias("v")).groupBy("advisory_id", "snapshot").agg(kleene_any(F.col("v")).alias("affected"))


def test_exposure_equals_all_pairs(spark):
    rng = random.Random(3)
    version = lambda: rng.choice(["{a}.{b}.{c}", "v{a}.{b}", "{a}", "0{a}.{b}.0", "{a}.{b}.{c}-rc", "?"]).format(a=rng.randrange(4), b=rng.randrange(12), c=rng.randrange(3))
    bound = lambda: rng.choice([">= ", "> ", "< ", "<= ", "= ", "==", ""]) + version()
    ranges = [(f"a{i}", rng.choice(["hot", "hot", "Other_Name", "none"]), ", ".join(bound() for _ in range(rng.choice([1, 1, 2, 2, 3])))) for i in range(250)]
    ranges += [("n", "hot", None), ("e", "hot", ""), ("c", "hot", " , "), ("x", "hot", "all versions"), ("p", None, "< 2"), ("a0", "hot", "> 1"), ("a0", "hot", "> 1")]
    linked = [(rng.randrange(150), rng.choice(["hot", "hot", "hot", "other-name"]), version(), rng.choice([True, False, None])) for _ in range(500)]
    a = spark.createDataFrame(ranges, "advisory_id string, package string, range string")
    b = spark.createDataFrame(linked, "snapshot int, name string, version string, linked boolean")
    want = {(r.advisory_id, r.snapshot): r.affected for r in by_pairs(a, b).collect()}
    got = exposure.exposure(a, b).collect()
    assert len(got) == len(want) and {(r.advisory_id, r.snapshot): r.affected for r in got} == want
    assert {True, False, None} <= set(want.values())
    assert exposure.exposure(a.limit(0), b).count() == exposure.exposure(a, b.limit(0)).count() == 0


def test_order_of_bytes_is_that_of_keys(spark):
    some = ["0", "0.0", "1", "1.0", "01.2", "1.2", "1.10", "1.9", "10", "2.0.0.1", "99999999999999999999", "1.2.3", "v3"]
    table = spark.createDataFrame([(x, y) for x in some for y in some], "x string, y string")
    by = lambda f: (f(F.col("x")) < f(F.col("y"))).alias(f.__name__)
    assert all(r[0] == r[1] for r in table.select(by(versions.version_key), by(versions.version_bytes)).collect())
    assert spark.range(1).select(versions.version_bytes(F.lit("1.a")).alias("v")).first().v is None


def test_blocks_cover_an_interval_once(spark):
    table = spark.createDataFrame([(a, b) for a in range(20) for b in range(20)], "a long, b long")
    for r in table.select("a", "b", intervals.blocks_of(F.col("a"), F.col("b"), 6).alias("blocks")).collect():
        covered = [x for k, i in r.blocks for x in range(i << k, (i + 1) << k)]
        assert sorted(covered) == list(range(r.a, r.b)) and len(r.blocks) <= 12
