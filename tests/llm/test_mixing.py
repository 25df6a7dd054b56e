"""Operator 13 against the same rules in plain Python."""

import hashlib
import math
import random
import re
from fractions import Fraction

from pyspark.sql import functions as F

from factloom.llm import common, mixing

SCHEMA = "doc_id long, text string, source string, size int, weight int, target string"


def plain(rows, most=3):
    words = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]
    has = {}
    for _, t, s in rows:
        has[s] = has.get(s, 0) + len(words(t))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(has, key=lambda s: (s is None, s or "")))}
    full, total = set(), sum(has.values())
    while True:
        rest, parts = total - most * sum(has[s] for s in full), sum(weight[s] for s in has if s not in full)
        more = {s for s in has if s not in full and weight[s] * rest > most * has[s] * parts}
        if not more:
            break
        full |= more
    target = {s: Fraction(most * has[s]) if s in full else Fraction(weight[s] * rest, parts or 1) for s in has}
    out = []
    for s in has:
        whole = math.floor(target[s] + Fraction(1, 2))
        epochs = whole // has[s] if has[s] else 0
        rest, keyed = whole - epochs * has[s], []
        for i, t, _ in (r for r in rows if r[2] == s):
            u = (int(hashlib.md5(f"mix-1:{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            n = len(words(t))
            keyed.append((-math.log(u) / ((len(set(words(t))) * 9 + n) / (n * 10) if n else 1.0), -1 if i is None else i, n))
        for _, i, n in sorted(keyed):
            part = max(0, min(n, rest))
            rest -= part
            out.append((i, n, has[s], round(float(target[s]), 6), epochs * n + part))
    return sorted(out)


def got(spark, rows, **more):
    table = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(3)
    found = mixing.mixed(table, **more).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in found)


def documents(seed):
    rng = random.Random(seed)
    some = lambda: " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(0, 30)))
    rows = [(i, some(), "hot" if i % 3 == 0 else f"s{rng.randrange(8)}") for i in range(400)]
    rows += [(900, None, None), (901, "a b", None), (None, "a  b\tc", "s1"), (902, "é ü x", "ß"), (903, "", "only empty"), (904, "w " * 50_000, "one long")]
    return rows + [rows[3], rows[3], (rows[4][0], "another text", rows[4][2])]


def test_equals_the_rules_and_keeps_the_laws(spark):
    rows = documents(1)
    found = got(spark, rows)
    assert found == plain(rows) == got(spark, rows[::-1])  # reruns and other orders agree
    assert all(taken <= 3 * n for _, n, _, _, taken in found)
    sums = mixing.mixed(spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(sums) == 13 and all(abs(r.taken - r.target) <= 0.5 for r in sums)
    assert got(spark, []) == []
    assert got(spark, [(1, None, "a"), (2, " ", None)]) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_targets_stop_at_what_a_source_can_give(spark):
    rows = [(i, "a b c", s) for i, s in enumerate(["a"] + ["b"] * 40 + ["c"] * 300)]
    found = {s: t for s, t in mixing.mixed(spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)).select("source", "target").distinct().collect()}
    assert found == {"a": 9.0, "b": 360.0, "c": 3 * 341 - 9 - 360}


def test_better_documents_come_first(spark):
    rows = [(i, f"w{i} " * 10, "ab"[i % 2]) for i in range(2000)]
    table = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    good = F.when(F.col("doc_id") < 1000, 3.0).otherwise(1.0)
    taken = mixing.mixed(table, weights=(1, 4), weight_of=good).filter("source = 'a' AND taken > 0")
    n = {r["g"]: r["n"] for r in taken.groupBy((F.col("doc_id") < 1000).alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n[True] > 1.5 * n[False]


def test_running_sums_of_one_key_lie_in_many_ranges(spark):
    rows = [(None if i % 5 else "k", i) for i in range(2000)]
    found = {r.i: r.upto for r in common.running_sums(spark.createDataFrame(rows, "k string, i long"), ["k"], ["i"], F.col("i"), "upto").collect()}
    upto = {"k": 0, None: 0}
    for k, i in rows:
        upto[k] += i
        assert found[i] == upto[k]
