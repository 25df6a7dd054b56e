"""Operator 11 against products of all pairs in Python's whole numbers, and its intervals against the true products."""

import math
import random

import numpy as np
import pytest

from factloom.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, rank int, score string, row int"


def plain(rows, positives=5, negatives=5):
    kept = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, (anchor, v, label) in enumerate(kept):
        if anchor % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, j != label) for b, (i, w, j) in enumerate(kept) if b != a)
        for s, i, _ in [x for x in scored if not x[2]][:positives]:
            fit = [(t, j) for t, j, other in scored if other and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(anchor, i, rank + 1, j, -s, -t) for rank, (t, j) in enumerate(fit[:negatives])]
    return sorted(out)


def got(spark, rows, **more):
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    found = hard_negatives.mine_embeddings(table, **more)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def near(rng, n, width=12):
    centres = [[rng.gauss(0, 0.3) for _ in range(width)] for _ in range(6)]
    return [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)], rng.randrange(10)) for i in range(n)]


def test_equals_products_of_all_pairs(spark):
    rng = random.Random(1)
    rows = near(rng, 900)
    rows += [(1000 + i, [0.25] * 12, i % 3) for i in range(300)]  # one vector and ties for a quarter of the rows
    rows += [rows[100], rows[100], rows[8], (200, rows[9][1], 4)]  # repeated anchors and rows, an id of two vectors
    rows += [(1400, None, 1), (1500, [0.1] * 12, None), (None, [0.1] * 12, 1), (1600, [math.nan] + [0.1] * 11, 1), (1700, [None] * 12, 1), (1800, [math.inf] * 12, 1)]
    rows += [(1900, [0.3] * 5, 2), (2000, [], 3), (2001, [0.3] * 16, 2), (2100, [0.0] * 12, 5)]  # other lengths, none at all, nothing but 0
    assert got(spark, rows) == plain(rows)


def test_blocks_of_anchors_change_nothing(spark):
    rows = near(random.Random(2), 800)
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    want = plain(rows)
    prepared = hard_negatives.mined
    try:
        hard_negatives.mined = lambda r, width: prepared(r, width, block=3)
        assert sorted(tuple(r) for r in hard_negatives.mine_embeddings(table).collect()) == want
    finally:
        hard_negatives.mined = prepared


def test_few_rows_and_none(spark):
    assert got(spark, []) == [] and got(spark, [(1, [0.5], 1), (2, [0.5], 1)]) == []
    rows = [(0, [0.5, 0.5], 1), (1, [0.5, 0.4], 2), (2, [0.5, 0.45], 2), (3, [-0.5, -0.5], 1)]
    assert got(spark, rows) == plain(rows)
    rows = [(100, [-0.5], 3), (1, [0.5], 3), (2, [0.4], 4)]  # negative scores admit no one
    assert got(spark, rows) == plain(rows) == []


@pytest.mark.parametrize("width", [1, 12, 64, 100])
def test_intervals_hold_the_products(width):
    rng = np.random.default_rng(width)
    whole = rng.integers(-400, 400, (300, width))
    whole[:5], whole[5] = 0, whole[6]
    rotation = hard_negatives.Rotation(width)
    words, align, rest = hard_negatives.encoded(rotation(whole))
    rows = hard_negatives.Rows.__new__(hard_negatives.Rows)
    rows.n, rows.words, rows.align, rows.rest = 300, words, align, rest
    rows.length = np.hypot(np.abs(align[:, 0]) * np.sqrt(rotation.width), rest[:, 0])
    queries = hard_negatives.Queries(whole, rotation)
    score = whole @ whole.T
    low, high = hard_negatives.first_interval(queries, np.arange(300), rows)
    assert (low <= score).all() and (score <= high).all()
    every = np.ones((300, 300), dtype=bool)
    low, high = hard_negatives.last_interval(queries, np.arange(300), rows, every)
    assert (low <= score).all() and (score <= high).all()
    few = np.eye(300, dtype=bool)
    a, b = hard_negatives.last_interval(queries, np.arange(300), rows, few)
    assert np.allclose(a[few], low[few]) and np.allclose(b[few], high[few]) and np.isinf(a[~few]).all() and np.isinf(b[~few]).all()
    assert np.median(high - low) < 0.12 * np.median(np.linalg.norm(whole, axis=1)) ** 2


def test_few_pairs_are_scored():
    rng = np.random.default_rng(5)
    whole = np.floor(256 * rng.normal(0, 0.125, (4000, 64))).astype(np.int64)
    label = rng.integers(0, 10, 4000)
    rotation = hard_negatives.Rotation(64)
    queries, best = hard_negatives.Queries(whole[:40], rotation), hard_negatives.Best(40, 5)
    for begin in range(0, 4000, 1000):
        rows = hard_negatives.Rows.__new__(hard_negatives.Rows)
        part = slice(begin, begin + 1000)
        rows.n, rows.row, rows.vec_id, rows.label, rows.whole = 1000, np.arange(4000)[part], np.arange(4000)[part], label[part], whole[part]
        rows.words, rows.align, rows.rest = hard_negatives.encoded(rotation(whole[part]))
        rows.length = np.linalg.norm(whole[part], axis=1)
        hard_negatives.meet(queries, rows, best, np.arange(40), lambda some, rows=rows: (label[some][:, None] == rows.label) & (some[:, None] != rows.row))
    score = whole[:40] @ whole.T
    for a in range(40):
        same = [i for i in range(4000) if label[i] == label[a] and i != a]
        assert sorted(same, key=lambda i: (-score[a, i], i))[:5] == best.vec_id[a].tolist()
    print(best.seen, best.opened, best.scored)
    assert best.scored < best.seen / 5
