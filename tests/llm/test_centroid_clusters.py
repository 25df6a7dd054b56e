"""Operator 12 against a plain search over all centroids in Python's whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from factloom.llm import centroid_clusters, vectors

SCHEMA = "vec_id long, embedding array<double>, cluster string, label int, distance int"


def plain(rows, k, rounds, width):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in first[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[i]) for x in zip(*groups[i], strict=True)] if i in groups else c for i, c in enumerate(centroids)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = {c: sum(d for _, x, d in found if x == c) for _, c, _ in found}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in found)


def got(spark, rows, k=7, rounds=3, width=8):
    table = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA)
    found = centroid_clusters.cluster_embeddings(table, k, rounds, width)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found.collect())


def test_equals_a_plain_search(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(150)]
    rows += [(200 + i, [0.5] * 8) for i in range(60)]  # one vector for a third of the rows
    rows += [(5, rows[5][1]), (6, rows[7][1]), (None, rows[9][1])]  # repeated rows, one id for two vectors, no id
    rows += [(300, None), (301, []), (302, [1.0] * 7), (303, [1.0] * 9), (304, [1.0] * 7 + [None]), (305, [1.0] * 7 + [math.nan]), (306, [1.0] * 7 + [-math.inf]), (307, [0.0] * 8)]
    assert got(spark, rows) == plain(rows, 7, 3, 8)


def test_few_rows_ties_and_none(spark):
    rows = [(i, [float(i % 2)] * 8) for i in range(5)]
    assert got(spark, rows) == plain(rows, 7, 3, 8)  # fewer rows than centroids, and equal centroids
    assert got(spark, []) == got(spark, [(1, None)]) == []


def test_large_components_stay_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice((-1, 1)) * rng.random() * 400_000 for _ in range(8)]) for i in range(40)]
    assert got(spark, rows) == plain(rows, 7, 3, 8)
    assert got(spark, [*rows, (99, [1e300] * 8)]) == plain(rows, 7, 3, 8)  # would not fit a long: left out


@pytest.mark.parametrize("width", [1, 3, 64])
def test_search_drops_only_what_is_strictly_worse(width):
    rng = np.random.default_rng(width)
    centers = rng.integers(-300, 300, (40, width))
    rows = np.concatenate([centers[rng.integers(0, 40, 2000)] + rng.integers(-40, 40, (2000, width)), centers, rng.integers(-2, 3, (100, width))])
    nearest = centroid_clusters.Nearest(centers)
    to, distance = nearest(rows)
    every = ((rows[:, None] - centers[None]) ** 2).sum(2)
    assert (to == every.argmin(1)).all() and (distance == every.min(1)).all()
    if width == 64:
        assert nearest.met < nearest.seen / 4
    basis = vectors.walsh_hadamard(np.eye(8, dtype=np.int64))
    assert (basis @ basis.T == 8 * np.eye(8)).all()
    slow = basis[:, centroid_clusters.coarse_to_fine(8)]
    assert ((np.diff(slow.T, axis=1) != 0).sum(1) == range(8)).all()
