"""Operator 12: clustering around centroids with a progressive search in the Walsh-Hadamard domain.

The transform of whole numbers is exact and multiplies every squared distance by the same factor, the width. A vector is
compared with all centroids on a few coarse coefficients first, and with the one that looks nearest on all of them: that
distance is the one to beat. What the other coefficients add to a centroid's distance is at least the square of the
difference of the two remainders' lengths; a centroid that is thereby beyond the distance to beat is strictly worse and
goes, and the rest is compared on more coefficients, and on all of them at the end. The nearest centroid (the lower
number at a tie) is thus exact.

Spark runs a round as one pass over the vectors; a task returns a row for each centroid and component, its sums. Only
the centroids, k x width numbers, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, vectors

#: Bits of a component up to which sums of squares of transformed differences fit 64 bits (2 * 24 + 14 < 63).
EXACT = 1 << 24


def coarse_to_fine(width: int) -> np.ndarray:
    """Numbers of the Hadamard coefficients in order of their sign changes, the slowest first."""
    basis = vectors.walsh_hadamard(np.eye(width, dtype=np.int64))
    return np.argsort((np.diff(basis, axis=1) != 0).sum(1), kind="stable")


def stages(width: int) -> list[int]:
    """Ends of the stages, an eighth of the coefficients each."""
    return sorted({max(1, width * part // 8) for part in range(1, 9)})


class Nearest:
    """Nearest centroids of batches of vectors; `seen` counts the coefficients of all pairs, `met` those that were compared."""

    def __init__(self, centroids: np.ndarray):
        self.k, width = centroids.shape
        self.width = vectors.power_of_two(width)
        self.order = coarse_to_fine(self.width)
        self.ends = stages(self.width)
        self.centroids = self.transformed(centroids)
        self.rest = self.lengths(self.centroids)
        self.seen = self.met = 0

    def transformed(self, rows: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(rows), self.width), dtype=rows.dtype)
        wide[:, : rows.shape[1]] = rows
        return vectors.walsh_hadamard(wide)[:, self.order]

    def lengths(self, rows: np.ndarray) -> np.ndarray:
        """Lengths of what lies behind each stage's end; a column a stage."""
        squares = rows.astype(float) ** 2
        return np.stack([np.sqrt(squares[:, end:].sum(1)) for end in self.ends], axis=1)

    def __call__(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and squared distance for each row."""
        if rows.size and max(abs(int(rows.max())), abs(int(rows.min())), int(np.abs(self.centroids).max()) // self.width) >= EXACT:
            return self.unbounded(rows)
        own = self.transformed(rows)
        rest = self.lengths(own)
        row, to = (x.ravel() for x in np.indices((len(rows), self.k)))
        total, begin = np.zeros(len(row), dtype=np.int64), 0
        self.seen += len(row) * self.width
        best = np.full(len(rows), np.iinfo(np.int64).max)
        for stage, end in enumerate(self.ends):
            apart = own[row, begin:end] - self.centroids[to, begin:end]
            total += (apart * apart).sum(1)
            self.met += apart.size
            begin = end
            if end == self.width:
                break
            if stage == 0:  # the one that looks nearest, on all coefficients
                guess = total.reshape(len(rows), self.k).argmin(1)
                apart = own[:, end:] - self.centroids[guess, end:]
                best = total.reshape(len(rows), self.k)[np.arange(len(rows)), guess] + (apart * apart).sum(1)
                self.met += apart.size
            a, b = rest[row, stage], self.rest[to, stage]
            least = np.maximum(0.0, np.abs(a - b) - 1e-9 * (a + b)) ** 2 * (1 - 1e-9)  # below what it can be in spite of rounding
            stays = total + least <= best[row] * (1 + 1e-12)  # sums beyond 2^53 are rounded here
            row, to, total = row[stays], to[stays], total[stays]
        first = np.lexsort((to, total, row))
        first = first[np.r_[True, row[first][1:] != row[first][:-1]]] if len(first) else first
        return to[first], total[first] // self.width

    def unbounded(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for numbers too large for 64-bit sums, with Python's whole numbers."""
        own, centroids = self.transformed(rows.astype(object)), self.centroids.astype(object)
        found = [min((int(((v - c) ** 2).sum()) // self.width, i) for i, c in enumerate(centroids)) for v in own]
        return np.array([i for _, i in found], dtype=np.int64), np.array([d for d, _ in found], dtype=np.int64)


def _sums(centroids: np.ndarray, column: str) -> Callable:
    """Batches of vectors -> (cluster, part, total): sums of components of each cluster in this task, and counts as part -1."""

    def run(batches):
        import pyarrow as pa

        nearest, width = Nearest(centroids), centroids.shape[1]
        totals, counts = np.zeros((len(centroids), width), dtype=object), np.zeros(len(centroids), dtype=object)
        for batch in batches:
            rows = vectors.matrix(batch.column(batch.schema.get_field_index(column)), width)
            to, _ = nearest(rows)
            sums = np.zeros(totals.shape, dtype=np.int64)
            np.add.at(sums, to, rows)
            totals, counts = totals + sums, counts + np.bincount(to, minlength=len(centroids))
        used = [i for i in range(len(centroids)) if counts[i]]
        out = [(i, -1, int(counts[i])) for i in used] + [(i, p, int(totals[i, p])) for i in used for p in range(width)]
        cluster, part, total = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(part, pa.int32()), pa.array(total, pa.int64())], ["cluster", "part", "total"])

    return run


def _assigned(centroids: np.ndarray, column: str, keep: list[str]) -> Callable:
    def run(batches):
        import pyarrow as pa

        nearest = Nearest(centroids)
        for batch in batches:
            to, distance = nearest(vectors.matrix(batch.column(batch.schema.get_field_index(column)), centroids.shape[1]))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(to.astype(np.int32)), pa.array(distance)], [*keep, "cluster", "distance"])

    return run


def moved(points: DataFrame, column: str, centroids: np.ndarray) -> np.ndarray:
    """One round: the floor of the mean of each centroid's vectors, exact; centroids without vectors stay."""
    sums = points.select(column).mapInArrow(common.lean(_sums(centroids, column)), "cluster int, part int, total long")
    rows = sums.groupBy("cluster", "part").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # k x (width + 1)
    found = {(r["cluster"], r["part"]): int(r["total"]) for r in rows}
    out = centroids.copy()
    for i in range(len(centroids)):
        if n := found.get((i, -1)):
            out[i] = [found[i, p] // n for p in range(centroids.shape[1])]
    return out


def clustered(points: DataFrame, key: str, column: str, width: int, order: Column, k: int, rounds: int) -> DataFrame:
    """key, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 for each row of `points`.

    points: `key` and `column`, an array of whole numbers (see vectors.whole); rows whose array has another length
    than `width` are left out. The first k rows in `order`, then by vector, are the first centroids (all rows, if
    there are fewer); repeated rows count each, so that equal centroids may arise, of which the lower number gets all.
    No rows give no rows. key and column may have any name but those of the result.
    """
    spark = points.sparkSession
    common.ship(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fit = points.filter(F.size(column) == width).select(key, column, order.alias("_order"))
    fit = common.saved(fit.repartition(tasks, F.xxhash64(key, column)), "vectors")
    first = [list(r[column]) for r in fit.orderBy("_order", column).limit(k).collect()]  # k rows
    schema = f"{key} {fit.schema[key].dataType.simpleString()}, cluster int, distance long"
    names = "cluster int, _inertia decimal(38,0), _all decimal(38,0), centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema).join(spark.createDataFrame([], names), "cluster").select(key, "cluster", "distance", F.col("_inertia").cast("long").alias("cluster_inertia"), F.col("_all").cast("long").alias("inertia"), "centroid_sha256")
    centroids = np.array(first, dtype=np.int64)
    for _ in range(rounds):
        centroids = moved(fit, column, centroids)
    near = common.saved(fit.select(key, column).mapInArrow(common.lean(_assigned(centroids, column, [key])), schema), "assigned")
    inertia = {r["cluster"]: r["d"] for r in near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    shas = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    table = spark.createDataFrame([(i, d, sum(inertia.values()), shas[i]) for i, d in inertia.items()], names)
    told = near.join(F.broadcast(table), "cluster")  # k rows
    return told.select(key, "cluster", "distance", F.col("_inertia").cast("long").alias("cluster_inertia"), F.col("_all").cast("long").alias("inertia"), "centroid_sha256")


def cluster_embeddings(embeddings: DataFrame, k: int = 40, rounds: int = 5, width: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for embeddings(vec_id, embedding) with exactly
    `width` components, none null or not finite, each turned into floor(256 * x).

    First centroids: the k rows with the smallest SHA-256 of '2:<vec_id>'. A null vec_id hashes as an empty one.
    Repeated rows count each and give a row each; rows of one vec_id with different vectors are ordered by vector. Other
    columns are not read. Left out as well: vectors with a component beyond vectors.LARGEST.
    """
    points = vectors.whole(embeddings.select("vec_id", "embedding"), "embedding").select("vec_id", "whole")
    order = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return clustered(points, "vec_id", "whole", width, order, k, rounds)


def sql(k: int = 40, rounds: int = 5, width: int = 64) -> str:
    """The same in SQL, by comparing all pairs of vectors and centroids."""
    apart = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = [
        f"""v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
            WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster, q FROM v ORDER BY sha256('2:' || vec_id) LIMIT {k})",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (SELECT vec_id, q, cluster, distance FROM (SELECT v.vec_id, v.q, c.cluster, {apart} AS distance FROM v, c{i} AS c)
            QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT cluster, list(m ORDER BY p) AS q FROM (SELECT cluster, p, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m
                FROM (SELECT cluster, unnest(q) AS x, unnest(range({width})) AS p FROM a{i}) GROUP BY cluster, p) GROUP BY cluster)""")
            steps.append(f"c{i + 1} AS (SELECT c.cluster, coalesce(m.q, c.q)::BIGINT[] AS q FROM c{i} AS c LEFT JOIN m{i} AS m ON m.cluster = c.cluster)")
    return f"""WITH {', '.join(steps)}
        SELECT a.vec_id, a.cluster::INTEGER AS cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
            (sum(a.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
        FROM a{rounds} AS a JOIN c{rounds} AS c ON c.cluster = a.cluster"""
