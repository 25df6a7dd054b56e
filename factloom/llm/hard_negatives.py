"""Operator 11: hard negatives by rotated one-bit codes and deterministic intervals; integer products decide.

A vector o of whole numbers is rotated (signs and Hadamard transforms, the same for all rows) and kept as a series of
one-bit codes: the first holds the signs of the rotated vector, each further one the signs of what the codes before it
leave at half its step. Stored with them are the alignments, that is the factors of the codes in the least-squares fit
o = sum(a_k * c_k) + r, and the lengths of the remainders after the first code and after all. A query q is cut into bit
planes of its rotated components, so that the product of a code with it is a sum of population counts. Then
<o, q> = sum(a_k * <c_k, q>) + <r, q>, and by Cauchy-Schwarz the last part is at most |r| * |q - (its part along c)|:
an interval that holds without any chance. Per anchor, rows whose interval cannot reach the best few are left out after
the first code, then after all codes; products of whole numbers are computed for the rest only.

Spark writes the codes of all rows once, then passes over them once for the positives and once for the negatives of a
block of anchors (ANCHORS of them, so that a broadcast has a fixed bound). A task keeps a few best rows an anchor
and returns those; a window with a row limit merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, vectors

#: Anchors of a pass; with 64 components a block has about 20 MB.
ANCHORS = 16_384
#: One-bit codes a vector, and bit planes of a query.
CODES, PLANES = 6, 8
#: Anchors that meet a batch of rows at once: pairs held in memory are these times the rows of a batch.
SLICE = 128
#: A row of the index.
INDEX = "row long, vec_id long, label int, whole array<long>, codes binary, align array<double>, rest array<double>"


class Rotation:
    """The same orthogonal map for all rows of `width` components: three turns of fixed signs and a Hadamard transform."""

    def __init__(self, width: int, seed: int = 11):
        self.width = max(64, vectors.power_of_two(width))
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (3, self.width))

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), self.width))
        out[:, : rows.shape[1]] = rows
        for signs in self.signs:
            out = vectors.walsh_hadamard(out * signs) / np.sqrt(self.width)
        return out


def encoded(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (row, code, word of 64 bits), alignments (of the first code alone, then of all in the common fit) and the
    lengths of the remainders (after the first code, after all) of rotated rows."""
    n, width = turned.shape
    step = np.abs(turned).max(1, initial=0.0)[:, None] / 2
    left, signs = turned.copy(), np.empty((n, CODES, width))
    for k in range(CODES):
        signs[:, k] = np.where(left >= 0, 1.0, -1.0)
        left -= step * signs[:, k]
        step = step / 2
    first = (signs[:, 0] * turned).sum(1) / width
    gram = signs @ signs.transpose(0, 2, 1)
    fit = (np.linalg.pinv(gram) @ (signs @ turned[:, :, None]))[:, :, 0]
    rests = [np.linalg.norm(turned - first[:, None] * signs[:, 0], axis=1), np.linalg.norm(turned - (fit[:, None] @ signs)[:, 0], axis=1)]
    words = np.packbits(signs > 0, axis=2, bitorder="little").view(np.uint64)
    return words, np.concatenate([first[:, None], fit], axis=1), np.stack(rests, axis=1)


class Queries:
    """Anchors ready to meet codes: whole numbers, bit planes of the rotated components, and lengths."""

    def __init__(self, whole: np.ndarray, rotation: Rotation):
        turned = rotation(whole)
        self.whole, self.low = whole, turned.min(1, initial=0.0)
        self.step = np.maximum((turned.max(1, initial=0.0) - self.low) / ((1 << PLANES) - 1), 1e-12)
        cut = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        kept = self.low[:, None] + self.step[:, None] * cut
        self.sums, self.length, self.lost = kept.sum(1), np.linalg.norm(turned, axis=1), np.linalg.norm(turned - kept, axis=1)
        self.planes = np.stack([np.packbits((cut >> p) & 1, axis=1, bitorder="little").view(np.uint64) for p in range(PLANES)], axis=1).astype(np.uint64)

    def along(self, q, words: np.ndarray) -> np.ndarray:
        """Products of codes (..., word) with the kept form of the queries numbered q (of the same shape before the last
        axis, or one that goes with it): population counts of the code in each plane."""
        ones, weighed = np.bitwise_count(words).sum(-1, dtype=np.int64), 0
        for w in range(words.shape[-1]):
            for p in range(PLANES):
                weighed = weighed + (np.bitwise_count(words[..., w] & self.planes[q, p, w]).astype(np.uint32) << np.uint32(p))
        return 2 * (self.low[q] * ones + self.step[q] * weighed) - self.sums[q]


class Rows:
    """A batch of the index as arrays."""

    def __init__(self, batch, width: int):
        get = lambda name: batch.column(batch.schema.get_field_index(name))
        self.n = batch.num_rows
        self.row, self.vec_id, self.label = (np.asarray(get(c)) for c in ("row", "vec_id", "label"))
        self.whole = vectors.matrix(get("whole"), width)
        self.words = np.frombuffer(b"".join(x.as_py() for x in get("codes")), dtype=np.uint64).reshape(self.n, CODES, -1)
        self.align = np.asarray(get("align").flatten()).reshape(self.n, CODES + 1)
        self.rest = np.asarray(get("rest").flatten()).reshape(self.n, 2)
        self.length = np.hypot(np.abs(self.align[:, 0]) * np.sqrt(self.words.shape[2] * 64), self.rest[:, 0])


def first_interval(queries: Queries, q: np.ndarray, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the products of queries q with all rows, from the first codes."""
    root = np.sqrt(rows.words.shape[2] * 64)
    t = queries.along(q[:, None], rows.words[None, :, 0])
    # of the query, what lies across the code; its part along it is known up to what the planes lost
    along = np.maximum(0.0, np.abs(t) / root - queries.lost[q][:, None])
    across = np.sqrt(np.maximum(0.0, queries.length[q][:, None] ** 2 - along**2))
    centre = rows.align[:, 0] * t
    half = np.abs(rows.align[:, 0]) * root * queries.lost[q][:, None] + rows.rest[:, 0] * across
    half = half + 1e-9 * (1.0 + rows.length * queries.length[q][:, None])  # rounding
    return centre - half, centre + half


def last_interval(queries: Queries, q: np.ndarray, rows: Rows, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same from all codes, for the pairs of queries and rows that `of` (a matrix) names; others get -inf and inf.
    Pair by pair if they are few, else all at once."""
    low, high = np.full(of.shape, -np.inf), np.full(of.shape, np.inf)
    if of.mean() > 0.2:
        at, i, r = np.s_[:], q[:, None], np.s_[:]
    else:
        at = np.nonzero(of)
        i, r = q[at[0]], at[1]
    centre = sum(rows.align[r, 1 + k] * queries.along(i, rows.words[r, k]) for k in range(CODES))
    fitted = rows.length[r] + rows.rest[r, 1]
    half = fitted * queries.lost[i] + rows.rest[r, 1] * queries.length[i] + 1e-9 * (1.0 + rows.length[r] * queries.length[i])
    low[at], high[at] = centre - half, centre + half
    return low, high


def _nth(low: np.ndarray, n: int) -> np.ndarray:
    """The n-th largest of each row; what has fewer than n gives minus infinity."""
    return np.partition(low, low.shape[1] - n, axis=1)[:, low.shape[1] - n] if low.shape[1] >= n else np.full(len(low), -np.inf)


class Best:
    """The best few rows of each request over many batches; `seen` counts pairs, `opened` those with all codes, `scored`
    those with whole numbers."""

    def __init__(self, requests: int, n: int):
        self.n, self.seen, self.opened, self.scored = n, 0, 0, 0
        self.score, self.vec_id, self.row = (np.zeros((requests, n), dtype=np.int64) for _ in range(3))
        self.has = np.zeros((requests, n), dtype=bool)

    def floor(self, request: np.ndarray) -> np.ndarray:
        """What a row must reach to be among the best: the score of the last, if there are n."""
        return np.where(self.has[request].all(1), self.score[request].min(1), -np.inf)

    def offer(self, request: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        """Pairs of one batch: with the rows held so far, the first n by score (higher first), vec_id and row."""
        touched, request = np.unique(request, return_inverse=True)
        held, old = self.has[touched], np.repeat(np.arange(len(touched)), self.n)[self.has[touched].ravel()]
        request, score, vec_id, row = (np.concatenate(x) for x in ((old, request), (self.score[touched][held], score), (self.vec_id[touched][held], vec_id), (self.row[touched][held], row)))
        order = np.lexsort((row, vec_id, -score, request))
        request = request[order]
        rank = np.arange(len(request)) - np.searchsorted(request, request)
        at, to = order[rank < self.n], (touched[request[rank < self.n]], rank[rank < self.n])
        self.has[touched] = False
        self.has[to], self.score[to], self.vec_id[to], self.row[to] = True, score[at], vec_id[at], row[at]


def meet(queries: Queries, rows: Rows, best: Best, anchor_of: np.ndarray, allowed, low: np.ndarray | None = None, high: np.ndarray | None = None) -> None:
    """All rows of a batch against all requests: request i asks for the best rows that allowed(anchors) admits, with a score
    from low[i] to high[i], for the anchor anchor_of[i]; requests come in order of their anchors."""
    for begin in range(0, len(queries.whole), SLICE):
        q = np.arange(begin, min(begin + SLICE, len(queries.whole)))
        own = np.arange(np.searchsorted(anchor_of, q[0]), np.searchsorted(anchor_of, q[-1] + 1))
        if not len(own):
            continue
        at, of = anchor_of[own] - begin, allowed(q)
        asked = np.zeros(len(q), dtype=bool)
        asked[at] = True
        of = of & asked[:, None]
        best.seen += int(of.sum())
        lower, upper = first_interval(queries, q, rows)
        if low is None:
            least, most = np.full(len(q), -np.inf), np.full(len(q), np.inf)
            least[at] = np.maximum(best.floor(own), _nth(np.where(of[at], lower[at], -np.inf), best.n))
        else:  # of all requests of an anchor
            least, most = np.full(len(q), np.inf), np.full(len(q), -np.inf)
            np.minimum.at(least, at, np.maximum(best.floor(own), low[own]))
            np.maximum.at(most, at, high[own])
        of &= (upper >= least[:, None]) & (lower <= most[:, None])
        best.opened += int(of.sum())
        lower, upper = last_interval(queries, q, rows, of)
        may, lows, highs = of[at], lower[at], upper[at]
        sure = may
        if low is not None:
            sure = may & (lows >= low[own][:, None]) & (highs <= high[own][:, None])
            may &= (highs >= low[own][:, None]) & (lows <= high[own][:, None])
        reach = np.maximum(best.floor(own), _nth(np.where(sure, lows, -np.inf), best.n))
        i, r = np.nonzero(may & (highs >= reach[:, None]))
        best.scored += len(i)
        score = (queries.whole[anchor_of[own[i]]] * rows.whole[r]).sum(1)
        if low is not None:
            inside = (score >= low[own[i]]) & (score <= high[own[i]])
            i, r, score = i[inside], r[inside], score[inside]
        best.offer(own[i], score, rows.vec_id[r], rows.row[r])


def _found(best: Best, names: list, kinds: list) -> Iterator:
    import pyarrow as pa

    request, rank = np.nonzero(best.has)
    columns = [*(np.asarray(k)[request] for k in kinds), best.row[request, rank], best.vec_id[request, rank], best.score[request, rank]]
    for begin in range(0, max(1, len(request)), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[begin : begin + 50_000], pa.int64()) for c in columns], names)


def _index(width: int):
    """Batches of (row, vec_id, label, whole) -> the index."""

    def run(batches):
        import pyarrow as pa

        rotation = Rotation(width)
        for batch in batches:
            whole = vectors.matrix(batch.column(3), width)
            words, align, rest = encoded(rotation(whole))
            codes = pa.array([w.tobytes() for w in words], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, codes, pa.array(list(align), pa.list_(pa.float64())), pa.array(list(rest), pa.list_(pa.float64()))], [*batch.schema.names, "codes", "align", "rest"])

    return run


def _positives(sent, width: int, n: int):
    """Batches of the index -> (anchor, row, vec_id, score): the best n other rows of each anchor's label."""

    def run(batches):
        anchors, label, whole = sent.value
        queries, best = Queries(whole, Rotation(width)), Best(len(anchors), n)
        for batch in batches:
            if batch.num_rows:
                rows = Rows(batch, width)
                allowed = lambda some, rows=rows: (label[some][:, None] == rows.label) & (anchors[some][:, None] != rows.row)
                meet(queries, rows, best, np.arange(len(anchors)), allowed)
        yield from _found(best, ["anchor", "row", "vec_id", "score"], [anchors])

    return run


def _negatives(sent, width: int, n: int):
    """Batches of the index -> (anchor, at_most, row, vec_id, score): the best n rows of other labels for each request
    (anchor, at_most), with a score from the request's least to at_most."""

    def run(batches):
        anchors, label, whole, anchor_of, at_least, at_most = sent.value
        queries, best = Queries(whole, Rotation(width)), Best(len(anchor_of), n)
        for batch in batches:
            if batch.num_rows:
                rows = Rows(batch, width)
                meet(queries, rows, best, anchor_of, lambda some, rows=rows: label[some][:, None] != rows.label, at_least, at_most)
        yield from _found(best, ["anchor", "at_most", "row", "vec_id", "score"], [anchors[anchor_of], at_most])

    return run


def _first(found: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= n)


def mined(rows: DataFrame, width: int, positives: int = 5, negatives: int = 5, percent: int = 80, block: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows(vec_id long, label int, whole array<long> of `width` components, anchor boolean), none null. Each row is one of
    its own, also where rows repeat. For every anchor and each of its first `positives` other rows of the same label: the first
    `negatives` rows of other labels whose score is at most the positive's and at least percent % of it. Scores are
    products of whole numbers; ties go by vec_id, rows alike in both are interchangeable. A positive without such rows
    gives none; a positive score below 0 admits none.
    """
    spark = rows.sparkSession
    common.ship(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(tasks, F.xxhash64("vec_id", "whole")).withColumn("row", F.monotonically_increasing_id())
    dealt = common.saved(dealt.select("row", F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "whole", "anchor"), "vectors")
    index = common.saved(dealt.select("row", "vec_id", "label", "whole").mapInArrow(common.lean(_index(width)), INDEX), "codes")
    chosen = dealt.filter("anchor")
    chosen = common.saved(common.running_sums(chosen, [], ["vec_id", "row"], F.lit(1), "nth").withColumn("block", F.floor((F.col("nth") - 1) / block).cast("int")), "anchors")
    blocks, folder = chosen.agg(F.max("block")).first()[0], common.new_folder(spark, "hard-negatives")
    names = "anchor long, row long, vec_id long, score long"
    if blocks is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for i in range(blocks + 1):  # a block of anchors at a time, against all rows
        one = chosen.filter(F.col("block") == i).orderBy("row").select("row", "label", "whole").toArrow()  # `block` rows at most
        ids, label, whole = np.asarray(one["row"]), np.asarray(one["label"]), vectors.matrix(one["whole"].combine_chunks(), width)
        sent = spark.sparkContext.broadcast((ids, label, whole))
        near = index.mapInArrow(common.lean(_positives(sent, width, positives)), names)
        _first(near, ["anchor"], positives, "nth").write.mode("overwrite").parquet(f"{folder}/positives/block={i}")
        held = spark.read.parquet(f"{folder}/positives/block={i}").select("anchor", "score").distinct().toArrow()  # `positives` rows an anchor
        asked = sorted(zip(np.searchsorted(ids, np.asarray(held["anchor"])).tolist(), held["score"].to_pylist(), strict=True))
        asked = [(a, s) for a, s in asked if s >= 0]
        anchor_of, at_most = np.array([a for a, _ in asked], dtype=np.int64), np.array([s for _, s in asked], dtype=np.int64)
        at_least = np.array([-(-percent * s // 100) for _, s in asked], dtype=np.int64)
        wide = spark.sparkContext.broadcast((ids, label, whole, anchor_of, at_least, at_most))
        near = index.mapInArrow(common.lean(_negatives(wide, width, negatives)), "anchor long, at_most long, row long, vec_id long, score long")
        _first(near, ["anchor", "at_most"], negatives, "rank").write.mode("overwrite").parquet(f"{folder}/negatives/block={i}")
        sent.unpersist()
        wide.unpersist()
    firsts = spark.read.schema(f"{names}, nth int, block int").parquet(f"{folder}/positives")
    seconds = spark.read.schema("anchor long, at_most long, row long, vec_id long, score long, rank int, block int").parquet(f"{folder}/negatives")
    pairs = firsts.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = pairs.join(seconds.select(F.col("anchor").alias("_anchor"), "at_most", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), (F.col("anchor") == F.col("_anchor")) & (F.col("positive_score") == F.col("at_most")))
    named = pairs.join(chosen.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine_embeddings(embeddings: DataFrame, every: int = 100, flip: int = 7, labels: int = 10) -> DataFrame:
    """The hard negatives of embeddings(vec_id, embedding, label): components become floor(256 * x); where vec_id is
    divisible by `flip`, label becomes (label + 1) % labels; anchors are the rows whose vec_id is divisible by `every`.

    Rows take no part that have a null label, vec_id or vector, a null, NaN or infinite component, or a component beyond
    vectors.LARGEST. Vectors of different lengths are multiplied as if zeros stood behind the shorter one. Repeated rows are rows of
    their own. Other columns are not read. Tables without anchors or without rows give no rows.
    """
    whole = vectors.whole(embeddings.select("vec_id", "embedding", "label").filter("label IS NOT NULL AND vec_id IS NOT NULL"), "embedding")
    label = F.when(F.col("vec_id") % flip == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    width = max(1, whole.agg(F.max(F.size("whole"))).first()[0] or 1)
    rows = whole.select("vec_id", label.alias("label"), vectors.padded(F.lit(width), F.col("whole")).alias("whole"), (F.col("vec_id") % every == 0).alias("anchor"))
    return mined(rows, width)


def sql(every: int = 100, flip: int = 7, labels: int = 10, positives: int = 5, negatives: int = 5, percent: int = 80) -> str:
    """The same in SQL, by products of all anchors and rows."""
    return f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % {flip} = 0 THEN (label + 1) % {labels} ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
            FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % {every} = 0),
        p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {positives})
        SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
            SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
                row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank
            FROM p JOIN s AS n ON n.anchor_id = p.anchor_id AND NOT n.same AND {percent} * p.score <= 100 * n.score AND n.score <= p.score) WHERE rank <= {negatives}"""
