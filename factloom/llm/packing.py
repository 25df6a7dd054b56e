"""Operator 3: best-fit packing guided by non-negative least squares over few-document length patterns.

The histogram of piece lengths (at most `capacity` bins, whatever the input) is the only thing the driver sees.
Lengths are put in classes; patterns are the multisets of up to four classes that fill a sequence; non-negative least
squares fits repeat counts of patterns to the class histogram; the counts are rounded down, each pattern is made of
real lengths (its last place by best fit), and the rest is packed best-fit decreasing, again on the histogram. The
result is a table of few patterns of exact lengths with repeat counts. Pieces are then numbered within their length,
distributed, and a piece's number says which sequence it goes to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .encoding import encoder

PIECES = "doc_id long, row_hash long, piece int, start long, length int, ids binary"
SLOTS = "length int, first long, last long, sequence_base long, offset int"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """start and length of the pieces of n ids: whole capacities at the end, the first piece may be shorter."""
    head = n % capacity
    out = [(0, head)] if head else []
    return out + [(at, capacity) for at in range(head, n, capacity)]


def encoded_pieces(documents: DataFrame, vocabulary: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Every whole text encoded, end_id appended, cut into pieces: doc_id, row_hash, piece, start, length, ids.

    A null text is empty. Documents of up to `capacity` ids are one piece.
    """
    end = end_id.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(vocabulary).one
        kinds = pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()
        names = ["doc_id", "row_hash", "piece", "start", "length", "ids"]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            rows, held = [], 0
            for doc_id, row_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = one(text.as_py()) + end
                rows += [(doc_id, row_hash, i, at, n, ids[4 * at : 4 * (at + n)]) for i, (at, n) in enumerate(cut(len(ids) // 4, capacity))]
                held += len(ids)
                if held > 1 << 23:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)

    common.ship(documents.sparkSession)
    text = F.col("text")
    return documents.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("row_hash"), text).mapInArrow(common.lean(encode), PIECES)


def fit_non_negative(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 with least |a x - b|, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 1e-9 * max(1.0, float(np.abs(b).max(initial=0))):
            break
        free[best] = True
        while True:
            trial = np.zeros(n)
            trial[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (trial <= 0)
            if not low.any():
                x = trial
                break
            step = min(1.0, float(np.min(x[low] / (x[low] - trial[low] + 1e-300))))
            x = x + step * (trial - x)
            free &= x > 1e-12
            x[~free] = 0
    return x


def class_patterns(classes: int, most: int = 4) -> list[tuple[int, ...]]:
    """Descending tuples of up to `most` class numbers 1..classes whose sum is `classes`."""
    out: list[tuple[int, ...]] = []

    def grow(at: tuple[int, ...], left: int) -> None:
        if left == 0:
            out.append(at)
        elif len(at) < most:
            for k in range(min(left, at[-1] if at else left), 0, -1):
                if k * (most - len(at)) >= left:
                    grow((*at, k), left - k)

    grow((), classes)
    return out


def plan_patterns(histogram: dict[int, int], capacity: int, classes: int = 64) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of exact lengths with repeat counts that use up the histogram. Each step uses up a length, a pattern
    or what repeats of a length allow, so there are a few thousand patterns at most, whatever the counts."""
    left = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        left[length] = count
    made: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: list[int], most: int) -> int:
        need = {x: lengths.count(x) for x in lengths}
        times = min(most, *(int(left[x]) // k for x, k in need.items()))
        for x, k in need.items():
            left[x] -= times * k
        made.append((tuple(lengths), times))
        return times

    def largest(upto: int, chosen: list[int]) -> int:
        """The largest length that fits and of which one is left over beyond those chosen."""
        for x in np.flatnonzero(left[1 : upto + 1] > 0)[::-1] + 1:
            if left[x] > chosen.count(x):
                return int(x)
        return 0

    def filled(chosen: list[int]) -> list[int]:
        room = capacity - sum(chosen)
        while room and (x := largest(room, chosen)):
            chosen = [*chosen, x]
            room -= x
        return chosen

    if left[capacity]:
        take([capacity], int(left[capacity]))
    width = -(-capacity // classes)
    of = lambda x: -(-x // width)  # noqa: E731  class of a length
    counts = np.zeros(classes + 1)
    for x in np.flatnonzero(left):
        counts[of(int(x))] += left[x]
    patterns = [p for p in class_patterns(classes) if len(p) > 1]
    if counts.sum() and patterns:
        a = np.zeros((classes, len(patterns)))
        for j, p in enumerate(patterns):
            for k in p:
                a[k - 1, j] += 1
        repeats = np.floor(fit_non_negative(a, counts[1:]) + 1e-9).astype(np.int64)
        for j in np.flatnonzero(repeats):
            goal = int(repeats[j])
            while goal > 0:
                chosen: list[int] = []
                for k in patterns[j][:-1]:
                    inside = [x for x in range(k * width, (k - 1) * width, -1) if x <= capacity and left[x] > chosen.count(x)]
                    if not inside or sum(chosen) + inside[0] > capacity:
                        break
                    chosen.append(inside[0])
                if len(chosen) < len(patterns[j]) - 1:
                    break  # what is left of these classes is a residual
                goal -= take(filled(chosen), goal)
    while left.any():
        x = int(np.flatnonzero(left)[-1])
        take(filled([x]), int(left[x]))
    return made


def slot_rows(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """For each length, which numbers of its pieces go to which sequences: number first..last-1 of a length goes to
    sequence sequence_base + number, at `offset`."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for x in lengths:
            first = used.get(x, 0)
            rows.append((x, first, first + times, sequence - first, offset))
            used[x] = first + times
            offset += x
        sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (any columns with doc_id, row_hash, piece, length in 1..capacity; a saved table) with sequence_id and
    offset. Every piece is placed; sequences are gapless from offset 0 and hold at most `capacity`."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    rows = slot_rows(plan_patterns(counts, capacity))
    slots = F.broadcast(spark.createDataFrame(rows, SLOTS))  # a few thousand rows, bounded by capacity
    numbered = common.number_within(pieces, ["length"], ["doc_id", "row_hash", "piece"], "_number")
    inside = (numbered["length"] == slots["length"]) & (numbered["_number"] >= slots["first"]) & (numbered["_number"] < slots["last"])
    out = numbered.join(slots, inside, "inner")
    return out.select(*[numbered[c] for c in pieces.columns], (F.col("sequence_base") + F.col("_number")).alias("sequence_id"), F.col("offset").cast("long").alias("offset"))


def pack_documents(documents: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Encode, cut and pack documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset, row_hash.

    The ids of the pieces stay in the saved table behind `encoded_pieces`; `sequences` puts them together.
    Repeated rows are packed as often as they occur; no documents give no rows.
    """
    pieces = common.saved(encoded_pieces(documents, vocabulary, capacity, end_id).withColumn("ids_crc32", F.crc32("ids")), "pieces")
    placed = pack(pieces.drop("ids"), capacity)
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset", "row_hash")


def sequences(placed_with_ids: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids (little-endian unsigned 32-bit), lengths in order. Needs ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))  # at most `capacity` ids a sequence
    return placed_with_ids.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.expr("aggregate(p, X'', (a, x) -> concat(a, x.ids))").alias("ids"), F.col("p.length").alias("lengths"))
