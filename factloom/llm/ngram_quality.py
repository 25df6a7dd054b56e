"""Operator 10: perplexity under an interpolated modified Kneser-Ney model of trusted text, cut at quantiles by language.

Units are bytes of UTF-8, and the order is ORDER. Counts are gathered from all trusted text: each task sums its own, then
they are summed by n-gram across shards, and the model is made by joins of the count tables:

p5(e|abcd) = max(n(abcde) - D5, 0) / n(abcd.) + g5(abcd) p4(e|bcd), and so on down to p1, mixed with 1/256. Lower orders
count in how many n-grams of the next order they end; D is the discount for counts 1, 2 and 3 or more, g the mass that
discounts leave.

The model is a table of n-grams, which grows with the trusted text; it is never collected or broadcast. Documents come
to it as chunks of about CHUNK bytes. A chunk's distinct n-grams are gathered (a few hundred thousand, whatever the
documents) and joined with the shards of the model; the answers come back to the chunk, where each document's log
probabilities are added up. Chunks lie in a bucketed table, so that texts themselves are never shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from . import common

ORDER = 5
#: Start and end marks of a text; both bytes never occur in UTF-8.
START, END = 0xFE, 0xFF
#: Bytes of text in a chunk; n-grams that a task holds before it merges them; n-grams of a shard of the model, about;
#: chunks that ask a shard at once.
CHUNK, MERGE, SHARD, TOGETHER = 12 << 20, 1 << 19, 1_000_000, 32
#: One trusted text in so many is left out of training and sets the limits. Confidence of limits from few texts; below
#: FEW texts nothing is known of the tail, and the limit is SPARE times the largest perplexity.
LEFT_OUT, SURE, FEW, SPARE = 5, 0.95, 30, 1.5
#: Bits below the order in a code.
BITS = 8 * ORDER


def ngrams(text: str | None) -> np.ndarray:
    """The n-gram that ends at each unit of a text (its bytes and the end mark), as a number, without the order."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    data = np.frombuffer(bytes([START]) * (ORDER - 1) + raw + bytes([END]), np.uint8).astype(np.uint64)
    out = np.zeros(len(raw) + 1, np.uint64)
    for k in range(ORDER):
        out = (out << np.uint64(8)) | data[k : k + len(out)]
    return out


class Distinct:
    """Distinct numbers of many arrays, with their counts, merged whenever MERGE of them have come together."""

    def __init__(self):
        self.values, self.sums = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, numbers: np.ndarray) -> None:
        self.held.append(np.unique(numbers, return_counts=True))
        self.size += len(self.held[-1][0])
        if self.size >= MERGE:
            self.merge()

    def merge(self) -> None:
        values = np.concatenate([self.values, *(v for v, _ in self.held)])
        sums = np.concatenate([self.sums, *(n for _, n in self.held)])
        self.values, at = np.unique(values, return_inverse=True)
        self.sums = np.bincount(at, sums, len(self.values)).astype(np.int64)
        self.held, self.size = [], 0


def count_ngrams(texts: DataFrame) -> DataFrame:
    """texts(text) -> gram, n: the n-grams of the highest order, summed over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Distinct()
        for batch in batches:
            for text in batch.column(0):
                found.add(ngrams(text.as_py()))
        found.merge()
        yield pa.RecordBatch.from_arrays([pa.array(found.values.astype(np.int64)), pa.array(found.sums)], ["gram", "n"])

    common.ship(texts.sparkSession)
    return texts.select("text").filter("text IS NOT NULL").mapInArrow(common.lean(count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> dict[str, float]:
    """The discounts for counts 1, 2 and 3 or more. Where too few n-grams have small counts: 0.5, 1, 1.5."""
    row = counts.agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    if not (row["n1"] and row["n2"] and row["n3"]):
        return {"d1": 0.5, "d2": 1.0, "d3": 1.5}
    y = row["n1"] / (row["n1"] + 2 * row["n2"])
    return {f"d{k}": max(0.0, k - (k + 1) * y * row[f"n{k + 1}"] / row[f"n{k}"]) for k in (1, 2, 3)}


def train(texts: DataFrame) -> DataFrame | None:
    """The model of texts(text), a saved table: code (order and n-gram), log_p (null for what is a context only) and
    left (log of the mass that it leaves as a context to lower orders; 0 where it is none). None without any text."""
    counts = {ORDER: common.saved(count_ngrams(texts), "counts")}
    if counts[ORDER].isEmpty():
        return None
    for k in range(ORDER - 1, 0, -1):
        ends = F.col("gram").bitwiseAND((1 << 8 * k) - 1)
        counts[k] = common.saved(counts[k + 1].groupBy(ends.alias("gram")).agg(F.count(F.lit(1)).alias("n")), "counts")
    lower, parts = None, []
    for k in range(1, ORDER + 1):
        d = _discounts(counts[k])
        cut = F.least(F.when(F.col("n") == 1, d["d1"]).when(F.col("n") == 2, d["d2"]).otherwise(d["d3"]), F.col("n").cast("double"))
        held = counts[k].select("gram", F.shiftright("gram", 8).alias("context"), "n", cut.alias("cut"))
        contexts = held.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("left"))
        shares = held.join(contexts, "context").select("gram", ((F.col("n") - F.col("cut")) / F.col("total")).alias("own"), "left", F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1).alias("end"))
        if lower is None:
            shares = shares.withColumn("under", F.lit(1 / 256))
        else:
            shares = shares.join(lower.select(F.col("gram").alias("end"), F.col("p").alias("under")), "end")
        lower = common.saved(shares.select("gram", (F.col("own") + F.col("left") * F.col("under")).alias("p")), "probabilities")
        parts.append(lower.select((F.col("gram") + (k << BITS)).alias("code"), F.log("p").alias("log_p"), F.lit(None).cast("double").alias("left")))
        # order 0: the mass that single bytes leave to 1/256
        parts.append(contexts.select((F.col("context") + (k - 1 << BITS)).alias("code"), F.lit(None).cast("double").alias("log_p"), F.log("left").alias("left")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return common.saved(rows.groupBy("code").agg(F.max("log_p").alias("log_p"), F.coalesce(F.max("left"), F.lit(0.0)).alias("left")), "model")


def _code(grams: np.ndarray, order: int) -> np.ndarray:
    return grams | np.uint64(order << BITS)


def all_orders(grams: np.ndarray) -> np.ndarray:
    """Codes, sorted, of n-grams and of all that a lookup of them may fall back on: ends and contexts of each order."""
    out = [_code(grams, ORDER)]
    for k in range(ORDER - 1, -1, -1):
        grams = np.unique(np.concatenate([grams >> np.uint64(8), grams & np.uint64((1 << 8 * k) - 1)]))
        out.append(_code(grams, k))
    return np.concatenate(out[::-1])


def log_probabilities(grams: np.ndarray, codes: np.ndarray, log_p: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Of sorted n-grams of the highest order, from what the model says of `codes` (log_p is NaN where it has none)."""

    def at(order: int, values: np.ndarray) -> np.ndarray:
        return np.searchsorted(codes, _code(values, order))

    total, end, open_ = np.zeros(len(grams)), grams, np.arange(len(grams))
    for k in range(ORDER, 0, -1):
        found = log_p[at(k, end)]
        known = ~np.isnan(found)
        total[open_[known]] += found[known]
        open_, end = open_[~known], end[~known]
        total[open_] += left[at(k - 1, end >> np.uint64(8))]
        end = end & np.uint64((1 << 8 * (k - 1)) - 1)
    total[open_] += np.log(1 / 256)
    return total


def _packed(numbers: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(numbers.tobytes())


def _unpacked(data: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def chunked(documents: DataFrame) -> DataFrame:
    """documents in a bucketed table of chunks: chunk, rows (Arrow stream of all columns), codes (all that its texts look
    up in the model; sorted, as differences)."""
    spark, place = documents.sparkSession, documents.columns.index("text")
    common.ship(spark)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found, size = [], Distinct(), 0

        def closed() -> pa.RecordBatch:
            found.merge()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for b in held:
                    out.write_batch(b)
            codes = np.diff(all_orders(found.values), prepend=np.uint64(0))
            row = [uuid.uuid4().int >> 65], [sink.getvalue().to_pybytes()], [_packed(codes)]
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), pa.array(row[1], pa.binary()), pa.array(row[2], pa.binary())], ["chunk", "rows", "codes"])

        for batch in batches:
            start = 0
            for i, text in enumerate(batch.column(place)):
                grams = ngrams(text.as_py())
                found.add(grams)
                size += len(grams)
                if size >= CHUNK:
                    held.append(batch.slice(start, i + 1 - start))
                    yield closed()
                    held, found, size, start = [], Distinct(), 0, i + 1
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield closed()

    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"chunks_{uuid.uuid4().hex}"
    packed = documents.mapInArrow(common.lean(pack), "chunk long, rows binary, codes binary")
    packed.write.bucketBy(buckets, "chunk").option("path", common.new_folder(spark, "chunks")).saveAsTable(name)
    return spark.table(name)


def scored(documents: DataFrame, model: DataFrame) -> DataFrame:
    """documents with _units (bytes and the end mark) and _log_p (the sum over units, natural logarithm)."""
    documents = documents.drop("_units", "_log_p")
    chunks = chunked(documents)
    shards = max(1, -(-model.count() // SHARD))
    salts = max(1, -(-chunks.count() // TOGETHER))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes = np.cumsum(_unpacked(raw.as_py(), np.uint64))
                of = codes % np.uint64(shards)
                parts = [_packed(np.diff(codes[of == s], prepend=np.uint64(0))) for s in range(shards)]
                yield pa.RecordBatch.from_arrays([pa.array(range(shards), pa.int32()), pa.array([chunk % salts] * shards, pa.int32()), pa.array([chunk] * shards, pa.int64()), pa.array(parts, pa.binary())], ["shard", "salt", "chunk", "codes"])

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        known = held.column("code").to_numpy().astype(np.uint64)
        order = np.argsort(known)
        known, log_p, left = known[order], held.column("log_p").to_numpy().astype(np.float32)[order], held.column("left").to_numpy().astype(np.float32)[order]
        rows = []
        for chunk, shard, raw in zip(*(asked.column(c).to_pylist() for c in ("chunk", "shard", "codes")), strict=True):
            codes = np.cumsum(_unpacked(raw, np.uint64))
            at = np.minimum(np.searchsorted(known, codes), max(0, len(known) - 1))
            met = known[at] == codes if len(known) else np.zeros(len(codes), bool)
            p, rest = np.full(len(codes), np.nan, np.float32), np.zeros(len(codes), np.float32)
            p[met], rest[met] = log_p[at[met]], left[at[met]]
            rows.append((chunk, shard, _packed(p), _packed(rest)))
        return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate((("chunk", pa.int64()), ("shard", pa.int32()), ("log_p", pa.binary()), ("left", pa.binary())))})

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes = np.cumsum(_unpacked(batch.column("codes")[i].as_py(), np.uint64))
                of, log_p, left = codes % np.uint64(shards), np.full(len(codes), np.nan), np.zeros(len(codes))
                for part in batch.column("answers")[i].as_py() or []:
                    mine = of == part["shard"]
                    log_p[mine], left[mine] = _unpacked(part["log_p"], np.float32), _unpacked(part["left"], np.float32)
                grams = codes[np.searchsorted(codes, np.uint64(ORDER << BITS)) :] & np.uint64((1 << BITS) - 1)
                each = log_probabilities(grams, codes, log_p, left)
                for rows in pa.ipc.open_stream(batch.column("rows")[i].as_py()):
                    units, sums = [], []
                    for text in rows.column(place):
                        own = ngrams(text.as_py())
                        units.append(len(own))
                        sums.append(float(each[np.searchsorted(grams, own)].sum()))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(units, pa.int64()), pa.array(sums, pa.float64())], schema=_schema(rows.schema))

    def _schema(own: pa.Schema) -> pa.Schema:
        return own.append(pa.field("_units", pa.int64())).append(pa.field("_log_p", pa.float64()))

    place = documents.columns.index("text")
    asked = chunks.select("chunk", "codes").mapInArrow(common.lean(ask), "shard int, salt int, chunk long, codes binary")
    held = model.withColumn("shard", F.pmod("code", F.lit(shards)).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    answers = asked.groupBy("shard", "salt").cogroup(held.groupBy("shard", "salt")).applyInArrow(answer, "chunk long, shard int, log_p binary, left binary")
    answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("shard", "log_p", "left")).alias("answers"))  # a row a shard
    schema = StructType([*documents.schema.fields, StructField("_units", LongType()), StructField("_log_p", DoubleType())])
    return chunks.hint("merge").join(answers, "chunk", "left").select("rows", "codes", "answers").mapInArrow(common.lean(sum_up), schema)


def left_out(text: Column) -> Column:
    """Whether a trusted text sets the limits; copies of a text fall on the same side."""
    return F.pmod(F.xxhash64(text), F.lit(LEFT_OUT)) == 0


def _limit(quantile: float, above: bool) -> Column:
    """The quantile of p (the lower one where not `above`). With so few rows that it lies beyond them all, its outer bound
    under a normal law of log p (Natrella's tolerance factor), the outermost p at least; null for fewer than FEW rows."""
    tail = 1 - quantile if above else quantile
    z, c, n = NormalDist().inv_cdf(1 - tail), NormalDist().inv_cdf(SURE), F.count("p")
    a, b = 1 - c * c / (2 * F.greatest(n - 1, F.lit(1))), z * z - c * c / F.greatest(n, F.lit(1))
    wide = (z + F.sqrt(z * z - a * b)) / a * F.stddev(F.log("p"))
    outer = F.greatest(F.max("p"), F.exp(F.avg(F.log("p")) + wide)) if above else F.least(F.min("p"), F.exp(F.avg(F.log("p")) - wide))
    return F.when(n * tail >= 1, F.percentile_approx("p", quantile, 10_000)).when(n >= FEW, outer)


def judged(documents: DataFrame, trusted_ids: DataFrame, quantile: float = 0.99, low: float = 0.001, prior_units: int = 64) -> DataFrame:
    """documents with _perplexity, _floor, _limit and _kept.

    Trusted text: the documents whose doc_id is in trusted_ids(doc_id); one text in LEFT_OUT is left out of training.
    Perplexity is that of the mean log probability a byte; each text is taken together with prior_units bytes of the
    mean of the texts left out, so that a few words say little. _limit is the `quantile`, _floor the quantile `low` of
    the perplexities of the texts left out of the same language (of all, for a language with fewer than FEW; lang null
    is a language). Kept: from _floor to _limit; below are texts that say the same few words again and again. With fewer
    than FEW texts left out in all, _limit is SPARE times the largest perplexity and _floor the smallest by SPARE; without
    any, all stay, as do null and empty texts. Whole texts are scored, however long; rows that repeat are judged alike;
    other columns stay as they are, but for columns of these names (and _units, _log_p), which are left out. No rows: none.
    """
    documents = documents.drop("_perplexity", "_floor", "_limit", "_kept", "_units", "_log_p")
    ids = common.broadcast_if_small(trusted_ids.select(F.col("doc_id").alias("_trusted_id")).distinct())
    trusted = documents.join(ids, documents["doc_id"] == ids["_trusted_id"], "left_semi").select("lang", "text").filter("text IS NOT NULL")
    model = train(trusted.filter(~left_out(F.col("text"))))
    own = None if model is None else common.saved(scored(trusted.filter(left_out(F.col("text"))), model).select("lang", F.col("_units").alias("units"), F.col("_log_p").alias("log_p")), "left-out-scores")
    mean = None if own is None else own.agg((F.sum("log_p") / F.sum("units")).alias("m")).first()["m"]
    if mean is None:
        nothing = F.lit(None).cast("double")
        return documents.select("*", nothing.alias("_perplexity"), nothing.alias("_floor"), nothing.alias("_limit"), F.lit(True).alias("_kept"))

    def perplexity(log_p: Column, units: Column) -> Column:
        return F.exp(-(log_p + F.lit(prior_units * mean)) / (units + prior_units))

    known = own.select("lang", perplexity(F.col("log_p"), F.col("units")).alias("p"))
    whole = known.agg(F.coalesce(_limit(quantile, True), SPARE * F.max("p")).alias("high"), F.coalesce(_limit(low, False), F.min("p") / SPARE).alias("low")).first()
    mark = "_" * (1 + max(map(len, documents.columns)))  # longer than any column's name
    limits = common.saved(known.groupBy(F.col("lang").alias(mark + "of")).agg(_limit(quantile, True).alias(mark + "high"), _limit(low, False).alias(mark + "low")), "limits")
    limits = common.broadcast_if_small(limits, 10_000)
    found = scored(documents, model)
    found = found.join(limits, found["lang"].eqNullSafe(limits[mark + "of"]), "left")
    floor, limit, p = F.coalesce(mark + "low", F.lit(whole["low"])), F.coalesce(mark + "high", F.lit(whole["high"])), perplexity(F.col("_log_p"), F.col("_units"))
    kept = (F.coalesce(F.length("text"), F.lit(0)) == 0) | p.between(floor, limit)
    return found.select(*documents.columns, p.alias("_perplexity"), floor.alias("_floor"), limit.alias("_limit"), kept.alias("_kept"))
