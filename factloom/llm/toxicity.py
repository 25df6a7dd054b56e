"""Operator 2: toxicity by compression distance between zstandard dictionaries of toxic and ordinary text.

Two dictionaries are trained by zstandard: one on windows of ordinary texts, one on those pieces of toxic texts whose
words stand out, that is, come many times as often as in ordinary texts (counted by the number of different words
before them, so that copies of one text count once). A window of a text is compressed with the ordinary dictionary, and
with the ordinary and the toxic one behind each other, so that what is ordinary costs the same in both; the margin is
the difference of the lengths. Windows overlap by half. What a document's margins come to is turned into a score by a
logistic curve fitted on training rows that the dictionaries have not seen, moved so that the best cut lies at a score
of 0.3.

Training rows are dealt by crc32 of the doc_id, by 4: words are compared on all rows of remainders 0 and 1; the
dictionaries are trained on samples of these rows (texts of about ORDINARY_SAMPLE and TOXIC_SAMPLE
characters, drawn by hash), the curve is fitted on
CURVE_ROWS rows of remainder 3 at most, and remainder 2 is held out. All windows of whole texts are scored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 8
LEVEL = 3
SLACK = 3
CUT = 0.3
HELD_OUT = 2
#: Sizes of the dictionaries, and what zstandard looks at in training: length of segments and of what must recur.
ORDINARY_BYTES, TOXIC_BYTES, SEGMENT, RECURRING = 32_768, 16_384, 16, 6
#: How far apart samples that are alike are laid for training.
SPREAD = 64
CONTEXTS, CONTRAST = 5, 8.0
#: Bounds of the samples of labelled rows that the model is fitted on: characters of ordinary and of toxic text for the dictionaries, about, and rows for the curve.
ORDINARY_SAMPLE, TOXIC_SAMPLE, CURVE_ROWS = 8_000_000, 64_000_000, 20_000
EDGES = b".,!?;:\"'()#$%&*|"


def _words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def _contexts(rows: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """word, contexts: in how many different words' wake each word (of those in wanted(word)) comes."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            found: set[tuple[bytes, int]] = set()
            for text in batch.column(0):
                before = b""
                for word in (w.strip(EDGES) for w in _words(text.as_py())):
                    if word:
                        found.add((word, xxhash.xxh32_intdigest(before)))
                    before = word
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.binary()), pa.array([c for _, c in found], pa.int64())], ["word", "context"])

    met = rows.select("text").mapInArrow(common.lean(pairs), "word binary, context long")
    met = met if wanted is None else met.join(wanted, "word", "left_semi")
    return met.distinct().groupBy("word").agg(F.count(F.lit(1)).alias("contexts"))


def _windows(words: list[bytes], step: int = WINDOW // 2) -> list[bytes]:
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, max(1, len(words) - step), step)] if words else []


def _sample(rows: DataFrame, share: float, cut, wanted: DataFrame | None = None) -> list[bytes]:
    """The pieces (word, piece) that cut(words) makes of a share of the texts, each text once; (wanted) only those of
    words in wanted(word)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                pieces = cut(_words(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pieces], pa.binary()) for k in range(2)], ["word", "piece"])

    drawn = rows.select("text", F.xxhash64("text").alias("h")).filter(F.pmod("h", F.lit(1_000_000)) < int(1_000_000 * min(1.0, share)))
    texts = drawn.groupBy("h").agg(F.first("text").alias("text")).select("text")
    pieces = texts.mapInArrow(common.lean(found), "word binary, piece binary")
    pieces = pieces if wanted is None else pieces.join(wanted, "word", "left_semi")
    return sorted(bytes(r["piece"]) for r in pieces.select("piece").collect())


def _words_alone(words: list[bytes]) -> list[tuple[bytes, bytes]]:
    return [(w.strip(EDGES), b" " + w + b" ") for w in words]


def _windows_apart(words: list[bytes]) -> list[tuple[bytes, bytes]]:
    return [(b"", w) for w in _windows(words, WINDOW)]


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary of `size` bytes at most: all different samples, the most frequent ones last, if they have room; else what
    zstandard trains on them, dealt by hash, as it takes its segments from one stretch of the samples after the other and
    ends early where stretches are alike. Of less than four times its size it cannot tell what recurs. Room that it
    leaves goes to the most frequent samples that the dictionary lacks."""
    import zstandard

    often = Counter(samples)
    ranked = sorted(often, key=lambda s: (often[s], s))
    if sum(map(len, ranked)) <= size or sum(map(len, samples)) < 4 * size:
        return b"".join(ranked)[-size:]
    dealt = sorted(samples, key=lambda s: (zlib.crc32(s), s))
    dealt = [s for k in range(SPREAD) for s in dealt[k::SPREAD]]  # copies of a sample lie apart
    content = zstandard.train_dictionary(size, dealt, k=SEGMENT, d=RECURRING).as_bytes()
    lacking = [s for s in ranked if s not in content]
    room = size - len(content)
    return (b"".join(lacking)[-room:] if room > 0 else b"") + content


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # the last is the constant

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.mean) / self.spread @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Margins:
    """Margins of the windows of a text under two dictionaries, and what they come to."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard

        def packer(content: bytes):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        self.ordinary, self.toxic = packer(ordinary), packer(toxic)

    def features(self, text: str | None) -> tuple[float, ...]:
        ordinary, toxic = self.ordinary, self.toxic
        margins = sorted((len(ordinary(w)) - len(toxic(w)) for w in _windows(_words(text))), reverse=True) or [0]
        n = len(margins)
        some, many = sum(m > SLACK - 1 for m in margins), sum(m > SLACK + 1 for m in margins)
        return sum(margins) / n, float(min(margins[0], 24)), sum(margins[:3]) / min(3, n), sum(margins[:8]) / min(8, n), some / n**0.5, (some / n) ** 0.5, many / n**0.5, (many / n) ** 0.5, float(np.log1p(some))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method; the constant moved so that the cut with the best F1 is at CUT."""
    mean, spread = x.mean(0), x.std(0) + 1e-6
    a = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (y - p) - ridge * np.append(w[:-1], 0)
        bend = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    z = a @ w
    order = np.argsort(-z, kind="stable")
    right = np.cumsum(y[order])
    f1 = 2 * right / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    k = int(np.argmax(f1))
    edge = (z[order[k]] + z[order[min(k + 1, len(z) - 1)]]) / 2
    w[-1] += np.log(CUT / (1 - CUT)) - edge
    return mean, spread, w


def _features(spark: SparkSession, ordinary: bytes, toxic: bytes):
    held = spark.sparkContext.broadcast((ordinary, toxic))

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        margins = Margins(*held.value)
        for texts in batches:
            yield pd.Series([margins.features(t) for t in texts])

    return features


def train(labelled: DataFrame) -> Model | None:
    """labelled(doc_id, text, toxic): training rows only. None if one of the two classes has no rows."""
    spark = labelled.sparkSession
    common.ship(spark)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    rows = labelled.select("doc_id", "text", "toxic", fold.alias("fold")).filter("text IS NOT NULL AND toxic IS NOT NULL")
    seen = rows.filter("fold < 2")
    words = {r["toxic"]: r["n"] for r in seen.groupBy("toxic").agg(F.sum(F.length("text")).alias("n")).collect()}  # two rows
    if not words.get(0) or not words.get(1):
        return None
    toxic = common.saved(_contexts(seen.filter("toxic = 1")).filter(F.col("contexts") >= CONTEXTS), "toxic-words")
    usual = _contexts(seen.filter("toxic = 0"), common.broadcast_if_small(toxic.select("word"))).withColumnRenamed("contexts", "usual")
    contrast = F.col("contexts") / words[1] / ((F.coalesce("usual", F.lit(0)) + 0.5) / words[0])
    chosen = common.saved(toxic.join(usual, "word", "left").filter(contrast >= CONTRAST).select("word"), "standing-out")
    ordinary = trained(_sample(seen.filter("toxic = 0"), ORDINARY_SAMPLE / words[0], _windows_apart), ORDINARY_BYTES)
    both = ordinary + trained(_sample(seen.filter("toxic = 1"), TOXIC_SAMPLE / words[1], _words_alone, common.broadcast_if_small(chosen)), TOXIC_BYTES)
    features = _features(spark, ordinary, both)
    curve = rows.filter("fold = 3").withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(CURVE_ROWS)
    curve = curve.select(features("text").alias("x"), "toxic").toPandas()
    if curve["toxic"].nunique() < 2:
        return None
    mean, spread, weights = fit_curve(np.array(curve["x"].tolist()), curve["toxic"].to_numpy(float))
    return Model(ordinary, both, mean, spread, weights)


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted.

    labels(doc_id, toxic) teach only where crc32 of the doc_id as text leaves another rest than HELD_OUT by 4. Null
    and empty texts have no windows and a low score. A null doc_id is not held out. Without labels of both classes all
    scores are 0. Repeated rows are scored alike.
    """
    spark = documents.sparkSession
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))
    marks = common.broadcast_if_small(labels.select(F.col("doc_id").alias("_labelled"), F.col("toxic").alias("_toxic")))
    base = documents.select("doc_id", "text")
    known = base.filter(~held_out).join(marks, base["doc_id"] == marks["_labelled"]).select("doc_id", "text", F.col("_toxic").alias("toxic"))
    model = train(known)
    if model is None:
        score = F.lit(0.0)
    else:
        features, held = _features(spark, model.ordinary, model.toxic), model
        z = F.lit(float(held.weights[-1]))
        for i, w in enumerate(held.weights[:-1]):
            z = z + (F.col("_x")[i] - float(held.mean[i])) / float(held.spread[i]) * float(w)
        base = base.withColumn("_x", features("text"))
        score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    out = base.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
