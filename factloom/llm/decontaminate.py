"""Operator 7: benchmark passages in documents, by SimHash of item-sized windows; DataFrame operations only.

1. Words of whole texts, lower-cased; shingles are hashes of five words (of all words, for shorter items). Windows are
   as long as an item, at every start where at least as many of their shingles as similarity asks for stand in items of
   that size. Which items, and in which order or place, plays no part, so no window of that similarity is left out.
2. Each window and each item gets a 64-bit SimHash of its shingles, weighted by how often they occur.
3. The fingerprint is cut into 8 blocks of 8 bits. Items are entered under every value within 2 bits of each block;
   windows look up their 8 blocks among items of their size. Fingerprints within RADIUS = 8 x 3 - 1 bits differ in at
   most 2 bits in one block at least, so none is missed.
4. Candidates within the radius are verified: sum of the smaller over sum of the larger weights of all shingles.

At a similarity of 0.8 fingerprints of windows in which few shingles repeat are about 10 bits apart (standard deviation
3), so the radius leaves a margin of more than four deviations; it is less where a few shingles carry most weight.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH = 5
PERCENT = 80
BLOCKS, BLOCK_BITS, NEAR = 8, 8, 2
RADIUS = BLOCKS * (NEAR + 1) - 1
MASKS = [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= NEAR]


def _word_hashes(text: Column) -> Column:
    return F.transform(common.words(F.lower(text)), lambda w: F.xxhash64(w))


def _shingles(hashes: str, width: int) -> Column:
    """Shingles in order, from a column of word hashes; [] for too few words."""
    taken = ", ".join(f"{hashes}[i + {k}]" for k in range(width))
    return F.expr(f"if(size({hashes}) >= {width}, transform(sequence(0, size({hashes}) - {width}), i -> xxhash64({taken})), cast(array() as array<bigint>))")


def _simhash(shingles: str) -> Column:
    """Bit b is set if more of the shingles have it set than not."""
    votes = f"aggregate({shingles}, 0, (n, h) -> n + cast(shiftright(h, b) & 1 as int) * 2 - 1)"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (f, b) -> if({votes} > 0, f | shiftleft(1L, b), f))")


def _blocks(fingerprint: str) -> Column:
    return F.expr(f"transform(sequence(0, {BLOCKS - 1}), k -> struct(k as block, cast(shiftright({fingerprint}, k * {BLOCK_BITS}) & {(1 << BLOCK_BITS) - 1} as int) as value))")


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, item_words (its number of words), width, item_shingles, item_hash (SimHash); items without words go."""
    hashed = benchmark.select("item_id", _word_hashes(F.col("text")).alias("h")).withColumn("item_words", F.size("h")).filter("item_words > 0")
    hashed = hashed.withColumn("width", F.least("item_words", F.lit(WIDTH)))
    by_width = reduce(lambda c, k: F.when(F.col("width") == k, _shingles("h", k)).otherwise(c), range(1, WIDTH), _shingles("h", WIDTH))
    shingled = common.saved(hashed.withColumn("item_shingles", by_width).drop("h"), "item-shingles")
    return common.saved(shingled.withColumn("item_hash", _simhash("item_shingles")), "items")


def _documents(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), _word_hashes(F.col("text")).alias("h"))


def _starts(width: int) -> Column:
    """Every start of a window that can be similar, from n (words of the text), item_words and p (sorted places of
    shingles that are in items). The smaller weights of a similar window sum up to PERCENT / (100 + PERCENT) of both
    sizes at least, and each counts a place of its own: so many places next to each other must fit into a window."""
    size = f"(item_words - {width} + 1)"
    need = f"(({PERCENT} * (least(n, item_words) - {width} + 1 + {size}) + {99 + PERCENT}) div {100 + PERCENT})"
    last = "greatest(0, n - item_words)"
    ranges = f"transform(sequence(0, size(p) - int({need})), j -> struct(greatest(0, p[j + int({need}) - 1] - {size} + 1) as lo, least(p[j], {last}) as hi))"
    starts = f"flatten(transform(filter({ranges}, r -> r.lo <= r.hi), r -> sequence(r.lo, r.hi)))"
    return F.expr(f"if(size(p) >= {need}, array_distinct({starts}), cast(array() as array<int>))")


def windows(documents: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """laid(doc_id, row_hash, width, item_words, start): the windows that can be similar to an item, start from 0; and
    held(doc_id, row_hash, width, s): the shingles of the documents that have one, once each. Both are saved tables."""
    widths = [r["width"] for r in items.select("width").distinct().collect()]  # five at most
    laid_parts, held_parts = [], []
    for width in widths:
        own = items.filter(F.col("width") == width).select("item_words", F.explode("item_shingles").alias("shingle")).distinct()
        own = common.broadcast_if_small(common.saved(own, "item-shingle-sizes"))
        met = _documents(documents).withColumn("s", _shingles("h", width))
        # outer: else a filter on the size of s goes below the projections, where it computes h anew for each word
        places = met.select("doc_id", "row_hash", F.size("h").alias("n"), F.posexplode_outer("s").alias("place", "shingle")).join(own, "shingle")
        held = places.groupBy("doc_id", "row_hash", "n", "item_words").agg(F.array_sort(F.collect_set("place")).alias("p"))  # one document's
        laid = common.saved(held.select("doc_id", "row_hash", F.lit(width).alias("width"), "item_words", F.explode(_starts(width)).alias("start")), "windows")
        keys = common.broadcast_if_small(common.saved(laid.select("doc_id", "row_hash").distinct(), "window-documents"))
        docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text")
        same = docs["doc_id"].eqNullSafe(keys["doc_id"]) & (docs["row_hash"] == keys["row_hash"])
        hot = _documents(docs.join(keys, same, "left_semi").dropDuplicates(["doc_id", "row_hash"]).select("doc_id", "text"))
        hot = common.saved(hot.select("doc_id", "row_hash", F.lit(width).alias("width"), _shingles("h", width).alias("s")), "window-shingles")
        laid_parts.append(laid)
        held_parts.append(hot)
    if not widths:
        spark = documents.sparkSession
        return spark.createDataFrame([], "doc_id long, row_hash long, width int, item_words int, start int"), spark.createDataFrame([], "doc_id long, row_hash long, width int, s array<bigint>")
    return reduce(DataFrame.unionByName, laid_parts), reduce(DataFrame.unionByName, held_parts)


def _with_shingles(rows: DataFrame, held: DataFrame) -> DataFrame:
    """rows(doc_id, row_hash, width, item_words, start, ..) with window_shingles, cut out of their documents'."""
    same = rows["doc_id"].eqNullSafe(held["doc_id"]) & (rows["row_hash"] == held["row_hash"]) & (rows["width"] == held["width"])
    cut = F.slice(held["s"], F.col("start") + 1, F.col("item_words") - rows["width"] + 1)
    return rows.join(held, same).select(*[rows[c] for c in rows.columns], cut.alias("window_shingles"))


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item found in it: doc_id, row_hash, item_id, start (word from 0), n_words (of the
    window), similarity (the best). Ties go to the first window.

    Null texts, texts and items without words are in no row; repeated rows of a document give one row an item; equal
    items with different item_ids are each found. Empty tables give no rows.
    """
    items = _items(benchmark)
    laid, held = windows(documents, items)
    laid = common.saved(_with_shingles(laid, held).withColumn("window_hash", _simhash("window_shingles")).drop("window_shingles"), "fingerprints")
    index = items.select("item_id", "item_words", "item_shingles", "item_hash", F.explode(_blocks("item_hash")).alias("b"))
    near = F.explode(F.transform(F.array(*[F.lit(m) for m in MASKS]), lambda m: m.bitwiseXOR(F.col("b.value"))))
    index = index.select("item_id", "item_words", "item_hash", F.col("b.block").alias("block"), near.alias("value"))
    index = common.broadcast_if_small(common.saved(index, "block-index"))
    looked = laid.select("doc_id", "row_hash", "width", "item_words", "start", "window_hash", F.explode(_blocks("window_hash")).alias("b"))
    looked = looked.select("*", F.col("b.block").alias("block"), F.col("b.value").alias("value")).drop("b")
    found = looked.join(index, ["item_words", "block", "value"]).filter(F.bit_count(F.col("window_hash").bitwiseXOR(F.col("item_hash"))) <= RADIUS)
    pairs = common.saved(found.select("doc_id", "row_hash", "width", "item_words", "start", "item_id").distinct(), "candidates")
    texts = items.select(F.col("item_id").alias("_item"), "item_shingles", F.col("item_words").alias("_words")).distinct()
    checked = _with_shingles(pairs, held)
    checked = checked.join(texts, checked["item_id"].eqNullSafe(texts["_item"]) & (checked["item_words"] == texts["_words"]))
    count = "size(filter({}, y -> y = x))".format
    smaller = F.expr(f"aggregate(array_distinct(item_shingles), 0, (n, x) -> n + least({count('window_shingles')}, {count('item_shingles')}))")
    checked = checked.withColumn("smaller", smaller).withColumn("larger", F.size("window_shingles") + F.size("item_shingles") - F.col("smaller"))
    hits = checked.filter(100 * F.col("smaller") >= PERCENT * F.col("larger"))
    best = F.max_by(F.struct("start", F.col("item_words").alias("n_words"), (F.col("smaller") / F.col("larger")).alias("similarity")), F.struct(F.col("smaller") / F.col("larger"), -F.col("start")))
    return hits.groupBy("doc_id", "row_hash", "item_id").agg(best.alias("w")).select("doc_id", "row_hash", "item_id", "w.start", "w.n_words", "w.similarity")


def without_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents in which no item was found, all columns as they are."""
    bad = common.saved(contaminated(documents, benchmark).select(F.col("doc_id").alias("_bad_id"), F.col("row_hash").alias("_bad_hash")).distinct(), "contaminated")
    bad = common.broadcast_if_small(bad)
    same = documents["doc_id"].cast("long").eqNullSafe(bad["_bad_id"]) & (F.xxhash64(documents["text"]) == bad["_bad_hash"])
    return documents.join(bad, same, "left_anti")
