"""Operator 13: mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame operations only.

Every source gets a share of all words by its weight, up to a multiple of what it has; the excess is shared among the others.
A target is made of complete epochs, in which every document is taken once, and of a rest. For the rest each document
draws an exponential key, -ln(u) / quality, where u is a hash of seed, doc_id and text and thus the same in every run;
documents are taken in order of their keys until the rest is full, the last one with as many of its first words as fit.
Documents of high quality come early more often, and no order but the keys' decides.

A source is never in one task: documents are dealt by ranges of source and key, added up in each range, and ranges start where
those before them end.
"""

from __future__ import annotations

from fractions import Fraction
from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A target is at most so many times what its source has.
MOST = 3
SEED = "mix-1"


def quality(text: Column) -> Column:
    """From 0.1 to 1: the share of different words, so that texts of repeated words come late."""
    parts = common.words(text)
    return F.when(F.size(parts) > 0, (F.size(F.array_distinct(parts)) * 9 + F.size(parts)) / (F.size(parts) * 10.0)).otherwise(1.0)


def draw(seed: str, *parts: Column) -> Column:
    """A number above 0 and below 1 from an MD5 of the parts, nulls left out."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def weighted(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """sources(source, ...) with weight: the weights in order of code points, null last, repeating. Ranges of names are
    numbered where they are, so that any number of sources will do."""
    ordered = common.running_sums(sources.withColumn("_null", F.col("source").isNull()), [], ["_null", "source"], F.lit(1), "_upto")
    return ordered.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.col("_upto") - 1, F.lit(len(weights))) + 1).cast("int"))).drop("_null", "_upto")


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """sources(source, source_size, weight), a saved table, with target: what all have, shared by weight, each at most
    `most` times what it has and the excess shared by weight again until none is above. Each turn is two sums over the
    sources; all computing is with whole numbers up to one division at the end."""
    size, weight = F.col("source_size").cast("decimal(38,0)"), F.col("weight").cast("decimal(38,0)")
    full = F.lit(False)
    total = int(sources.agg(F.sum(size)).first()[0] or 0)
    left, share, n_full = total, Fraction(0), 0
    while left:
        open_weight = sources.filter(~full).agg(F.sum(weight)).first()[0]
        if not open_weight:  # all are full
            break
        share = Fraction(left, int(open_weight))
        above = weight * F.lit(str(share.numerator)).cast("decimal(38,0)") > size * F.lit(str(most * share.denominator)).cast("decimal(38,0)")  # shares only grow: who is above stays above
        r = sources.filter(above).agg(F.sum(size).alias("s"), F.count(F.lit(1)).alias("n")).first()
        if r["n"] == n_full:
            break
        full, n_full, left = above, r["n"], total - most * int(r["s"] or 0)
    even = F.col("weight").cast("double") * float(share.numerator) / float(share.denominator)
    return sources.withColumn("target", F.when(full, (F.col("source_size") * most).cast("double")).otherwise(even))


def mixed(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, weight_of: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, taken, cut for each row of documents(doc_id, text, source).

    size: words of the text, 0 for null. taken: words that the mix takes, epochs times the document and what falls to it
    of the rest; cut: whether the rest takes a part of it only. The sum of taken of a source is its target, rounded.
    Documents without words are never taken. Null is a source of its own and comes last; a null doc_id or text draws like an
    empty one. Repeated rows draw the same key and stand next to each other. Empty tables give no rows. Other columns are
    not read. weight_of gives each document's quality, above 0; without it, quality(text).
    """
    worth = quality(F.col("text")) if weight_of is None else weight_of
    key = -F.log(draw(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))) / worth
    sized = common.saved(documents.select("doc_id", "source", F.size(common.words(F.col("text"))).cast("long").alias("size"), key.alias("_key")), "sized")
    sources = common.saved(sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "sources")
    shared = targets(common.saved(weighted(sources, weights), "weights"), most)
    shared = shared.withColumn("_whole", F.floor(F.col("target") + 0.5).cast("long"))
    shared = shared.withColumn("epochs", F.expr("IF(source_size > 0, _whole DIV source_size, 0L)")).withColumn("_rest", F.expr("_whole - epochs * source_size"))
    shared = common.broadcast_if_small(common.saved(shared.select(F.col("source").alias("_of"), "source_size", "target", "epochs", "_rest"), "targets"))
    placed = common.running_sums(sized, ["source"], ["_key", "doc_id", "size"], F.col("size"), "_upto")
    joined = placed.join(shared, placed["source"].eqNullSafe(shared["_of"]))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("_rest") - (F.col("_upto") - F.col("size"))))
    out = joined.withColumn("_part", part)
    return out.select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + F.col("_part")).alias("taken"), ((F.col("_part") > 0) & (F.col("_part") < F.col("size"))).alias("cut"))


def sql(weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> str:
    """The same in SQL, for tables whose rows differ in doc_id."""
    even = lcm(*weights)
    cases = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return f"""WITH words AS (SELECT doc_id, source, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
        sized AS (SELECT doc_id, source, len(w)::BIGINT AS size, CASE WHEN len(w) > 0 THEN (len(list_distinct(w)) * 9 + len(w)) / (len(w) * 10.0::DOUBLE) ELSE 1.0::DOUBLE END AS worth,
            (('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / {1 << 52}::DOUBLE AS u FROM words),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
        w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {cases} END AS weight FROM s),
        r AS (SELECT *, sum(source_size) OVER o - sum(source_size) OVER p AS below, sum(weight) OVER () - sum(weight) OVER o + sum(weight) OVER p AS from_here, sum(source_size) OVER () AS total
            FROM w WINDOW o AS (ORDER BY source_size * ({even} // weight)), p AS (PARTITION BY source_size * ({even} // weight))),
        f AS (SELECT *, weight * (total - {most} * below) > {most} * source_size * from_here AS is_full FROM r),
        l AS (SELECT total - {most} * coalesce(sum(source_size) FILTER (is_full), 0) AS rest, sum(weight) FILTER (NOT is_full) AS open FROM f GROUP BY total),
        t AS (SELECT source, source_size, CASE WHEN is_full THEN ({most} * source_size)::DOUBLE ELSE weight::DOUBLE * (rest / gcd(rest, open))::DOUBLE / (open / gcd(rest, open))::DOUBLE END AS target FROM f, l),
        e AS (SELECT *, floor(target + 0.5)::BIGINT AS whole FROM t),
        k AS (SELECT d.doc_id, d.size, e.source_size, e.target, CASE WHEN e.source_size > 0 THEN e.whole // e.source_size ELSE 0 END AS epochs, e.whole,
            sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.worth, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS before
            FROM sized AS d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
        p AS (SELECT *, greatest(0, least(size, whole - epochs * source_size - before)) AS part FROM k)
        SELECT doc_id, size, source_size, target, (epochs * size + part)::BIGINT AS taken, epochs::BIGINT AS epochs, part > 0 AND part < size AS cut FROM p"""
