"""Advisories against the packages of builds, three-valued: what was not proven stays unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.kleene import kleene_any
from factloom.functions.parse import name_key
from factloom.functions.versions import range_bounds, version_bytes
from factloom.operators import intervals
from factloom.operators.rule_index import having
from factloom.sources.tables import paired, saved


def attribute_ranges(advisories: DataFrame) -> DataFrame:
    """advisory_id, package, ecosystem, range: each range of advisories(advisory_id, packages: array of (ecosystem, name),
    ranges) goes to the longest package name that it starts with; else, where the lists line up, to the package at its
    place. A name that several ecosystems share, or no package, leaves package NULL (unattributed)."""
    one = advisories.select("advisory_id", "packages", F.posexplode_outer("ranges").alias("at", "raw"))
    named = F.filter("packages", lambda p: F.lower(F.col("raw")).startswith(F.concat(F.lower(p["name"]), F.lit(" "))))
    longest = F.array_max(F.transform(named, lambda p: F.length(p["name"])))
    best = F.filter(named, lambda p: F.length(p["name"]) == longest)
    only = F.when(F.size(F.array_distinct(F.transform(best, lambda p: p["ecosystem"]))) == 1, best[0])
    by_place = F.when((F.size(named) == 0) & (F.size("packages") == F.col("_n")), F.try_element_at("packages", F.col("at") + 1))
    chosen = one.join(advisories.select("advisory_id", F.size("ranges").alias("_n")), "advisory_id").withColumn("p", F.coalesce(only, by_place)).withColumn("by_name", only.isNotNull())
    text = F.when(F.col("by_name"), F.trim(F.expr("substring(raw, length(p.name) + 1)"))).otherwise(F.col("raw"))
    return chosen.select("advisory_id", F.col("p.name").alias("package"), F.col("p.ecosystem").alias("ecosystem"), text.alias("range"))


def linked_versions(packages: DataFrame) -> DataFrame:
    """snapshot, name, version, linked: rows(snapshot, name, version, reachable) by package version, three-valued: linked if
    it is surely reached."""
    return packages.groupBy("snapshot", name_key(F.col("name")).alias("name"), "version").agg(kleene_any(F.col("reachable")).alias("linked"))


def exposure(ranges: DataFrame, linked: DataFrame) -> DataFrame:
    """advisory_id, snapshot, affected: three-valued, from ranges(advisory_id, package, range) and linked(snapshot, name,
    version, linked), for each snapshot that has the package. In range and linked: true. In range and possibly linked, or a
    range or version that cannot be read: unknown.

    Versions and ranges are parsed once each. Ranges meet blocks of versions (see intervals), in which the links of each
    snapshot are put together before, so that no pair of a range and a version is made."""
    held = ranges.select("advisory_id", name_key(F.col("package")).alias("name"), "range").filter("name IS NOT NULL")
    kinds = saved(held.select("name", "range").distinct().select("name", "range", range_bounds(F.col("range")).alias("b")).select("*", F.xxhash64("name", "range").alias("range_id"), "b.*").drop("b"), "ranges")
    rows = saved(linked.join(kinds.select("name").distinct(), "name", "left_semi").select("snapshot", "name", version_bytes(F.col("version")).alias("key"), "linked"), "versions")
    read = rows.filter("key IS NOT NULL")
    places = intervals.numbered(read, "name", "key")
    n = intervals.levels(places)
    spans = intervals.intervals(kinds, places, "name", "key", "range_id")
    wanted = spans.select("name", "range_id", F.explode(intervals.blocks_of(F.col("first"), F.col("upto"), n)).alias("at")).select("name", "range_id", "at.*")
    at = read.join(places, ["name", "key"]).select("name", "snapshot", "linked", F.explode(intervals.above(F.col("place"), n)).alias("at")).select("name", "snapshot", "linked", "at.*")
    inside = at.groupBy("name", "level", "block", "snapshot").agg(kleene_any(F.col("linked")).alias("linked"))
    met = wanted.join(inside, ["name", "level", "block"]).select("range_id", "name", "snapshot", "linked")
    met = met.join(kinds.select("range_id", "name", "doubt"), ["range_id", "name"]).select("range_id", "name", "snapshot", F.when(~F.col("doubt"), F.col("linked")).when(~F.col("linked"), False).alias("v"))
    odd = rows.filter("key IS NULL").groupBy("name", "snapshot").agg(kleene_any(F.col("linked")).alias("linked")).withColumn("v", F.when(~F.col("linked"), False))
    there = rows.select("name", "snapshot").distinct()
    every = kinds.select("range_id", "name").join(there, "name").select("range_id", "name", "snapshot", F.lit(False).alias("v"))
    every = every.unionByName(met).unionByName(kinds.select("range_id", "name").join(odd, "name").select("range_id", "name", "snapshot", "v"))
    by_range = every.groupBy("range_id", "name", "snapshot").agg(kleene_any(F.col("v")).alias("v"))
    of = held.join(kinds.select("range_id", F.col("name").alias("_name"), F.col("range").alias("_range")), (F.col("name") == F.col("_name")) & F.col("range").eqNullSafe(F.col("_range"))).select("advisory_id", "range_id", "name").distinct()
    return of.join(by_range, ["range_id", "name"]).groupBy("advisory_id", "snapshot").agg(kleene_any(F.col("v")).alias("affected"))


def advisory_verdict(advisories: DataFrame, exposed: DataFrame, builds: DataFrame) -> DataFrame:
    """advisory_id, affected, reasons: strict coverage of builds(build_id, snapshot, main: whether it is the main branch).

    affected: true if any build is; else unknown if a build's snapshot was not read, a verdict is unknown, the advisory
    cannot be attributed or checked (checkable false), or only the main branch was read; else false. reasons: sorted codes.
    """
    every = paired(advisories.select("advisory_id", "checkable"), builds).join(exposed.withColumn("_read", F.lit(True)), ["advisory_id", "snapshot"], "left")
    found = every.withColumn("v", F.when(F.col("snapshot").isNull(), None).otherwise(F.coalesce("affected", F.when(F.col("_read").isNull(), False))))
    reason = F.array_compact(F.array(F.when(F.col("snapshot").isNull(), "build-not-read"), F.when(F.col("_read") & F.col("affected").isNull(), "possibly-affected")))
    agg = found.groupBy("advisory_id", "checkable").agg(kleene_any(F.col("v")).alias("v"), F.flatten(F.collect_set(reason)).alias("r"), F.coalesce(F.bool_or(F.col("snapshot").isNotNull() & ~F.col("main")), F.lit(False)).alias("_released"))
    more = F.array_compact(F.array(F.when(~F.col("checkable"), "not-checkable"), F.when(~F.col("_released"), "main-branch-only")))
    verdict = F.when(F.col("v"), True).when(~F.col("checkable") | ~F.col("_released"), None).otherwise(F.col("v"))
    return agg.select("advisory_id", verdict.alias("affected"), F.when(verdict.isNull(), F.array_sort(F.array_distinct(F.concat("r", more)))).otherwise(F.array().cast("array<string>")).alias("reasons"))


def server_exposure(advisories: DataFrame, methods: DataFrame) -> DataFrame:
    """advisory_id, methods: names of methods(name) that the summary of a server-side advisory has, in snake_case or
    camelCase; the verdict stays unknown."""
    named = F.transform(F.regexp_extract_all("summary", F.lit(r"[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)*"), F.lit(0)), lambda m: F.lower(F.replace(m, F.lit("_"), F.lit(""))))
    words = advisories.select("advisory_id", F.explode_outer(F.array_distinct(named)).alias("_key"))
    known = methods.select("name", F.lower(F.replace("name", F.lit("_"), F.lit(""))).alias("_key"))
    return words.join(known, "_key", "left").groupBy("advisory_id").agg(F.array_sort(F.collect_set("name")).alias("methods"), F.lit(None).cast("boolean").alias("affected"))


def merge_declarations(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One value a key; NULL where declarations disagree, an unknown one being a value of its own."""
    differ = F.count_distinct(F.coalesce(F.col(value).cast("string"), F.lit("?"))) > 1
    return rows.groupBy(*keys).agg(F.when(~differ, F.max(value)).alias(value))


def list_covers(records: DataFrame, names: DataFrame) -> DataFrame:
    """snapshot, usable: whether the list names(snapshot, name) has every name of the snapshot's own records; a list that
    misses one cannot be trusted."""
    missing = records.join(names, ["snapshot", "name"], "left_anti").select("snapshot").distinct().withColumn("_missing", F.lit(True))
    return records.select("snapshot").distinct().join(missing, "snapshot", "left").select("snapshot", F.col("_missing").isNull().alias("usable"))


def proven_absent(wanted: DataFrame, names: DataFrame, lists: DataFrame) -> DataFrame:
    """snapshot, name, absent of wanted(snapshot, name): false if names(snapshot, name) has it; true only if lists(snapshot,
    complete, consistent, ambiguous) says that the list is complete, consistent and unambiguous; else unknown."""
    there = names.select("snapshot", "name").distinct().withColumn("_there", F.lit(True))
    full = lists.select("snapshot", (F.col("complete") & F.col("consistent") & ~F.col("ambiguous")).alias("_full"))
    verdict = F.when(F.col("_there"), False).when(F.col("_full"), True)
    return wanted.join(there, ["snapshot", "name"], "left").join(full, "snapshot", "left").select("snapshot", "name", verdict.alias("absent"))


def adoption(terms: DataFrame, packages: DataFrame, mentions: DataFrame) -> DataFrame:
    """term, verdict of terms(term): evidence where a package name or a mention has it; unknown (NULL) where a text of
    mentions(text, complete) could not be read in full; else none-found. Any number of terms."""
    names = packages.select("name").distinct().select(F.col("name").alias("text_id"), F.col("name").alias("text"))
    by_name = having(names, terms).select("term")
    texts = saved(mentions.filter("text IS NOT NULL").select(F.monotonically_increasing_id().alias("text_id"), "text"), "mentions")
    by_text = having(texts, terms).select("term")
    found = by_name.union(by_text).distinct().withColumn("_found", F.lit(True))
    whole = mentions.agg(F.coalesce(F.bool_and(F.col("complete") & F.col("text").isNotNull()), F.lit(True)).alias("_whole"))
    return terms.select("term").distinct().join(found, "term", "left").crossJoin(whole).select("term", F.when(F.col("_found"), "evidence").when(F.col("_whole"), "none-found").alias("verdict"))  # one row


def resolved_version(linked: DataFrame, key) -> DataFrame:
    """snapshot, name, highest (the highest version surely linked), versions (all of those), possible (any other)."""
    sure = F.when(F.col("linked"), F.col("version"))
    return linked.groupBy("snapshot", "name").agg(F.max_by(sure, F.when(F.col("linked"), key(F.col("version")))).alias("highest"), F.array_sort(F.collect_set(sure)).alias("versions"), F.array_sort(F.collect_set(F.when(F.col("linked").isNull(), F.col("version")))).alias("possible"))


def adopted(resolved: DataFrame, wanted: str, key) -> DataFrame:
    """resolved with adopted: at least the wanted version, three-valued: unknown where a possible version may be."""
    want = key(F.lit(wanted))
    maybe = F.exists("possible", lambda v: key(v) >= want)
    return resolved.withColumn("adopted", F.when(key(F.col("highest")) >= want, True).when(maybe | F.col("highest").isNull(), None).otherwise(False))


def limitations(status: DataFrame, warnings: DataFrame) -> DataFrame:
    """text: distinct `source: limitation` of status(source_id, limitations) and warnings(text)."""
    own = status.select(F.explode("limitations").alias("l"), "source_id").select(F.concat_ws(": ", "source_id", "l").alias("text"))
    return own.unionByName(warnings.select("text")).distinct()


def lowest_version(pointers: DataFrame, keys: list[str], key) -> DataFrame:
    """keys, version, pointer of pointers(keys, pointer, version, carried, not_published): the lowest version; a carried
    'not published' does not count where another pointer was read; ties by name."""
    counts = ~(F.col("carried") & F.col("not_published"))
    some = F.max(counts.cast("int"))
    by = F.struct(key(F.col("version")), F.col("pointer"))
    pick = lambda column: F.when(some == 1, F.min_by(column, F.when(counts & F.col("version").isNotNull(), by))).otherwise(F.min_by(column, F.when(F.col("version").isNotNull(), by)))
    return pointers.groupBy(*keys).agg(pick("version").alias("version"), pick("pointer").alias("pointer"))


def worst(verdict: Column) -> Column:
    """A label for a three-valued verdict."""
    return F.when(verdict, "affected").when(verdict.isNull(), "unknown").otherwise("not-affected")
