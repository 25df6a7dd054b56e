"""References, addresses, labels and rules of items, as SQL expressions and line tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import decode_numeric  # noqa: F401  (also by this name)
from factloom.sources.tables import broadcast_if_small, paired


def item_id(repo: Column, number: Column) -> Column:
    return F.concat(F.lower(repo), F.lit("#"), number.cast("string"))


def parse_item_id(id: Column) -> Column:
    """struct(repo, number) of `owner/name#12`; NULL for anything else."""
    good = id.rlike(r"\A[^#\s]+#[0-9]+\z")
    return F.when(good, F.struct(F.substring_index(id, "#", 1).alias("repo"), F.substring_index(id, "#", -1).cast("long").alias("number")))


def item_url(id: Column, kind: Column, base: str) -> Column:
    p = parse_item_id(id)
    return F.concat(F.lit(base.rstrip("/") + "/"), p["repo"], F.when(kind == "pr", "/pull/").otherwise("/issues/"), p["number"].cast("string"))


def branch_ref(head: Column, prefix: str = "[A-Za-z]+") -> Column:
    """The issue that a branch is named after: `word_12345` or `word_12345_2`, five or six digits."""
    found = F.regexp_extract(head, rf"\A{prefix}_([0-9]{{5,6}})(?:_[0-9]+)?\z", 1)
    return F.when(found != "", found.cast("long"))


def pr_number(message: Column) -> Column:
    """The pull request of a commit's message, from its first line: `(#12)` at its end, else `Merge pull request #12` at its
    beginning, else the first `(#12)`."""
    first = F.substring_index(message, "\n", 1)
    tries = [F.regexp_extract(first, p, 1) for p in (r"\(#([0-9]+)\)\s*\z", r"\AMerge pull request #([0-9]+)", r"\(#([0-9]+)\)")]
    return F.coalesce(*[F.when(t != "", t.cast("long")) for t in tries])


def uplift_refs(body: Column, title: Column, head: Column, repo: Column) -> Column:
    """What an uplift was made from: lines `uplift of #12` (from, for, part of; or a pull request's address), list lines
    `- #12 - `, the title `Uplift of #12`, and the branch `pr12_name_1.2.x`; distinct, in that order. Other references of a
    text do not count."""
    return F.array_distinct(uplift_mentions(body, title, head, repo))


def uplift_mentions(body: Column, title: Column, head: Column, repo: Column) -> Column:
    """What uplift_refs finds, each place of the text apart: what is named twice comes twice."""
    text, own = F.coalesce(body, F.lit("")), lambda n: F.concat(F.lower(repo), F.lit("#"), n)
    said = r"(?im)^[ \t]*+[-*]?[ \t]*+uplift(?:ed)?\s++(?:of|from|for|part of)\s++(?:#|https?://[^/\s]{1,200}+/[\w.-]++/[\w.-]++/pull/)([0-9]+)"
    some = lambda text, pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), own)
    titled = some(F.coalesce(title, F.lit("")), r"(?i)\Auplift (?:of )?#([0-9]+)")
    branch = some(F.coalesce(head, F.lit("")), r"\Apr([0-9]+)_.+_[0-9]+\.[0-9]+\.x\z")
    return F.concat(some(text, said), some(text, r"(?m)^- #([0-9]+) - "), titled, branch)


def duplicate_from_comments(comments: DataFrame) -> DataFrame:
    """id, number: of comments(id, position, text, own: the item's number) the newest that says `duplicate of` (with, in
    favour of) another item, as `#12`, `owner/name#12` or an address. One that hedges in the 30 characters before, with no
    full stop between, or speaks of a possible duplicate anywhere, says nothing."""
    shape = r"(?is)\A.*?duplicate (?:of|with|in favou?r of)\s++(?:https?://[^/\s]{1,200}+/[\w.-]++/[\w.-]++/issues/|[\w.-]++/[\w.-]++#|#)([0-9]+)"
    number = F.regexp_extract("text", shape, 1)
    before = F.regexp_extract("text", r"(?is)\A(.*?)duplicate (?:of|with|in favou?r of)\s++(?:https?://[^/\s]{1,200}+/[\w.-]++/[\w.-]++/issues/|[\w.-]++/[\w.-]++#|#)[0-9]+", 1)
    hedged = F.lower(F.right(before, F.lit(30))).rlike(r"(?s)\b(?:not|possibl[ey]|maybe|might|may|could|potential(?:ly)?|likely)\b[^.]*\z") | F.contains(F.lower("text"), F.lit("possible duplicate"))
    found = comments.withColumn("number", F.when((number != "") & ~hedged, number.cast("long"))).filter("number IS NOT NULL AND number <> own")
    return found.groupBy("id").agg(F.max_by("number", "position").alias("number"))


def safe_url(url: Column) -> Column:
    """The address if it is http or https with a host, else NULL."""
    return F.when(url.rlike(r"(?i)\Ahttps?://[^\s/?#\"'<>]+[^\s\"'<>]*\z"), url)


def safe_target(url: Column) -> Column:
    """A path of the same site, or an https address; else NULL."""
    return F.when(url.rlike(r"\A/(?!/)[^\s\"'<>]*\z") | url.rlike(r"(?i)\Ahttps://[^\s/?#\"'<>]+[^\s\"'<>]*\z"), url)


def ago_text(at: Column, now: Column) -> Column:
    """just now, minutes, hours or days ago; NULL stays NULL."""
    minutes = F.timestamp_diff("MINUTE", at, now)
    unit = lambda n, name: F.concat(n.cast("string"), F.when(n == 1, f" {name} ago").otherwise(f" {name}s ago"))
    return F.when(minutes < 1, "just now").when(minutes < 60, unit(minutes, "minute")).when(minutes < 1440, unit(F.floor(minutes / 60), "hour")).otherwise(unit(F.floor(minutes / 1440), "day"))


def share_percent(part: Column, total: Column) -> Column:
    """A share in percent with two decimals; NULL of nothing."""
    return F.when(total > 0, F.concat(F.format_number(100 * part / total, 2), F.lit("%")))


def short_ref(id: Column) -> Column:
    """`name#12` of `owner/name#12`."""
    return F.regexp_replace(id, r"\A[^/]*/", "")


def excluded_reason(title: Column, meta: str, strong: str) -> Column:
    """Why a row is left out: a title of a meta issue that names no strong term; else NULL."""
    return F.when(title.rlike(meta) & ~title.rlike(strong), "meta issue")


def note_versions(texts: DataFrame) -> DataFrame:
    """texts(file, text) -> file, nth (from 1), version: versions of notes in the order of their headings; the first is the
    latest."""
    from pyspark.sql import Window

    lines = texts.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("at", "raw"))
    named = lines.withColumn("version", F.regexp_extract("raw", r"\A## \[?v?([0-9]+(?:\.[0-9]+)+)", 1)).filter("version <> ''")
    return named.select("file", F.row_number().over(Window.partitionBy("file").orderBy("at")).alias("nth"), "version")


def constants(texts: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """texts(file, text) -> file, name, value: all first groups of each named pattern, distinct."""
    from functools import reduce

    parts = [texts.select("file", F.lit(name).alias("name"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(1)))).alias("value")) for name, p in patterns.items()]
    return reduce(DataFrame.unionByName, parts)


def probe(texts: DataFrame, checks: DataFrame, signature: str) -> DataFrame:
    """ref, check_id, present, file, line, signature: checks(check_id, pattern, file, file_rank) against texts(ref, file,
    text): the first matching line of the first candidate file by rank; absent where all candidates that exist were read
    without one; unknown (NULL) where none exists."""
    refs = paired(texts.select("ref").distinct(), checks.select("check_id").distinct())
    lines = texts.join(broadcast_if_small(checks), "file").select("ref", "check_id", "file", "file_rank", F.posexplode(F.split("text", r"\r?\n")).alias("at", "raw"), "pattern")
    hit = F.min(F.when(F.rlike(F.col("raw"), F.col("pattern")), F.struct("file_rank", F.col("at"), "file"))).alias("hit")
    found = lines.groupBy("ref", "check_id").agg(hit, F.lit(True).alias("read"))
    return refs.join(found, ["ref", "check_id"], "left").select("ref", "check_id", F.when(F.col("hit").isNotNull(), True).when(F.col("read"), False).alias("present"), F.col("hit.file").alias("file"), (F.col("hit.at") + 1).alias("line"), F.lit(signature).alias("signature"))


def is_package_name(name: Column) -> Column:
    return F.coalesce(name.rlike(r"\A(?:@[a-z0-9][a-z0-9._-]*/)?[A-Za-z0-9][A-Za-z0-9._-]*\z"), F.lit(False))


def split_package(package: Column) -> Column:
    """struct(ecosystem, name) of `ecosystem:name`; without one the ecosystem is NULL."""
    has = F.contains(package, F.lit(":"))
    return F.struct(F.when(has, F.lower(F.substring_index(package, ":", 1))).alias("ecosystem"), F.when(has, F.regexp_replace(package, r"\A[^:]*:", "")).otherwise(package).alias("name"))


def qa_platform(name: Column) -> Column:
    """The platform that the name behind a QA label means: every desktop system is desktop."""
    lower = F.lower(name)
    return F.when(F.contains(lower, F.lit("android")), "android").when(lower.rlike("ios|iphone|ipad"), "ios").when(lower.rlike("win|mac|linux|desktop"), "desktop")
