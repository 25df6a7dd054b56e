"""Names, labels and notes turned into columns, as SQL expressions and line tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What file names say about platforms.
PLATFORM_MARKS = {
    "android": r"\.(?:apk|aab)$|android",
    "ios": r"\.ipa$|ios",
    "linux": r"\.(?:deb|rpm)$|linux",
    "macos": r"\.(?:dmg|pkg)$|macos|darwin",
    "windows": r"\.(?:exe|msi)$|win(?:32|64)|windows",
}


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group, NULL where the pattern is not found."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def release_name(name: Column) -> Column:
    """struct(channel, version, engine) of a release's name; the flag on the release says nothing of the channel."""
    tidy = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))
    word = F.lower(_found(tidy, r"(?i)\A(Release|Beta|Nightly|Dev) v?[0-9]+\.[0-9]+\.[0-9]+"))
    version = F.coalesce(_found(tidy, r"(?i)\A(?:Release|Beta|Nightly|Dev) v?([0-9]+\.[0-9]+\.[0-9]+)"), _found(tidy, r"v?([0-9]+\.[0-9]+\.[0-9]+)"))
    engine = _found(tidy, r"(?i)Chromium[: ]+([0-9]+(?:\.[0-9]+){3})")
    return F.struct(F.when(word != "dev", word).alias("channel"), version.alias("version"), engine.alias("engine"))


def asset_platforms(names: Column) -> Column:
    """Platforms of an array of file names, distinct and sorted."""

    def any_name(pattern: str) -> Column:
        return F.exists(names, lambda n: F.lower(n).rlike(pattern))

    tests = [F.when(any_name(p), F.lit(platform)) for platform, p in sorted(PLATFORM_MARKS.items())]
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def qa_facts(labels: Column) -> Column:
    """struct(passed, failed, required, blocked) of labels; required is unknown without a label for it, and the last
    such label counts."""

    def after(pattern: str) -> Column:
        return F.filter(F.transform(labels, lambda x: F.trim(F.regexp_extract(x, pattern, 1))), lambda x: x != "")

    asked = F.filter(labels, lambda x: x.rlike(r"(?i)\AQA/(?:Yes|No)\z"))
    required = F.when(F.size(asked) > 0, F.lower(F.element_at(asked, -1)) == "qa/yes")
    blocked = F.exists(labels, lambda x: x.rlike(r"(?i)\AQA/Blocked\z"))
    return F.struct(after(r"(?i)\AQA\s*Pass\s*-?\s*(.+)\z").alias("passed"), after(r"(?i)\AQA\s*Fail(?:ed)?\s*-?\s*(.+)\z").alias("failed"), required.alias("required"), blocked.alias("blocked"))


def os_platforms(labels: Column) -> Column:
    """Platforms that labels of the form OS/name declare, in order of first mention."""
    names = F.filter(F.transform(labels, lambda x: F.lower(F.regexp_extract(x, r"(?i)\AOS/(.+)\z", 1))), lambda x: x != "")
    platform = lambda x: F.when(F.contains(x, F.lit("android")), "android").when(F.contains(x, F.lit("ios")), "ios").when(x.rlike("desktop|windows|linux|mac"), "desktop")
    return F.array_distinct(F.filter(F.transform(names, platform), lambda x: x.isNotNull()))


def milestone_line(title: Column) -> Column:
    """struct(line, channel) of a title such as `1.97.x - Release`."""
    return F.struct(_found(title, r"([0-9]+\.[0-9]+)\.x").alias("line"), F.lower(_found(title, r"(?i)-\s*(Release|Beta|Nightly)")).alias("channel"))


def is_release_branch(ref: Column) -> Column:
    return F.coalesce(ref.rlike(r"\A[0-9]+\.[0-9]+\.x\z"), F.lit(False))


def note_entries(texts: DataFrame) -> DataFrame:
    """texts(file, text) of bulleted notes -> file, line (from 1), version, section, entry: a level-2 heading with a
    version opens it, a level-3 heading is its section, bullets are entries, other headings close the version. Notes
    are numbered and carried forward within their file."""
    lines = texts.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("at", "raw")).withColumn("line", F.col("at") + 1)
    heading = F.col("raw").rlike(r"\A##? ")
    version = F.when(heading, F.coalesce(_found(F.col("raw"), r"\A## \[?v?([0-9]+(?:\.[0-9]+)+)"), F.lit("")))
    section = F.when(heading, F.lit("")).otherwise(_found(F.col("raw"), r"\A### (.+?)\s*\z"))
    upto = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    carried = lines.select("file", "line", "raw", F.nullif(F.last(version, ignorenulls=True).over(upto), F.lit("")).alias("version"), F.nullif(F.last(section, ignorenulls=True).over(upto), F.lit("")).alias("section"))
    entry = _found(F.col("raw"), r"\A\s*[-*+] (.+?)\s*\z")
    return carried.filter("version IS NOT NULL").select("file", "line", "version", "section", entry.alias("entry")).filter("entry IS NOT NULL")


def lock_packages(texts: DataFrame) -> DataFrame:
    """texts(ref, text) of lock files -> ref, name, version, source, dependencies (names)."""
    blocks = texts.select("ref", F.explode(F.split("text", r"\[\[package\]\]")).alias("b"))
    listed = F.regexp_extract("b", r"(?s)dependencies = \[(.*?)\]", 1)
    names = F.transform(F.regexp_extract_all(listed, F.lit('"([^"]+)"'), F.lit(1)), lambda d: F.substring_index(d, " ", 1))
    return blocks.select("ref", _found(F.col("b"), r'name = "([^"]+)"').alias("name"), _found(F.col("b"), r'version = "([^"]+)"').alias("version"), _found(F.col("b"), r'source = "([^"]+)"').alias("source"), names.alias("dependencies")).filter("name IS NOT NULL")


def name_key(name: Column) -> Column:
    """Package names alike in case, - and _."""
    return F.translate(F.lower(name), "_", "-")
