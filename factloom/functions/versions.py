"""Sort keys for dotted versions and SemVer, and range tests, as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def version_key(version: Column) -> Column:
    """Array of (length, digits) by part, leading zeros and trailing zero parts put aside; sorts as numbers of any
    length do, and 1.2 equals 1.2.0. A part with other characters sorts after numbers, by its text."""
    parts = F.split(F.regexp_replace(F.trim(version), r"\Av|(?:\.0+)+\z", ""), r"\.")

    def part(p: Column) -> Column:
        digits = F.regexp_replace(p, r"\A0+", "")
        number = p.rlike(r"\A[0-9]+\z")
        return F.struct((~number).alias("text"), F.when(number, F.length(digits)).otherwise(0).alias("n"), F.when(number, digits).otherwise(p).alias("d"))

    return F.transform(parts, part)


def semver_key(version: Column) -> Column:
    """version_key of the release, then releases above pre-releases, then pre-release parts in order; what follows + is
    not looked at."""
    bare = F.regexp_replace(version, r"\+.*\z", "")
    release, pre = F.regexp_extract(bare, r"\Av?([^-]*)", 1), F.regexp_extract(bare, r"\A[^-]*-(.*)\z", 1)
    return F.struct(version_key(release).alias("release"), (pre == "").alias("final"), version_key(pre).alias("pre"))


READABLE = r"\Av?[0-9]+(\.[0-9]+)*\z"


def version_bytes(version: Column) -> Column:
    """A string whose order is that of version_key, for versions of numbers; NULL for others. Each part is its number of
    digits and its digits, so that parts need no separator and longer numbers sort behind shorter ones."""
    parts = F.split(F.regexp_replace(version, r"\Av|(?:\.0+)+\z", ""), r"\.")
    part = lambda p: F.concat(F.lpad(F.length(p).cast("string"), 4, "0"), p)
    return F.when(version.rlike(READABLE), F.array_join(F.transform(parts, lambda p: part(F.regexp_replace(p, r"\A0+", ""))), ""))


def range_bounds(text: Column) -> Column:
    """A range such as `>= 1.2, < 2`, read once: struct(low, low_open, high, high_open, doubt), bounds as version_bytes and NULL
    where there is none. As comparators are tried in turn, those before the first that cannot be read make the bounds,
    and doubt says that there is such a one, or that the range has no comparator at all: a version outside is
    not in the range, one inside is, or is unknown in doubt."""
    shape = r"\A(<=|>=|==|=|<|>)?\s*(v?[0-9]+(?:\.[0-9]+)*)\z"
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    read = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, shape, 1).alias("op"), F.when(p.rlike(shape), version_bytes(F.regexp_extract(p, shape, 2))).alias("key")))
    unread = F.array_position(F.transform(read, lambda c: c["key"].isNull()), True)
    sure = F.when(unread > 0, F.slice(read, F.lit(1), F.greatest(unread.cast("int") - 1, F.lit(0)))).otherwise(read)
    upper, lower = ("<", "<="), (">", ">=")
    low = F.array_max(F.transform(F.filter(sure, lambda c: ~c["op"].isin(*upper)), lambda c: F.struct(c["key"].alias("key"), (c["op"] == ">").alias("open"))))
    high = F.array_min(F.transform(F.filter(sure, lambda c: ~c["op"].isin(*lower)), lambda c: F.struct(c["key"].alias("key"), (c["op"] != "<").alias("closed"))))
    doubt = F.coalesce(unread > 0, F.lit(True)) | (F.coalesce(F.size(parts), F.lit(0)) <= 0)
    return F.struct(low["key"].alias("low"), low["open"].alias("low_open"), high["key"].alias("high"), (~high["closed"]).alias("high_open"), doubt.alias("doubt"))


def satisfies(version: Column, operator: Column, bound: Column) -> Column:
    """One comparator; NULL where either side cannot be read as a version."""
    ok = version.rlike(r"\Av?[0-9]+(\.[0-9]+)*\z") & bound.rlike(r"\Av?[0-9]+(\.[0-9]+)*\z")
    a, b = version_key(version), version_key(bound)
    met = F.when(operator == "<", a < b).when(operator == "<=", a <= b).when(operator == ">", a > b).when(operator == ">=", a >= b).when(operator.isin("=", "=="), a == b)
    return F.when(ok, met)


def satisfies_range(version: Column, text: Column) -> Column:
    """Whether a version meets every comparator of a range such as `>= 1.2, < 2`: comma-separated, `v` allowed, no
    operator meaning equal. The first comparator that fails or cannot be read decides: false or NULL; no range is NULL."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    shape = r"\A(<=|>=|==|=|<|>)?\s*(v?[0-9]+(?:\.[0-9]+)*)\z"

    def one(p: Column) -> Column:
        operator = F.regexp_extract(p, shape, 1)
        met = satisfies(version, F.when(operator == "", "=").otherwise(operator), F.regexp_extract(p, shape, 2))
        return F.when(~p.rlike(shape) | met.isNull(), F.lit(2)).when(met, F.lit(1)).otherwise(F.lit(0))

    first = F.aggregate(parts, F.lit(1), lambda a, p: F.when(a == 1, one(p)).otherwise(a))
    return F.when(F.size(parts) > 0, F.when(first == 1, True).when(first == 0, False))


def in_version_range(version: Column, low: Column, high: Column) -> Column:
    """From low to high, where a bound may end in `*`: every part there, 0 in the lower and the largest in the upper bound;
    a NULL bound is open; a version that cannot be read is unknown."""
    key = version_key(version)
    below = version_key(F.regexp_replace(low, r"\*", "0"))
    above = version_key(F.regexp_replace(high, r"\*", "999999999"))
    inside = F.coalesce(key >= below, F.lit(True)) & F.coalesce(key <= above, F.lit(True))
    return F.when(version.rlike(r"\Av?[0-9]+(\.[0-9]+)*\z"), inside)
