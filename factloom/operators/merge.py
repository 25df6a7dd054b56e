"""Snapshot merging: ledgers, upserts, carry-forward, archives and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ledger_of_snapshots(sightings: DataFrame, snapshots: DataFrame, keys: list[str], at: str) -> DataFrame:
    """First and last snapshot in which each fact was seen, in how many, and the snapshot that found it gone.

    sightings(*keys, at): a fact per snapshot, repeats allowed. snapshots(at): every snapshot that was taken. A fact
    of the last snapshot is not gone (NULL). The snapshot list is one row a snapshot, not a row a fact.
    """
    following = snapshots.select(F.col(at).alias("_last")).distinct()
    following = following.withColumn("gone_since", F.lead("_last").over(Window.orderBy("_last")))
    seen = sightings.groupBy(*keys).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count_distinct(at).alias("times_seen"))
    return seen.join(following, seen["last_seen"] == following["_last"], "left").drop("_last")


def merge_evidence(ledger: DataFrame, tracked: DataFrame, present: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """One step of the ledger (keys, first_seen, last_seen, gone_since): tracked rows are new or seen again; a ledger
    row that is not tracked is refreshed if it is present, else gone from now unless it was gone before."""
    seen = tracked.select(*keys).distinct().withColumn("_tracked", F.lit(True))
    here = present.select(*keys).distinct().withColumn("_present", F.lit(True))
    both = ledger.join(seen, keys, "full_outer").join(here, keys, "left")
    alive = F.col("_tracked").isNotNull() | F.col("_present").isNotNull()
    return both.select(
        *keys,
        F.coalesce("first_seen", now).alias("first_seen"),
        F.when(alive, now).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(~alive, F.coalesce("gone_since", now)).alias("gone_since"),
    )


def merge_with_hold(ledger: DataFrame, tracked: DataFrame, present: DataFrame, keys: list[str], now: Column, unread: DataFrame, part: str) -> DataFrame:
    """merge_evidence for what was read; rows of unread parts stay as they are."""
    held = ledger.join(unread.select(part).distinct(), part, "left_semi")
    rest = merge_evidence(ledger.join(unread, part, "left_anti"), tracked.join(unread, part, "left_anti"), present, keys, now)
    return rest.unionByName(held.select(*rest.columns))


def upsert(previous: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """previous and fresh by key; where both have one, the fresh row. One row a key on each side."""
    kept = previous.join(fresh.select(*keys), keys, "left_anti")
    return kept.unionByName(fresh)


def carry_forward(previous: DataFrame, fresh: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """What becomes of each row of previous: in_next, removed, or carried."""
    got = fresh.select(*keys).distinct().withColumn("_in", F.lit(True))
    gone = removed.select(*keys).distinct().withColumn("_out", F.lit(True))
    fate = F.when(F.col("_in").isNotNull(), "in_next").when(F.col("_out").isNotNull(), "removed").otherwise("carried")
    return previous.join(got, keys, "left").join(gone, keys, "left").withColumn("fate", fate).drop("_in", "_out")


def keep_unchanged(previous: DataFrame, fresh: DataFrame, keys: list[str], ignore: list[str]) -> DataFrame:
    """fresh, but with the stored row where nothing outside `ignore` changed; `changed` says which."""
    columns = [c for c in fresh.columns if c not in keys and c not in ignore]
    old = previous.select(*keys, F.xxhash64(*columns).alias("_hash"), *[F.col(c).alias(f"_{c}") for c in ignore])
    joined = fresh.withColumn("_new", F.xxhash64(*columns)).join(old, keys, "left")
    same = F.coalesce(F.col("_hash") == F.col("_new"), F.lit(False))
    kept = [F.when(same, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in ignore else F.col(c) for c in fresh.columns]
    return joined.select(*kept, (~same).alias("changed"))


def versions_of(history: DataFrame, key: str, at: list[str], value: str) -> DataFrame:
    """Slowly changing rows: each run of one value of a key, from its first row to the first row of the next value."""
    order = Window.partitionBy(key).orderBy(*at)
    steps = history.withColumn("_before", F.lag(value).over(order)).filter(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.col(value)))
    return steps.select(key, value, F.col(at[0]).alias("valid_from"), F.lead(at[0]).over(order).alias("valid_to"))


def carry_with_expiry(rows: DataFrame, key: str, at: str, value: str, days: int) -> DataFrame:
    """The last known value of each key, for as many days after it was read; then NULL."""
    order = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("read"), F.col(value).alias("value"))), ignorenulls=True).over(order)
    return rows.withColumn("_last", last).withColumn("carried", F.when(F.date_diff(at, F.col("_last.read")) <= days, F.col("_last.value"))).drop("_last")


def newest(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in an order that tells rows apart."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def listing_digest(rows: DataFrame, key: str, name: str) -> DataFrame:
    """key, digest, n: one digest of all names of a key, whatever their order. It is made of sums of their hashes, so that
    parts of a listing are summed where they are and no list comes to one task."""
    half = lambda at: F.sum(F.conv(F.substring(F.md5(F.col(name).cast("binary")), at, 12), 16, 10).cast("long"))
    return rows.groupBy(key).agg(F.md5(F.concat_ws("|", half(1), half(13), F.count(F.lit(1))).cast("binary")).alias("digest"), F.count(F.lit(1)).alias("n"))


def pending_files(listing: DataFrame, previous: DataFrame, key: str, name: str) -> DataFrame:
    """Of listing and previous(key, name, hash): the files to read again, in listings whose digest differs and whose own
    hash is new or other than before."""
    named = lambda df: df.withColumn("_name", F.concat_ws(":", name, "hash"))
    now, old = (listing_digest(named(df), key, "_name").select(key, F.col("digest").alias(d)) for df, d in ((listing, "now"), (previous, "old")))
    changed = now.join(old, key, "left").filter(~F.col("now").eqNullSafe(F.col("old"))).select(key)
    return listing.join(changed, key, "left_semi").join(previous.select(key, name, "hash"), [key, name, "hash"], "left_anti")


def carry_fields(previous: DataFrame, fresh: DataFrame, removed: DataFrame, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """Long rows (field, key, value) of a partial result: what is stored then, and what is dropped. Rows of `previous`
    that are missing from `fresh` and not in removed(field, key) are carried if their field is in `carry`; others are
    dropped, but for keys that another field of `fresh` has now (they moved)."""
    missing = previous.join(fresh.select("field", "key"), ["field", "key"], "left_anti").join(removed.select("field", "key"), ["field", "key"], "left_anti")
    kept = F.col("field").isin(carry)
    moved = fresh.select("key").distinct()
    return fresh.unionByName(missing.filter(kept)), missing.filter(~kept).join(moved, "key", "left_anti").select(*previous.columns)


def carry_components(previous: DataFrame, fresh: DataFrame) -> DataFrame:
    """(ref, component, value, read_at): each component of a snapshot from its last read, which may be an older one's; a
    component that was read without a value (NULL) counts as unread."""
    return upsert(previous, fresh.filter("value IS NOT NULL"), ["ref", "component"])


def verified(files: DataFrame) -> DataFrame:
    """files(content, listed) with verified: whether SHA-1 of the word blob, a space, the length, a NUL and the content is
    the listed hash; content that does not match is a failed read and becomes NULL."""
    header = F.concat(F.lit("blob "), F.octet_length("content").cast("string")).cast("binary")
    same = F.sha1(F.concat(header, F.lit(b"\x00"), F.col("content"))) == F.lower("listed")
    return files.withColumn("verified", F.coalesce(same, F.lit(False))).withColumn("content", F.when(same, F.col("content")))


def grow_counts(previous: DataFrame, batch: DataFrame, truncated: bool) -> DataFrame:
    """(key, n): counts after an incremental read. A truncated read never lowers a count, and asks for a full one
    (read_again)."""
    both = previous.select("key", F.col("n").alias("_old")).join(batch.select("key", F.col("n").alias("_new")), "key", "full_outer")
    n = F.greatest("_old", "_new") if truncated else F.coalesce("_new", "_old")
    return both.select("key", n.alias("n"), F.lit(truncated).alias("read_again"))


def archive_versions(previous: DataFrame, fresh: DataFrame, removed: DataFrame) -> DataFrame:
    """(id, hash, state) of versions of documents that go to the archive, once each: superseded by another hash, removed
    (confirmed in removed(id)), or no longer mentioned (fresh has the id with matches = false)."""
    both = previous.select("id", "hash").join(fresh.select("id", F.col("hash").alias("_hash"), "matches"), "id", "left").join(removed.select("id").distinct().withColumn("_removed", F.lit(True)), "id", "left")
    state = F.when(F.col("_removed"), "removed").when(~F.col("matches"), "no-longer-mentions").when(~F.col("_hash").eqNullSafe(F.col("hash")) & F.col("_hash").isNotNull(), "superseded")
    return both.select("id", "hash", state.alias("state")).filter("state IS NOT NULL").distinct()


def restore_fields(fresh: DataFrame, previous: DataFrame, keys: list[str], errors: str, fields: list[str]) -> DataFrame:
    """Fields named in the row's array of errors take their last good value."""
    old = previous.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    joined = fresh.join(old, keys, "left")
    return joined.select(*[F.when(F.array_contains(errors, c), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in fresh.columns])
