"""Queries on the driver's tables for the merge operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import merge, queues
from factloom.sources.tables import table


def evidence_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").alias("day"))
    return merge.ledger_of_snapshots(days, days.select("day"), ["user_id", "event_type"], "day")


def _day(text: str):
    return F.lit(text).cast("timestamp_ntz")


def upsert_prev_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    early = F.col("o_orderdate") < _day("1997-01-01 00:00:00")
    fresh = orders.filter(~early | (F.col("o_orderkey") % 2 == 0)).withColumn("o_orderstatus", F.when(early, F.lit("X")).otherwise(F.col("o_orderstatus")))
    return merge.upsert(orders.filter(early), fresh, ["o_orderkey"])


def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    out = merge.carry_forward(customers.filter("c_nationkey < 20"), customers.filter("c_custkey % 3 <> 0"), customers.filter("c_mktsegment = 'BUILDING'"), ["c_custkey"])
    return out.select("c_custkey", "fate")


def unchanged_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.max("l_returnflag").alias("l_returnflag")).withColumn("read_at", F.lit(1))
    fresh = lines.withColumn("l_returnflag", F.when(F.col("l_partkey") % 7 == 0, "X").otherwise(F.col("l_returnflag"))).withColumn("read_at", F.lit(2))
    return merge.keep_unchanged(lines.filter("l_partkey % 11 <> 0"), fresh, ["l_orderkey", "l_linenumber"], ["read_at"])


def version_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.versions_of(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus")


def carry_with_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("value"))
    return merge.carry_with_expiry(days, "user_id", "day", "value", 7)


def restore_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    errors = F.filter(F.array(F.when(F.col("p_partkey") % 5 == 0, F.lit("p_name")), F.when(F.col("p_partkey") % 3 == 0, F.lit("p_brand"))), lambda x: x.isNotNull())
    fresh = parts.withColumn("errors", errors).withColumn("p_name", F.when(F.col("p_partkey") % 5 == 0, None).otherwise(F.col("p_name"))).withColumn("p_brand", F.when(F.col("p_partkey") % 3 == 0, None).otherwise(F.col("p_brand")))
    previous = parts.filter("p_partkey % 2 = 0").withColumn("p_name", F.concat(F.lit("old "), "p_name"))
    return merge.restore_fields(fresh, previous, ["p_partkey"], "errors", ["p_name", "p_brand"]).select("p_partkey", "p_name", "p_brand")


def listing_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.listing_digest(table(spark, sf_dir, "part"), "p_brand", "p_name")


def reconcile_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    both = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    state = F.when(F.count_distinct("quality") > 1, "disagree").when(F.max("quality") == 1, "published").when(F.max("quality") == 0, "draft").otherwise("unknown")
    return both.groupBy("text_md5").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"), state.alias("state"))


def prune_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_orderdate")
    return merge.newest(orders, ["o_orderpriority"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 12)


def refresh_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    def week(first: str, last: str, name: str) -> DataFrame:
        rows = table(spark, sf_dir, "events").filter((F.col("ts") >= _day(first)) & (F.col("ts") < _day(last)))
        return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias(f"n_{name}"), F.max("ts").alias(f"last_{name}"))

    both = week("2024-01-01 00:00:00", "2024-01-08 00:00:00", "old").join(week("2024-01-08 00:00:00", "2024-01-15 00:00:00", "new"), "user_id", "full_outer")
    kind = F.when(F.col("n_old").isNull(), "new").when(F.col("n_new").isNull(), "dropped").when(F.col("n_old") != F.col("n_new"), "changed").when(F.col("last_old") < _day("2024-01-06 00:00:00"), "due").otherwise("cached")
    return both.select("user_id", kind.alias("kind"), F.coalesce("n_new", "n_old").alias("n"))


def refresh_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two weeks of activity as listings: what is new, changed, due, cached or dropped, and what a budget of 20 new or
    changed users and 10 due ones takes; the rest is deferred."""
    def week(first: str, last: str) -> DataFrame:
        rows = table(spark, sf_dir, "events").filter((F.col("ts") >= _day(first)) & (F.col("ts") < _day(last)))
        return rows.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.max("ts").alias("retrieved_at"))

    old, new = week("2024-01-01 00:00:00", "2024-01-08 00:00:00"), week("2024-01-08 00:00:00", "2024-01-15 00:00:00").drop("retrieved_at")
    queue = queues.classify_refresh(old, new, ["user_id"], ["purchases"], _day("2024-01-08 00:00:00"), 48)
    return queues.take_budget(queue, ["user_id"], 20, 10)


QUERIES = {f.__name__: f for f in (evidence_ledger, upsert_prev_fresh, carry_forward, unchanged_suppression, version_archive, carry_with_expiry, restore_fields, listing_digest, reconcile_copies, prune_newest, refresh_queue, refresh_budget)}

SQL = {
    "evidence_ledger": """
        WITH d AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day FROM events),
             s AS (SELECT day, lead(day) OVER (ORDER BY day) AS nxt FROM (SELECT DISTINCT day FROM d)),
             f AS (SELECT user_id, event_type, min(day) AS first_seen, max(day) AS last_seen, count(DISTINCT day) AS times_seen FROM d GROUP BY ALL)
        SELECT f.*, s.nxt AS gone_since FROM f JOIN s ON f.last_seen = s.day""",
    "upsert_prev_fresh": """
        SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' AND o_orderkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderdate FROM orders""",
    "carry_forward": """
        SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN 'in_next' WHEN c_mktsegment = 'BUILDING' THEN 'removed' ELSE 'carried' END AS fate FROM customer WHERE c_nationkey < 20""",
    "unchanged_suppression": """
        SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 7 = 0 THEN 'X' ELSE l_returnflag END AS l_returnflag,
               CASE WHEN l_partkey % 7 = 0 OR l_partkey % 11 = 0 THEN 2 ELSE 1 END AS read_at, l_partkey % 7 = 0 OR l_partkey % 11 = 0 AS changed
        FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2)""",
    "version_archive": """
        WITH s AS (SELECT *, lag(o_orderstatus) OVER w AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
        SELECT o_custkey, o_orderstatus, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to
        FROM s WHERE b IS NULL OR b <> o_orderstatus""",
    "carry_with_expiry": """
        WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) FILTER (event_type = 'purchase') AS value FROM events GROUP BY ALL),
             k AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN day END IGNORE NULLS) OVER w AS rd, last_value(value IGNORE NULLS) OVER w AS v FROM d
                   WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT user_id, day, value, CASE WHEN day - rd <= 7 THEN v END AS carried FROM k""",
    "restore_fields": """
        SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_name WHEN p_partkey % 2 = 0 THEN 'old ' || p_name END AS p_name,
               CASE WHEN p_partkey % 3 <> 0 OR p_partkey % 2 = 0 THEN p_brand END AS p_brand FROM part""",
    "listing_digest": """
        SELECT p_brand, md5(CAST(sum(CAST('0x' || left(md5(p_name), 12) AS BIGINT)) AS VARCHAR) || '|' || CAST(sum(CAST('0x' || substring(md5(p_name), 13, 12) AS BIGINT)) AS VARCHAR) || '|' || count(*)) AS digest, count(*) AS n
        FROM part GROUP BY p_brand""",
    "reconcile_copies": """
        SELECT md5(text) AS text_md5, count(*) AS copies, min(d.doc_id) AS first_id,
               CASE WHEN count(DISTINCT quality) > 1 THEN 'disagree' WHEN max(quality) = 1 THEN 'published' WHEN max(quality) = 0 THEN 'draft' ELSE 'unknown' END AS state
        FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""",
    "prune_newest": """
        SELECT * FROM (SELECT o_orderpriority, o_orderkey, o_orderdate, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS INTEGER) AS rank FROM orders) WHERE rank <= 12""",
    "refresh_budget": """
        WITH o AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS p, max(ts) AS l FROM events WHERE ts >= '2024-01-01' AND ts < '2024-01-08' GROUP BY 1),
             w AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS p FROM events WHERE ts >= '2024-01-08' AND ts < '2024-01-15' GROUP BY 1),
             q AS (SELECT user_id, CASE WHEN o.p IS NULL THEN 'new' WHEN w.p IS NULL THEN 'dropped' WHEN o.p <> w.p THEN 'changed' WHEN l < TIMESTAMP '2024-01-06' THEN 'due' ELSE 'cached' END AS kind, l AS retrieved_at FROM o FULL JOIN w USING (user_id)),
             a AS (SELECT user_id FROM q WHERE kind IN ('new', 'changed') ORDER BY kind DESC, user_id LIMIT 20),
             b AS (SELECT user_id FROM q WHERE kind = 'due' ORDER BY retrieved_at, user_id LIMIT 10)
        SELECT *, user_id IN (SELECT user_id FROM a UNION ALL SELECT user_id FROM b) AS taken FROM q""",
    "refresh_queue": """
        WITH o AS (SELECT user_id, count(*) AS n, max(ts) AS l FROM events WHERE ts >= '2024-01-01' AND ts < '2024-01-08' GROUP BY 1),
             w AS (SELECT user_id, count(*) AS n FROM events WHERE ts >= '2024-01-08' AND ts < '2024-01-15' GROUP BY 1)
        SELECT user_id, CASE WHEN o.n IS NULL THEN 'new' WHEN w.n IS NULL THEN 'dropped' WHEN o.n <> w.n THEN 'changed' WHEN o.l < '2024-01-06' THEN 'due' ELSE 'cached' END AS kind, coalesce(w.n, o.n) AS n
        FROM o FULL JOIN w USING (user_id)""",
}
