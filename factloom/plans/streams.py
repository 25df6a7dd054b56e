"""Queries that run in triggers over the events: ledgers, incremental reads, queues and values that expire, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import relations
from factloom.sources.tables import new_folder, table
from factloom.streaming import incremental, ledger

#: Ends of the triggers' periods; the last has none.
CUTS = ("2024-01-11", "2024-01-21")


def _landed(events: DataFrame) -> list[DataFrame]:
    """The events of each period, as they land one after the other."""
    low, high = (F.lit(c).cast("timestamp_ntz") for c in CUTS)
    at = F.col("ts").cast("timestamp_ntz")
    return [events.filter(at < low), events.filter((at >= low) & (at < high)), events.filter(at >= high)]


def ledger_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of users by kind of event, merged in three triggers; a day is a snapshot of a kind, low values are present
    but not tracked, errors are unread in the second trigger, and the last batch comes twice."""
    first, second, third = _landed(table(spark, sf_dir, "events").select("event_type", "user_id", "ts", "value"))
    kept = ledger.ledger_in_triggers(spark, [first, second.filter("event_type <> 'error'"), third], new_folder(spark, "ledger"), "event_type", "user_id", F.col("value") >= 20)
    return kept.current().withColumnRenamed("part", "event_type")


def incremental_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events, read three times from a stored mark: 20 newest rows at most, then all, then 20 at most."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("source"), F.col("event_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"))
    kept = incremental.IncrementalSet(spark, new_folder(spark, "reads"))
    for number, (cut, rows) in enumerate(((CUTS[0], 20), (CUTS[1], 1_000_000_000), ("2100-01-01", 20)), 1):
        kept.merge(kept.due(events.filter(F.col("at") < F.lit(cut).cast("timestamp")), rows), number)
    return kept.marks().withColumn("high_water", F.col("high_water").cast("timestamp_ntz"))


def revalidation_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four weekly triggers over the users who were active, their purchases watched: 40 reads a trigger, 10 of them of what is
    merely due after six days."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    queue = incremental.RevalidationQueue(spark, new_folder(spark, "queue"), events.schema["user_id"].dataType.simpleString(), {"purchases": "long"}, 144)
    for week in range(4):
        low, now = (F.lit(f"2024-01-{1 + 7 * w:02d}").cast("timestamp") for w in (week, week + 1))
        shown = events.filter((F.col("at") >= low) & (F.col("at") < now)).groupBy(F.col("user_id").alias("id")).agg(F.count_if(F.col("event_type") == "purchase").alias("purchases"))
        queue.trigger(shown, now, week + 1, 40, 10)
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("retrieved_at", "waiting_since")]
    return queue.topics().select(F.col("id").alias("user_id"), "purchases", *times, "deferred")


def expiring_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each user's purchases at each event, as a stream in three triggers: a purchase is a value, errors are
    unreadable, signups say that there is none; a value stands in for three days, and timers tell when it is over."""
    state = F.when(F.col("event_type") == "purchase", incremental.READ).when(F.col("event_type") == "error", incremental.UNREADABLE).otherwise(incremental.NOT_PUBLISHED)
    events = table(spark, sf_dir, "events").filter("event_type IN ('purchase', 'error', 'signup')")
    buckets = max(64, math.ceil(events.count() / (len(CUTS) + 1) / 10_000))
    base = new_folder(spark, "expiry")
    for n, df in enumerate(_landed(events)):
        rows = df.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").cast("long").alias("position"), state.alias("state"), F.col("value").cast("double").alias("value"))
        rows.write.mode("overwrite").parquet(f"{base}/feed/trigger={n}")
        stream = incremental.expiring_stream(spark.readStream.schema(rows.schema).parquet(f"{base}/feed/trigger=*"), 3, buckets=buckets)
        ledger.run_trigger(stream, lambda batch, number: batch.write.mode("overwrite").parquet(f"{base}/answers/batch={number}"), f"{base}/state")
    found = spark.read.schema(incremental.ANSWERS).parquet(f"{base}/answers").drop("batch")
    return found.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in ("at", "read_at", "missing_since") else c for c in found.columns])


def carried_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answers in one batch, from windows that run on hot keys too; without the times at which values end."""
    state = F.when(F.col("event_type") == "purchase", incremental.READ).when(F.col("event_type") == "error", incremental.UNREADABLE).otherwise(incremental.NOT_PUBLISHED)
    events = table(spark, sf_dir, "events").filter("event_type IN ('purchase', 'error', 'signup')")
    reads = events.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").cast("long").alias("position"), state.alias("state"), F.col("value").cast("double").alias("value"))
    start = spark.createDataFrame([], "key string, value double, read_at timestamp, missing_since timestamp")
    found = incremental.carried_values(reads, start, 3)
    return found.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in ("at", "read_at", "missing_since") else c for c in found.columns])


def mark_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of value's marks (errors) and unmarks (signups) in turn, with the state after each; ten keys hold all rows."""
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind = F.when(F.col("event_type") == "error", "marked_duplicate").when(F.col("event_type") == "signup", "unmarked_duplicate")
    timeline = events.select((F.col("user_id") % 10).alias("id"), kind.alias("type"), (F.col("k") % 3).alias("ref"), F.col("ts").alias("at"), F.col("event_id").alias("position"))
    return relations.running_marks(timeline).select("id", F.col("position").alias("event_id"), "marked", "canonical")


QUERIES = {f.__name__: f for f in (ledger_batches, incremental_reads, revalidation_queue, expiring_values, carried_answers, mark_states)}


def _queue_sql() -> str:
    """The four triggers, one after the other."""
    steps = ["t0 AS (SELECT user_id AS id, 0::BIGINT AS purchases, ts AS retrieved_at, ts AS waiting_since, 0 AS deferred FROM events WHERE false)"]
    for n in range(1, 5):
        low, now = f"TIMESTAMP '2024-01-{7 * n - 6:02d}'", f"TIMESTAMP '2024-01-{7 * n + 1:02d}'"
        steps.append(f"""l{n} AS (SELECT user_id AS id, count(*) FILTER (event_type = 'purchase') AS purchases FROM events WHERE ts >= {low} AND ts < {now} GROUP BY 1),
            k{n} AS (SELECT coalesce(t.id, l.id) AS id, t.purchases AS old, l.purchases AS fresh, l.id IS NOT NULL AS listed, retrieved_at, waiting_since, deferred,
                CASE WHEN retrieved_at IS NULL THEN (CASE WHEN l.id IS NULL THEN 'dropped' ELSE 'new' END) WHEN l.id IS NOT NULL AND t.purchases IS DISTINCT FROM l.purchases THEN 'changed'
                     WHEN retrieved_at < {now} - INTERVAL 144 HOUR THEN 'due' ELSE 'kept' END AS kind FROM t{n - 1} AS t FULL JOIN l{n} AS l ON l.id = t.id),
            w{n} AS (SELECT *, CASE WHEN kind IN ('new', 'changed') THEN coalesce(waiting_since, {now}) END AS waits FROM k{n}),
            f{n} AS (SELECT id FROM w{n} WHERE waits IS NOT NULL ORDER BY waits, id LIMIT 40),
            d{n} AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY retrieved_at, id) AS nth FROM w{n} WHERE kind = 'due') WHERE nth <= least(10, 40 - (SELECT count(*) FROM f{n}))),
            x{n} AS (SELECT *, id IN (SELECT id FROM f{n} UNION ALL SELECT id FROM d{n}) AS taken FROM w{n}),
            t{n} AS (SELECT id, CASE WHEN taken AND listed THEN fresh ELSE old END AS purchases, CASE WHEN taken THEN {now} ELSE retrieved_at END AS retrieved_at,
                CASE WHEN NOT taken THEN waits END AS waiting_since, CASE WHEN NOT taken AND kind IN ('new', 'changed', 'due') THEN coalesce(deferred, 0) + 1 ELSE 0 END AS deferred FROM x{n})""")
    return f"WITH {', '.join(steps)} SELECT id AS user_id, purchases, retrieved_at, waiting_since, deferred::INTEGER AS deferred FROM t4 WHERE retrieved_at IS NOT NULL OR waiting_since IS NOT NULL"


_ANSWERS = """r AS (SELECT user_id::VARCHAR AS key, ts AS "at", event_id::BIGINT AS position, CASE event_type WHEN 'purchase' THEN 'read' WHEN 'error' THEN 'unreadable' ELSE 'not-published' END AS state, value::DOUBLE AS value
            FROM events WHERE event_type IN ('purchase', 'error', 'signup')),
        e AS (SELECT *, sum((state = 'read')::INT) OVER w AS epoch, last_value(CASE WHEN state = 'read' THEN "at" END IGNORE NULLS) OVER w AS read, last_value(CASE WHEN state = 'read' THEN value END IGNORE NULLS) OVER w AS v
            FROM r WINDOW w AS (PARTITION BY key ORDER BY "at", position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        f AS (SELECT *, min("at") FILTER (state <> 'read') OVER (PARTITION BY key, epoch) AS failed, coalesce(state <> 'read' AND "at" <= read + INTERVAL 3 DAY, false) AS stands FROM e),
        a AS (SELECT key, "at", position, CASE WHEN stands THEN 'carried' ELSE state END AS answer, CASE WHEN stands OR state = 'read' THEN v END AS value,
            CASE WHEN stands OR state = 'read' THEN read END AS read_at, CASE WHEN stands THEN failed END AS missing_since FROM f)"""

SQL = {
    "ledger_batches": f"""
        WITH f AS (SELECT event_type, user_id, CAST(ts AS DATE) AS day, value >= 20 AS tracked FROM events WHERE event_type <> 'error' OR ts < '{CUTS[0]}' OR ts >= '{CUTS[1]}'),
             n AS (SELECT event_type, day, lead(day) OVER (PARTITION BY event_type ORDER BY day) AS nxt FROM (SELECT DISTINCT event_type, day FROM f)),
             g AS (SELECT event_type, user_id, min(day) FILTER (tracked) AS first_seen, max(day) AS last_seen, count(DISTINCT day) AS times_seen FROM f GROUP BY ALL)
        SELECT g.*, n.nxt AS gone_since FROM g JOIN n ON n.event_type = g.event_type AND n.day = g.last_seen WHERE first_seen IS NOT NULL""",
    "incremental_reads": f"""
        WITH e AS (SELECT user_id::VARCHAR AS source, event_id AS key, ts AS "at" FROM events),
             r1 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY "at" DESC, key::VARCHAR) AS nth, count(*) OVER (PARTITION BY source) AS m FROM e WHERE "at" < '{CUTS[0]}'),
             k1 AS (SELECT source, key, "at" FROM r1 WHERE nth <= 20),
             m1 AS (SELECT source, max("at") AS high, count(*) FILTER (nth <= 20) AS size, max(m) > 20 AS full_next FROM r1 GROUP BY 1),
             r2 AS (SELECT e.* FROM e LEFT JOIN m1 USING (source) WHERE "at" < '{CUTS[1]}' AND (high IS NULL OR full_next OR "at" >= high - INTERVAL 3 DAY)),
             k2 AS (SELECT * FROM k1 UNION SELECT * FROM r2),
             m2 AS (SELECT k2.source, max(k2."at") AS high, count(*) AS size FROM k2 GROUP BY 1),
             r3 AS (SELECT e.*, row_number() OVER (PARTITION BY source ORDER BY "at" DESC, key::VARCHAR) AS nth, count(*) OVER (PARTITION BY source) AS m FROM e LEFT JOIN m2 USING (source) WHERE high IS NULL OR "at" >= high - INTERVAL 3 DAY),
             k3 AS (SELECT * FROM k2 UNION SELECT source, key, "at" FROM r3 WHERE nth <= 20),
             t3 AS (SELECT source, max(m) > 20 AS truncated FROM r3 GROUP BY 1)
        SELECT k3.source, max("at") AS high_water, count(*) AS n, count(*) AS size, coalesce(any_value(truncated), false) AS full_next FROM k3 LEFT JOIN t3 USING (source) GROUP BY 1""",
    "revalidation_queue": _queue_sql(),
    "expiring_values": f"""
        WITH {_ANSWERS},
             o AS (SELECT key, "at", lead("at") OVER (PARTITION BY key ORDER BY "at", position) AS nxt FROM r WHERE state = 'read')
        SELECT * FROM a UNION ALL
        SELECT key, "at" + INTERVAL 3 DAY, -1, 'expired', NULL, NULL, NULL FROM o WHERE (nxt IS NULL OR nxt > "at" + INTERVAL 3 DAY) AND "at" + INTERVAL 3 DAY < (SELECT max("at") FROM r)""",
    "carried_answers": f"WITH {_ANSWERS} SELECT * FROM a",
    "mark_states": """
        WITH t AS (SELECT user_id % 10 AS id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 AS ref, ts, event_id FROM events WHERE event_type IN ('error', 'signup')),
             s AS (SELECT *, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER w AS of, last_value(CASE WHEN event_type = 'error' THEN ref END IGNORE NULLS) OVER w AS set_ref
                   FROM t WINDOW w AS (PARTITION BY id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
             u AS (SELECT *, of IS NOT NULL AND NOT coalesce(bool_or(event_type = 'signup' AND ref = set_ref) OVER (PARTITION BY id, of ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS marked FROM s)
        SELECT id, event_id, marked, CASE WHEN marked THEN set_ref END AS canonical FROM u""",
}
