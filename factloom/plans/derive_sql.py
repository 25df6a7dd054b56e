"""The queries of `derive` as SQL."""

from __future__ import annotations

LINES = """(SELECT l_orderkey, l_linenumber, max(l_returnflag) AS flag, max(l_linestatus) AS line_status, max(l_shipdate) AS shipdate, max(l_suppkey) AS suppkey, max(l_partkey) AS partkey,
    ['AIR', 'MAIL', 'REG AIR', 'SHIP', 'RAIL', 'FOB', 'TRUCK'][CAST(max(l_partkey) % 7 AS INTEGER) + 1] AS shipmode FROM lineitem GROUP BY 1, 2)"""
STATES = "['available', 'in-build', 'opt-in', 'off', 'hidden', 'service-off', 'absent', 'not-verified', 'not-planned']"
RANK = "(9 - list_position(" + STATES + ", {}))"
CELLS = f"""(SELECT entity, place, {STATES}[CAST(n % 9 AS INTEGER) + 1] AS state, CASE WHEN n % 9 = 0 THEN CAST(n % 20 AS INTEGER) END AS since, n % 4 = 0 AS contrary, n % 6 = 0 AS pending
    FROM (SELECT p_brand AS place, CAST(least(p_size // 10, 4) AS INTEGER) AS entity, CAST(sum(p_partkey) AS BIGINT) AS n FROM part GROUP BY ALL))"""


def _lifted() -> str:
    steps = [f"WITH l5 AS (SELECT *, CAST(NULL AS INTEGER) AS implied_by FROM {CELLS})"]
    for k in range(4, 0, -1):
        takes = "c.entity = e.entity - 1 AND c.state IN ('in-build', 'not-verified') AND NOT c.contrary AND NOT c.pending"
        steps.append(f"""l{k} AS (SELECT c.entity, c.place, CASE WHEN e.entity IS NOT NULL THEN 'available' ELSE c.state END AS state, CASE WHEN e.entity IS NOT NULL THEN e.since ELSE c.since END AS since, c.contrary, c.pending,
            coalesce(e.entity, c.implied_by) AS implied_by FROM l{k + 1} c LEFT JOIN (SELECT * FROM l{k + 1} WHERE entity = {k} AND state = 'available' AND since IS NOT NULL) e ON e.place = c.place AND {takes})""")
    return ", ".join(steps) + " SELECT entity, place, state, since, implied_by FROM l1"


def _capped() -> str:
    steps = [f"WITH c0 AS (SELECT entity, place, state, since, CAST(NULL AS INTEGER) AS limited_by FROM {CELLS})"]
    for k in range(1, 5):
        lower = f"u.state <> 'not-planned' AND NOT (c.state = 'absent' AND u.state = 'not-verified') AND {RANK.format('u.state')} < {RANK.format('c.state')}"
        steps.append(f"""c{k} AS (SELECT c.entity, c.place, CASE WHEN {lower} THEN u.state ELSE c.state END AS state,
            CASE WHEN c.state = 'available' AND u.state = 'available' AND u.since > c.since THEN u.since ELSE c.since END AS since, CASE WHEN {lower} THEN u.entity ELSE c.limited_by END AS limited_by
            FROM c{k - 1} c LEFT JOIN c{k - 1} u ON c.entity = {k} AND u.entity = {k - 1} AND u.place = c.place)""")
    return ", ".join(steps) + " SELECT * FROM c4"


LINKED = """(SELECT snapshot, lower(name) AS name, version, CASE WHEN bool_or(reachable) THEN true WHEN count(*) > count(reachable) THEN NULL ELSE false END AS linked FROM
    (SELECT p_partkey % 4 AS snapshot, p_brand AS name, p_size, p_size || '.0.' || p_partkey % 3 AS version, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 5 <> 1 END AS reachable FROM part) GROUP BY 1, 2, 3)"""
FACTS = """(WITH o AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) AS n, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders WHERE o_orderdate < TIMESTAMP '{}' GROUP BY 1)
    SELECT 'build' AS section, CAST(o_custkey AS VARCHAR) AS entity, 'built' AS cell, CASE WHEN n % 5 <> 0 THEN CASE WHEN done * 2 > n THEN 'true' ELSE 'false' END END AS value FROM o
    UNION ALL SELECT 'flag', CAST(o_custkey AS VARCHAR), 'flag', CASE WHEN status <> 'P' THEN status END FROM o UNION ALL SELECT 'doc', CAST(o_custkey AS VARCHAR), 'hash', CAST(n % 3 AS VARCHAR) FROM o
    UNION ALL SELECT 'study', CAST(o_custkey AS VARCHAR), 'study', 'new' FROM o WHERE n > 8)"""
BEFORE, NOW = FACTS.format("1997-01-01"), FACTS.format("1998-01-01")
CHANGES = f"""(SELECT section, entity, cell, a.value AS was, b.value AS value, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.value IS DISTINCT FROM b.value THEN 'changed' END AS what
    FROM (SELECT *, 1 AS k FROM {BEFORE}) a FULL JOIN (SELECT *, 1 AS k FROM {NOW}) b USING (section, entity, cell))"""
DETECTED = """e AS (SELECT left(sha256(event_type || '|' || event_id), 16) AS id, event_type AS kind, ts AS source_at, event_id AS n FROM events WHERE event_type IN ('error', 'signup')),
    k AS (SELECT id, kind, source_at, TIMESTAMP '2024-01-10' AS detected_at, 'backfill' AS basis, 'old' AS title, n % 4 = 0 AS diff_only, n % 2 = 0 AS inputs_read, n % 6 = 0 AS rules_outdated FROM e WHERE source_at < '2024-01-10' AND n % 5 <> 0),
    f AS (SELECT id, kind, source_at, 'new' AS title, n % 8 = 1 AS refresh_only, n % 4 = 0 AS diff_only FROM e WHERE source_at < '2024-01-20' AND n % 3 <> 0)"""

SQL = {
    "item_groups": f"""
        WITH RECURSIVE l AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey * 10 AS issue, l_linenumber AS ln, flag FROM {LINES}),
             o AS (SELECT o_orderkey * 10 AS id, o_custkey, o_orderstatus = 'P' AND lag(o_orderkey) OVER w IS NOT NULL AS folded FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
             r AS (SELECT id, max(CASE WHEN NOT folded THEN id END) OVER (PARTITION BY o_custkey ORDER BY id ROWS UNBOUNDED PRECEDING) AS group_id FROM o),
             d AS (SELECT p.id AS above, c.id AS below FROM l p JOIN l c ON c.id = p.id + 1 AND c.ln >= 5 AND c.issue = p.issue UNION SELECT d.above, c.id FROM d JOIN l c ON c.id = d.below + 1 AND c.ln >= 5 AND c.id // 10 = d.below // 10),
             own AS (SELECT group_id, id AS item_id, CASE WHEN id = group_id THEN 'lead' ELSE 'duplicate' END AS role FROM r),
             linked AS (SELECT DISTINCT group_id, l.id AS item_id FROM l JOIN r ON r.id = l.issue WHERE ln < 5 AND flag <> 'N'),
             lifted AS (SELECT DISTINCT group_id, below AS item_id FROM linked JOIN d ON above = item_id),
             m AS (SELECT * FROM own UNION ALL SELECT *, 'pr' FROM linked UNION ALL SELECT *, 'uplift' FROM lifted),
             free AS (SELECT id, ln, flag FROM l WHERE id NOT IN (SELECT item_id FROM m)),
             leads AS (SELECT id FROM free WHERE id NOT IN (SELECT below FROM d)),
             under AS (SELECT leads.id AS group_id, below AS item_id FROM leads JOIN d ON above = leads.id)
        SELECT * FROM m UNION ALL SELECT id, id, 'lead' FROM leads UNION ALL SELECT group_id, item_id, 'uplift' FROM under
        UNION ALL SELECT DISTINCT group_id, l.id, 'mention' FROM l JOIN r ON r.id = l.issue WHERE ln < 5 AND flag = 'N'
        UNION ALL SELECT id, id, 'lead' FROM free WHERE id NOT IN (SELECT id FROM leads) AND id NOT IN (SELECT item_id FROM under)""",
    "marked_duplicates": """
        WITH m AS (SELECT user_id AS duplicate, CAST(props ->> '$.k' AS BIGINT) + 1000000000 AS canonical, arg_max(event_type, (ts, event_id)) AS last, max((ts, event_id)) AS w FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1, 2)
        SELECT duplicate, canonical, w[1] AS "at", w[2] AS position FROM m WHERE last = 'error'""",
    "cell_decisions": """
        WITH f AS (SELECT p_partkey, p_partkey AS k, p_size AS s, CASE p_partkey % 4 WHEN 0 THEN 'nightly' WHEN 1 THEN 'beta' ELSE 'release' END AS channel,
                          CASE p_partkey % 5 WHEN 1 THEN 'on' WHEN 2 THEN 'off' WHEN 3 THEN 'missing' WHEN 4 THEN 'unknown' ELSE 'none' END AS flag, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS built,
                          p_partkey % 3 <> 0 AS note, p_partkey % 3 <> 0 AND p_partkey % 2 = 0 AS here, p_partkey % 17 <> 0 AS tagged FROM part),
             g AS (SELECT *, here AND tagged AND coalesce(built, true) AS holds FROM f)
        SELECT p_partkey, CASE WHEN k % 50 = 0 THEN 'service-off' WHEN k % 11 = 0 THEN 'hidden' WHEN k % 13 = 0 AND NOT note THEN 'not-planned' WHEN k % 7 = 0 THEN 'absent'
             WHEN channel = 'release' AND note AND flag NOT IN ('off', 'missing') THEN 'available' WHEN flag = 'off' AND s % 2 = 0 THEN 'opt-in' WHEN flag = 'off' THEN 'off' WHEN flag = 'missing' THEN 'absent'
             WHEN flag = 'on' AND (holds OR coalesce(built, false) OR s <= 10) THEN CASE WHEN channel = 'release' AND note THEN 'available' ELSE 'in-build' END
             WHEN flag = 'none' AND channel <> 'release' AND tagged AND CASE WHEN note THEN holds ELSE built END THEN 'in-build'
             WHEN flag = 'none' AND channel = 'release' AND built AND NOT note THEN 'in-build' ELSE 'not-verified' END AS state FROM g""",
    "work_stages": f"""
        WITH f AS (SELECT l_orderkey, bool_or(l_linenumber = 7 AND flag = 'R') AS duplicate, bool_or(l_linenumber = 6 AND flag = 'A') AS contradictory, bool_or(shipmode = 'REG AIR') AS note,
                          bool_or(CASE WHEN line_status = 'F' THEN shipmode = 'AIR' END) AS rel, bool_or(shipmode = 'MAIL') AS beta, bool_or(shipmode = 'SHIP') AS nightly, bool_or(flag = 'A') AS merged, bool_and(shipmode = 'RAIL') AS service,
                          bool_or(shipmode = 'FOB') AS open_pr, bool_and(line_status = 'F') AS closed, max(l_linenumber) = 1 AS led FROM {LINES} GROUP BY 1)
        SELECT l_orderkey, CASE WHEN duplicate AND NOT contradictory THEN 'duplicate' WHEN note THEN 'released' WHEN rel THEN 'in-release-build' WHEN beta THEN 'in-beta' WHEN nightly THEN 'in-nightly' WHEN merged AND service THEN 'service-change'
             WHEN merged THEN 'merged' WHEN open_pr THEN 'in-progress' WHEN closed AND NOT led THEN 'closed-unverified' WHEN closed AND led THEN 'closed-unmerged' ELSE 'open' END AS stage FROM f""",
    "lifted_cells": _lifted(),
    "capped_cells": _capped(),
    "conditional_caps": f"""
        WITH c AS (SELECT p_partkey AS entity, p_size AS place, p_partkey % 8 AS version, {STATES}[CAST(p_partkey % 9 AS INTEGER) + 1] AS state FROM part),
             p AS (SELECT DISTINCT entity % 5 AS probe, version, (entity % 5 + version) % 3 = 1 AS present FROM c WHERE (entity % 5 + version) % 3 <> 0),
             f AS (SELECT probe, min(version) AS first FROM p WHERE present GROUP BY 1),
             m AS (SELECT c.*, u.entity AS needed, u.state AS above, CASE WHEN NOT p.present AND f.first <= c.version THEN NULL ELSE p.present END AS present FROM c JOIN (SELECT p_size, min(p_partkey) AS low FROM part GROUP BY 1) n ON n.p_size = c.place
                   JOIN c u ON u.entity = n.low LEFT JOIN p ON p.probe = c.entity % 5 AND p.version = c.version LEFT JOIN f ON f.probe = c.entity % 5),
             x AS (SELECT *, entity <> needed AND above <> 'not-planned' AND {RANK.format("above")} < {RANK.format("state")} AND (present IS NULL OR present) AS hit FROM m)
        SELECT entity, place, version, CASE WHEN hit AND present THEN above WHEN hit THEN 'not-verified' ELSE state END AS state, CASE WHEN hit AND present THEN needed END AS limited_by FROM x""",
    "unknown_switches": f"""
        WITH RECURSIVE d AS (SELECT p_partkey AS e FROM part WHERE p_partkey % 97 = 5 AND p_partkey % 2 = 1 UNION SELECT p.p_partkey FROM d JOIN part p ON p.p_partkey // 2 = d.e AND p.p_partkey > 1),
             c AS (SELECT p_partkey AS entity, p_brand AS place, {STATES}[CAST(p_partkey % 9 AS INTEGER) + 1] AS state FROM part),
             h AS (SELECT *, entity IN (SELECT e FROM d) AND state IN ('available', 'in-build', 'opt-in', 'off') AS hit FROM c)
        SELECT entity, place, CASE WHEN hit THEN 'not-verified' ELSE state END AS state, CASE WHEN hit THEN state END AS app_state FROM h""",
    "limited_evidence": f"""
        WITH RECURSIVE c AS (SELECT entity, place, state, CASE WHEN entity > 0 AND state IN ('absent', 'off', 'in-build', 'available') THEN entity - 1 END AS lim FROM {CELLS}),
             w AS (SELECT entity, place, state, entity AS src, lim, 0 AS n FROM c UNION ALL SELECT w.entity, w.place, w.state, c.entity, c.lim, n + 1 FROM w JOIN c ON c.entity = w.lim AND c.place = w.place WHERE n < 5),
             s AS (SELECT entity, place, state, arg_max(src, n) AS source_entity FROM w GROUP BY 1, 2, 3),
             e AS (SELECT CAST(least(p_size // 10, 4) AS INTEGER) AS source_entity, p_brand AS place, split_part(p_type, ' ', -1) AS kind, p_name || ' ' || p_partkey AS text FROM part),
             r AS (SELECT s.*, kind, text, row_number() OVER (PARTITION BY s.entity, place ORDER BY CASE WHEN kind = 'STEEL' THEN 0 ELSE length(kind) + length(state) % 3 END, kind, text) AS k FROM s LEFT JOIN e USING (source_entity, place))
        SELECT entity, place, state, source_entity, kind, text FROM r WHERE k = 1""",
    "channel_leads": """
        WITH c AS (SELECT o_custkey AS entity, o_orderkey % 3 AS platform, CASE o_orderpriority WHEN '1-URGENT' THEN 'nightly' WHEN '2-HIGH' THEN 'beta' ELSE 'release' END AS channel, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 WHEN 'P' THEN 1 ELSE 0 END AS r FROM orders),
             b AS (SELECT entity, platform, coalesce(max(r) FILTER (channel = 'release'), 0) AS rel, max(r) FILTER (channel = 'beta') AS beta, max(r) FILTER (channel = 'nightly') AS nightly FROM c GROUP BY 1, 2)
        SELECT entity, platform, CASE WHEN beta > rel THEN 'beta' ELSE 'nightly' END AS ahead FROM b WHERE beta > rel OR nightly > rel""",
    "fix_presence": f"""
        WITH b AS (SELECT l_orderkey AS group_id, suppkey % 3 AS platform, CASE shipmode WHEN 'AIR' THEN 0 WHEN 'MAIL' THEN 1 ELSE 2 END AS c, CASE flag WHEN 'R' THEN true WHEN 'A' THEN false END AS inc FROM {LINES}),
             v AS (SELECT group_id, CASE WHEN bool_or(inc) THEN true WHEN count(*) > count(inc) THEN NULL ELSE false END AS fixed FROM b GROUP BY 1), p AS (SELECT group_id, platform, min(c) AS c FROM b WHERE inc GROUP BY 1, 2)
        SELECT group_id, fixed, platform, ['release', 'beta', 'nightly'][c + 1] AS channel FROM v LEFT JOIN p USING (group_id)""",
    "build_inclusion": f"""
        WITH l AS (SELECT *, l_orderkey * 10 + l_linenumber AS id FROM {LINES}), b AS (SELECT id, suppkey % 2 AS line, CASE WHEN flag = 'R' THEN partkey % 5 END AS low, CASE WHEN flag = 'A' THEN partkey % 5 END AS high FROM l WHERE flag <> 'N'),
             p AS (SELECT l_orderkey AS group_id, id, CASE WHEN l_linenumber = 3 AND flag = 'R' THEN l_orderkey * 10 + 4 WHEN l_linenumber <> 3 THEN id END AS carrier FROM l),
             v AS (SELECT p.group_id, r_regionkey AS build_id, p.id, CASE WHEN b.id IS NULL THEN NULL WHEN b.line <> r_regionkey % 2 THEN false WHEN low <= r_regionkey THEN true WHEN r_regionkey <= high THEN false END AS inc FROM p LEFT JOIN b ON b.id = p.carrier CROSS JOIN region)
        SELECT group_id, build_id, CASE WHEN bool_or(inc) THEN true WHEN count(*) > count(inc) THEN NULL ELSE false END AS included, arg_min(id, (CASE WHEN inc THEN 0 WHEN inc IS NULL THEN 1 ELSE 2 END, id)) AS via FROM v GROUP BY 1, 2""",
    "advisory_exposure": f"""
        WITH a AS (SELECT p_type || '|' || p_brand AS advisory_id, lower(p_brand) AS name, min(p_size) AS low FROM part GROUP BY p_type, p_brand), x AS (SELECT *, CAST(split_part(version, '.', 1) AS INTEGER) AS size FROM {LINKED}),
             v AS (SELECT advisory_id, low, snapshot, CASE WHEN low % 7 <> 0 AND (size < low OR size > low + 4 OR (size = low + 4)) THEN false WHEN linked = false THEN false WHEN low % 7 = 0 THEN NULL ELSE linked END AS v FROM a JOIN x USING (name)),
             e AS (SELECT advisory_id, snapshot, CASE WHEN bool_or(v) THEN true WHEN count(*) > count(v) THEN NULL ELSE false END AS affected, true AS rd FROM v GROUP BY 1, 2),
             f AS (SELECT a.advisory_id, low % 5 <> 0 AS checkable, CASE WHEN rd THEN affected ELSE false END AS v, coalesce(rd, false) AND affected IS NULL AS maybe FROM a CROSS JOIN range(4) b(snapshot) LEFT JOIN e ON e.advisory_id = a.advisory_id AND e.snapshot = b.snapshot),
             g AS (SELECT advisory_id, checkable, CASE WHEN bool_or(v) THEN true WHEN count(*) > count(v) THEN NULL ELSE false END AS v, bool_or(maybe) AS maybe FROM f GROUP BY 1, 2),
             h AS (SELECT *, CASE WHEN v THEN true WHEN NOT checkable THEN NULL ELSE v END AS affected FROM g)
        SELECT advisory_id, affected, CASE WHEN affected IS NOT NULL THEN [] ELSE list_sort(list_filter([CASE WHEN NOT checkable THEN 'not-checkable' END, CASE WHEN maybe THEN 'possibly-affected' END], lambda z: z IS NOT NULL)) END AS reasons FROM h""",
    "adopted_versions": f"""
        WITH x AS (SELECT *, CAST(split_part(version, '.', 1) AS INTEGER) AS a, CAST(split_part(version, '.', 3) AS INTEGER) AS c FROM {LINKED}),
             y AS (SELECT snapshot, name, arg_max(version, (a, c)) FILTER (linked) AS highest, max(a) FILTER (linked) AS top, CAST(count(*) FILTER (linked) AS INTEGER) AS n_versions, CAST(count(*) FILTER (linked IS NULL) AS INTEGER) AS n_possible, max(a) FILTER (linked IS NULL) AS maybe FROM x GROUP BY 1, 2)
        SELECT snapshot, name, highest, n_versions, n_possible, CASE WHEN top >= 40 THEN true WHEN maybe >= 40 OR highest IS NULL THEN NULL ELSE false END AS adopted FROM y""",
    "proven_absence": f"""
        WITH l AS (SELECT * FROM {LINES}), n AS (SELECT DISTINCT l_orderkey AS snapshot, suppkey AS name FROM l WHERE flag <> 'A'),
             b AS (SELECT DISTINCT l_orderkey AS snapshot FROM l WHERE l_linenumber <= 2 AND (l_orderkey, suppkey) NOT IN (SELECT (snapshot, name) FROM n))
        SELECT o_orderkey AS snapshot, o_orderkey % 10 + 1 AS name, CASE WHEN (o_orderkey, o_orderkey % 10 + 1) IN (SELECT (snapshot, name) FROM n) THEN false WHEN o_orderstatus <> 'P' AND o_orderkey % 9 <> 0 AND o_orderkey NOT IN (SELECT snapshot FROM b) THEN true END AS absent FROM orders""",
    "merged_declarations": """
        SELECT l_partkey, CASE WHEN count(DISTINCT coalesce(CAST(m AS VARCHAR), '?')) <= 1 THEN max(m) END AS mode FROM (SELECT l_partkey, CASE WHEN l_linenumber < 6 THEN l_tax END AS m FROM lineitem) GROUP BY 1""",
    "lowest_pointer": """
        WITH r AS (SELECT p_brand, p_name || '-' || p_partkey AS pointer, p_size || '.' || p_partkey % 20 AS version, p_size AS a, p_partkey % 20 AS b, p_partkey % 6 <> 0 AS has, p_partkey % 4 <> 0 AS counts, bool_or(p_partkey % 4 <> 0) OVER (PARTITION BY p_brand) AS any_counts FROM part)
        SELECT p_brand, arg_min(version, (a, b, pointer)) FILTER (has AND (counts OR NOT any_counts)) AS version, arg_min(pointer, (a, b, pointer)) FILTER (has AND (counts OR NOT any_counts)) AS pointer FROM r GROUP BY 1""",
    "cohort_agreement": """
        WITH w AS (SELECT user_id % 10 AS study, event_type AS cohort, count(*) AS weight FROM events GROUP BY 1, 2), t AS (SELECT study, sum(weight) AS total, count(*) AS n FROM w GROUP BY 1),
             s AS (SELECT study, weight, 'same' AS setting, 'x' AS value FROM w UNION ALL SELECT study, weight, 'half', CASE WHEN weight % 2 = 0 THEN 'y' ELSE 'z' END FROM w UNION ALL SELECT study, weight, CASE WHEN cohort = 'click' THEN 'clicks' ELSE 'rest' END, 'v' FROM w),
             g AS (SELECT study, setting, value, round(sum(weight) * 100 / max(total), 2) AS share, count(*) AS k, max(n) AS n FROM s JOIN t USING (study) GROUP BY 1, 2, 3)
        SELECT study, setting, value, share, CASE WHEN count(*) OVER w > 1 THEN 'conflicting' WHEN sum(k) OVER w < n THEN 'mixed' ELSE 'common' END AS agreement FROM g WINDOW w AS (PARTITION BY study, setting)""",
    "trial_reasons": """
        WITH s AS (SELECT n_name AS study, n_nationkey AS k FROM nation), b AS (SELECT r_regionkey AS b, ['linux', 'macos', 'windows'][CAST(r_regionkey % 3 AS INTEGER) + 1] AS platform, CASE WHEN r_regionkey < 3 THEN 'release' ELSE 'beta' END AS channel, r_regionkey * 5 AS v FROM region),
             c AS (SELECT study, b, channel, platform, 'platform' AS clause, CASE WHEN k % 2 = 0 THEN platform <> 'macos' ELSE platform = 'macos' END AS met FROM s, b WHERE k % 2 = 0 OR k % 5 <> 1
                   UNION ALL SELECT study, b, channel, platform, 'channel', channel = 'release' FROM s, b WHERE k % 3 = 0 UNION ALL SELECT study, b, channel, platform, 'min_version', v >= k FROM s, b UNION ALL SELECT study, b, channel, platform, 'country', NULL FROM s, b WHERE k % 7 = 0),
             v AS (SELECT study, b, channel, platform, CASE WHEN bool_or(NOT met) THEN false WHEN count(*) > count(met) THEN NULL ELSE true END AS applies FROM c GROUP BY ALL),
             d AS (SELECT v.study, v.channel, applies, v.platform, c.clause FROM v LEFT JOIN c ON c.study = v.study AND c.b = v.b AND ((NOT applies AND NOT met) OR (applies IS NULL AND met IS NULL))),
             g AS (SELECT study, channel, applies, clause, string_agg(DISTINCT platform, ', ' ORDER BY platform) AS systems FROM d GROUP BY ALL)
        SELECT study, channel, applies, list_sort(list(coalesce(clause, 'all') || ': ' || systems)) AS reasons FROM g GROUP BY ALL""",
    "typed_events": f"""
        WITH l AS (SELECT *, CASE flag WHEN 'R' THEN 'closed' WHEN 'A' THEN 'reopened' ELSE 'labeled' END AS type FROM {LINES}),
             i AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey, o_orderpriority AS title, o_orderdate, o_orderstatus = 'P' AS quiet FROM orders),
             t AS (SELECT i.*, type, shipdate, CASE WHEN type = 'labeled' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'QA Pass - Linux' WHEN l_linenumber = 1 THEN 'Regression' ELSE 'other' END END AS label FROM l JOIN i ON i.o_orderkey = l_orderkey),
             e AS (SELECT 0 AS p, 'item-tracked' AS kind, id AS key, o_orderdate AS source_at, title, quiet AS refresh_only FROM i
                   UNION ALL SELECT 0, CASE WHEN type = 'closed' THEN 'issue-closed' WHEN type = 'reopened' THEN 'issue-reopened' WHEN label = 'QA Pass - Linux' THEN 'qa-passed' ELSE 'regression-flagged' END, id || '|' || coalesce(label, '') || '|' || strftime(shipdate, '%Y-%m-%d %H:%M:%S'), shipdate, title, quiet
                   FROM t WHERE type <> 'labeled' OR label <> 'other'
                   UNION ALL SELECT 1, CASE WHEN flag = 'R' AND l_linenumber >= 5 THEN 'uplift-merged' WHEN flag = 'R' THEN 'pr-merged' ELSE 'pr-closed-unmerged' END, l_orderkey || '/' || l_linenumber, shipdate, shipmode, false FROM l WHERE flag <> 'N' AND l_linenumber <> 4)
        SELECT left(sha256(kind || '|' || key), 16) AS id, kind, key, any_value(source_at) AS source_at, any_value(title) AS title, any_value(refresh_only) AS refresh_only FROM e WHERE source_at BETWEEN TIMESTAMP '1998-06-01' - INTERVAL 365 DAYS AND TIMESTAMP '1998-06-01' GROUP BY kind, key""",
    "snapshot_changes": f"SELECT * FROM {CHANGES} WHERE what IS NOT NULL",
    "snapshot_events": f"""
        WITH d AS (SELECT *, CASE section WHEN 'build' THEN 'in-build' WHEN 'flag' THEN 'flag-changed' WHEN 'doc' THEN 'doc-changed' ELSE 'study-added' END AS kind, section || '|' || entity || '|' || cell || '|' || coalesce(value, '') AS key FROM {CHANGES}
                   WHERE CASE section WHEN 'build' THEN what = 'changed' AND was = 'false' AND value = 'true' WHEN 'study' THEN what = 'added' ELSE what = 'changed' END)
        SELECT left(sha256(kind || '|' || key), 16) AS id, kind, key, entity || ' ' || cell || ' ' || coalesce(was, 'unknown') || ' -> ' || coalesce(value, 'unknown') AS title FROM d""",
    "merged_history": f"""
        WITH {DETECTED}, h AS (SELECT * FROM k WHERE id NOT IN (SELECT id FROM e WHERE n % 17 = 0)), c AS (SELECT * FROM f WHERE id NOT IN (SELECT id FROM e WHERE n % 17 = 0)), d AS (SELECT id FROM e WHERE n % 10 = 5)
        SELECT id, h.kind, h.source_at, h.detected_at, h.basis, CASE WHEN c.id IS NOT NULL THEN 'new' ELSE 'old' END AS title, h.diff_only, CASE WHEN c.id IS NOT NULL THEN false WHEN NOT h.diff_only THEN true ELSE rules_outdated END AS rules_outdated
        FROM h LEFT JOIN c USING (id) WHERE c.id IS NOT NULL OR h.diff_only OR NOT inputs_read
        UNION ALL SELECT c.id, kind, source_at, CASE WHEN d.id IS NULL THEN TIMESTAMP '2024-01-20' ELSE TIMESTAMP '2024-01-02' END, CASE WHEN d.id IS NOT NULL OR source_at >= TIMESTAMP '2024-01-10' - INTERVAL 6 HOURS THEN 'observed' ELSE 'backfill' END, title, diff_only, false
        FROM c LEFT JOIN d ON d.id = c.id WHERE c.id NOT IN (SELECT id FROM h) AND NOT refresh_only""",
    "dropped_events": f"""
        WITH {DETECTED}, x AS (SELECT id, detected_at, basis, source_at FROM k UNION ALL SELECT id, TIMESTAMP '2024-01-03', 'observed', source_at FROM e WHERE n % 7 = 0),
             g AS (SELECT id, min((detected_at, basis, source_at)) AS w FROM x WHERE id NOT IN (SELECT id FROM f) GROUP BY 1)
        SELECT id, w[1] AS detected_at, w[2] AS basis, w[3] AS source_at FROM g ORDER BY 2 DESC, 1 LIMIT 5000""",
    "carried_fields": """
        WITH r AS (SELECT c_mktsegment AS field, c_custkey AS key, c_nationkey AS value FROM customer), m AS (SELECT * FROM r WHERE key % 3 = 0 AND key % 7 <> 0)
        SELECT *, 'stored' AS fate FROM r WHERE key % 3 <> 0 UNION ALL SELECT 'MOVED', key, value, 'stored' FROM r WHERE key % 15 = 0 UNION ALL SELECT *, 'stored' FROM m WHERE field IN ('BUILDING', 'MACHINERY')
        UNION ALL SELECT *, 'dropped' FROM m WHERE field NOT IN ('BUILDING', 'MACHINERY') AND key % 15 <> 0""",
    "archived_versions": """
        SELECT DISTINCT doc_id AS id, md5(text) AS hash, CASE WHEN doc_id % 8 = 3 THEN 'removed' WHEN doc_id % 4 <> 3 AND doc_id % 6 = 0 THEN 'no-longer-mentions' ELSE 'superseded' END AS state
        FROM documents WHERE doc_id % 8 = 3 OR (doc_id % 4 <> 3 AND (doc_id % 6 = 0 OR doc_id % 5 = 0))""",
    "upstream_releases": """
        WITH i AS (SELECT o_custkey AS package, o_orderkey AS version, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS d, o_orderstatus = 'P' AS yanked, o_orderdate FROM orders)
        SELECT package, version, CASE WHEN d IS NOT NULL THEN d WHEN version % 8 = 0 THEN o_orderdate END AS published_at, yanked FROM i""",
    "source_probes": """
        WITH t AS (SELECT source AS ref, lang AS file, arg_min(text, doc_id) AS text FROM documents GROUP BY 1, 2), c(check_id, pattern, file, file_rank) AS (VALUES ('license', '[Ll]icense', 'en', 0), ('license', '[Ll]icense', 'fr', 1), ('mail', '@', 'fr', 0), ('mail', '@', 'en', 1), ('none', 'x', 'xx', 0)),
             l AS (SELECT ref, file, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS n FROM t),
             h AS (SELECT ref, check_id, bool_or(regexp_matches(raw, pattern)) AS present, arg_min((file, n), (file_rank, n)) FILTER (regexp_matches(raw, pattern)) AS w FROM l JOIN c USING (file) GROUP BY 1, 2)
        SELECT ref, check_id, present, w[1] AS file, CAST(w[2] + 1 AS INTEGER) AS line FROM (SELECT DISTINCT ref FROM t) CROSS JOIN (SELECT DISTINCT check_id FROM c) LEFT JOIN h USING (ref, check_id)""",
    "group_rollup": f"""
        WITH m AS (SELECT *, l_linenumber BETWEEN 2 AND 6 AS pr FROM {LINES} WHERE l_linenumber <> 7)
        SELECT l_orderkey AS group_id, CASE WHEN bool_or(pr AND flag = 'R') THEN 'merged' WHEN bool_or(pr AND flag = 'N' AND suppkey % 2 <> 0) THEN 'open' WHEN bool_or(pr AND flag = 'N') THEN 'draft' WHEN bool_or(pr) THEN 'closed-unmerged' ELSE 'none' END AS implementation,
               min(shipdate) FILTER (pr AND flag = 'R') AS merged_at, max(shipdate) AS last_updated, coalesce(string_agg(DISTINCT shipmode, ',') FILTER (l_linenumber = 1), '') AS owners, CAST(count(DISTINCT suppkey) FILTER (pr) AS INTEGER) AS n_authors,
               bool_or(partkey % 9 = 0) AS regression, false AS security, CASE WHEN bool_or(partkey % 2 = 0) THEN 'mention' ELSE 'linked' END AS relevance FROM m GROUP BY 1""",
    "discovered": """
        WITH x AS (SELECT p_partkey AS id, 'large' AS t FROM part WHERE p_size > 30 UNION SELECT l_partkey, 'returned' FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_partkey, 'many' FROM lineitem WHERE l_quantity > 45)
        SELECT id, string_agg(t, ',' ORDER BY t) AS tags FROM x GROUP BY 1""",
    "topic_counts": "SELECT c_custkey, count(o_orderkey) AS total, count(*) FILTER (o_orderstatus = 'O') AS open FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
}
