"""The queries of `pages` as SQL."""

from __future__ import annotations

from .derive_sql import CELLS, LINES, STATES
from .derive_sql import SQL as DERIVED

_STATE_COLUMNS = ["available", "in-build", "opt-in", "off", "hidden", "service-off", "absent", "not-verified", "not-planned"]

_MAIN = "coalesce(nullif(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), ''), nullif(regexp_extract(html, '(?is)<main[^>]*>(.*?)</main>', 1), ''), html)"

SQL = {
    "note_blocks": """
        WITH p AS (SELECT *, p_partkey AS k, 5 * (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) AS before FROM part)
        SELECT p_brand AS file, CAST(before + 3 AS INTEGER) AS line, '1.' || p_size || '.' || k AS version, p_type AS section, p_name AS entry FROM p""",
    "lock_rows": """
        SELECT s_nationkey AS ref, s_name AS name, '1.' || s_suppkey AS version, CASE WHEN s_suppkey % 2 = 0 THEN 'registry' END AS source, CASE WHEN s_suppkey % 3 = 0 THEN 'left,pad-' || s_suppkey ELSE '' END AS dependencies FROM supplier""",
    "label_facts": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'macOS' ELSE '' END AS passed, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'Linux' END AS failed, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS required, o_orderkey % 5 = 0 AS blocked,
               array_to_string(list_filter([CASE WHEN o_orderkey % 5 <> 0 THEN 'android' END, CASE WHEN o_orderkey % 7 = 0 THEN 'desktop' END], lambda x: x IS NOT NULL), ',') AS systems, '1.' || o_orderkey % 100 AS line,
               CASE WHEN o_orderkey % 2 = 0 THEN 'release' ELSE 'nightly' END AS channel, o_orderkey % 3 = 0 AS release_branch FROM orders""",
    "reference_lists": """
        SELECT o_orderkey, 'a/b#' || o_orderkey || ' own/lib#' || o_orderkey || ' c/d#5 own/repo#' || left(lpad(CAST(o_orderkey AS VARCHAR), 5, '1'), 5) AS refs, 'a/b#' || o_orderkey || ' own/lib#' || o_orderkey AS closes FROM orders""",
    "stored_source": "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 3 <> 0",
    "source_counters": """
        WITH r AS (SELECT user_id AS source, event_id AS "at", CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'ok' ELSE 'partial' END AS outcome FROM events),
             b AS (SELECT *, sum(CASE WHEN outcome = 'ok' THEN 1 ELSE 0 END) OVER w AS blk, max(CASE WHEN outcome <> 'failed' THEN "at" END) OVER w AS last_success_at, max(CASE WHEN outcome = 'ok' THEN "at" END) OVER w AS last_complete_at FROM r WINDOW w AS (PARTITION BY source ORDER BY "at"))
        SELECT source, "at", outcome, CAST(sum(CASE WHEN outcome = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY source, blk ORDER BY "at") AS BIGINT) AS failures, last_success_at, last_complete_at FROM b""",
    "flag_groups": """
        WITH l AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 3 WHEN l_linenumber = 7 THEN 0 WHEN l_returnflag = 'A' THEN 1 ELSE 2 END AS r FROM lineitem)
        SELECT l_orderkey, ['missing', 'off', 'unknown', 'on'][min(r) + 1] AS state FROM l GROUP BY 1""",
    "note_bounds": f"""
        WITH p AS (SELECT p_partkey, p_size AS a, p_partkey % 3 AS b, p_partkey % 50 AS c, {STATES}[CAST(p_partkey % 9 AS INTEGER) + 1] AS found FROM part)
        SELECT p_partkey, CASE WHEN b = 0 THEN CASE WHEN a < c OR (a = c AND b <= 1) THEN 'within' ELSE 'newer' END WHEN b = 1 THEN CASE WHEN a = c THEN 'same-line' WHEN a < c THEN 'within' ELSE 'newer' END END AS bound,
               CASE WHEN p_partkey % 4 = 0 AND found IN ('available', 'in-build', 'opt-in', 'off') THEN 'not-verified' ELSE found END AS state, found FROM p""",
    "kept_orders": """
        WITH h AS (SELECT o_custkey, max(o_orderkey) AS page, arg_max(CASE WHEN o_orderkey % 11 <> 0 THEN {d: o_orderdate} ELSE {d: NULL} END, o_orderkey).d AS "at" FROM orders GROUP BY 1)
        SELECT * FROM h WHERE ("at" IS NULL OR "at" >= TIMESTAMP '2000-06-01' - INTERVAL 400 DAYS) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0)""",
    "group_detail": f"""
        WITH m AS (SELECT DISTINCT partkey AS i, flag FROM {LINES} WHERE l_orderkey = 7)
        SELECT 'member' AS part, CAST(i AS VARCHAR) AS id, flag AS role FROM m UNION ALL SELECT 'event', 'e' || p_partkey, NULL FROM part WHERE p_partkey IN (SELECT i FROM m)
        UNION ALL SELECT 'report', 'r' || p_partkey, NULL FROM part WHERE p_size > 25 AND (p_partkey IN (SELECT i FROM m) OR p_partkey + 1 IN (SELECT i FROM m))""",
    "wanted_sizes": """
        WITH k AS (SELECT p_partkey FROM part WHERE p_partkey % 50 <> 0 ORDER BY p_size DESC, p_partkey % 20 DESC, p_partkey LIMIT 12)
        SELECT p_partkey, p_size || '.' || p_partkey % 20 AS version, p_partkey % 50 = 0 OR p_partkey IN (SELECT p_partkey FROM k) AS kept FROM part""",
    "private_columns": "SELECT o_orderkey, 'see own/open#' || o_orderkey || ' and [private reference] or [private link] by [mail]' AS text FROM orders",
    "page_parts": rf"""
        WITH a AS (SELECT page_id, coalesce(nullif(regexp_extract(html, '(?i)<meta[^>]{{0,200}}property="og:title"[^>]{{0,200}}content="([^"]*)"', 1), ''), trim(nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ''))) AS title,
                          regexp_replace(regexp_replace(regexp_replace(regexp_replace({_MAIN}, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?is)<(br|/p|/li|/h[0-9]|/div|/tr)[^>]*>', chr(10), 'g'), '(?s)<[^>]+>', ' ', 'g') AS t FROM pages),
             b AS (SELECT page_id, title, replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&') AS t FROM a)
        SELECT page_id, title, md5(regexp_replace(regexp_replace(regexp_replace(t, '[ \t\f\x0b]+', ' ', 'g'), '\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS main_md5 FROM b""",
    "first_sentences": r"""
        WITH s AS (SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?])[ \n]+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM documents), e AS (SELECT doc_id, unnest(ss) AS s, unnest(range(len(ss))) AS n FROM s),
             f AS (SELECT *, regexp_matches(s, '[Ll]icense|rights|token') AS topical, regexp_matches(s, '^(Only|Not) ') AS lim FROM e),
             g AS (SELECT *, sum(CASE WHEN topical OR NOT lim THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM f),
             j AS (SELECT doc_id, min(n) AS n, string_agg(s, ' ' ORDER BY n) AS t FROM g GROUP BY doc_id, g HAVING bool_or(topical)),
             c AS (SELECT doc_id, n, CASE WHEN length(t) <= 320 THEN t ELSE regexp_replace(substring(t, 1, 319), ' [^ ]*$', '') || '…' END AS t FROM j),
             d AS (SELECT doc_id, t, min(n) AS n FROM c GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INTEGER) AS place FROM d)
        SELECT doc_id AS id, place, md5(t) AS sentence_md5 FROM r WHERE place <= 8""",
    "item_pages": """
        SELECT 'own/repo#' || o_orderkey AS id, o_orderkey AS number, CASE WHEN o_orderstatus = 'F' THEN 'pr' ELSE 'issue' END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN 'later' ELSE o_orderpriority END AS title,
               CASE o_orderstatus WHEN 'F' THEN 'merged' WHEN 'O' THEN 'open' ELSE 'closed' END AS state, 'p/' || o_orderpriority AS label, o_orderdate AS created_at FROM orders""",
    "item_timeline": f"""
        WITH l AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INTEGER) AS position FROM {LINES})
        SELECT 'a/b#' || l_orderkey AS id, position, CASE WHEN flag = 'R' THEN 'closed' ELSE 'labeled' END AS type, shipmode AS label, shipdate AS "at" FROM l WHERE flag <> 'A'""",
    "release_pages": """
        SELECT 't' || p_partkey AS tag, CASE p_partkey % 4 WHEN 0 THEN 'release' WHEN 1 THEN 'beta' WHEN 2 THEN 'nightly' END AS channel, '1.' || p_size || '.' || p_partkey % 90 AS version,
               CASE WHEN p_partkey % 2 = 0 THEN 'android,macos' ELSE 'macos,windows' END AS platforms FROM part WHERE p_partkey % 7 <> 0""",
    "item_edges": f"""
        WITH RECURSIVE l AS (SELECT *, l_orderkey * 10 + l_linenumber AS id, l_orderkey * 10 AS issue FROM {LINES}), o AS (SELECT o_orderkey * 10 AS id, o_orderkey AS k, o_orderpriority AS title FROM orders),
             named AS (SELECT a.id AS src, b.id AS dst FROM l a JOIN l b ON b.id = a.id - 1 AND b.issue = a.issue WHERE a.l_linenumber >= 5 AND a.flag <> 'N'),
             crossed AS (SELECT b.id AS src, a.id AS dst FROM l a JOIN l b ON b.id = a.id + 1 AND b.issue = a.issue WHERE a.l_linenumber = 4 AND b.id NOT IN (SELECT src FROM named)),
             up AS (SELECT * FROM named UNION SELECT * FROM crossed), above AS (SELECT src, dst FROM up UNION SELECT a.src, u.dst FROM above a JOIN up u ON u.src = a.dst),
             direct AS (SELECT l.id AS src, issue AS dst FROM l JOIN o ON o.id = issue WHERE (flag = 'R' AND l_linenumber < 5) OR (l_linenumber = 2 AND flag = 'N')
                        UNION SELECT l.id, issue FROM l JOIN o ON o.id = issue WHERE flag = 'A' AND l_linenumber < 5 AND CASE WHEN shipmode = 'AIR' THEN title = '1-URGENT' ELSE title = '3-MEDIUM' END),
             res AS (SELECT * FROM direct UNION SELECT a.src, d.dst FROM above a JOIN direct d ON d.src = a.dst),
             men AS (SELECT l.id AS src, issue AS dst FROM l JOIN o ON o.id = issue WHERE flag <> 'A' UNION SELECT a.id, b.id FROM o a JOIN o b ON b.k = a.k - 1 WHERE a.k % 4 = 1)
        SELECT 'uplift' AS kind, src, dst FROM up UNION ALL SELECT 'resolves', src, dst FROM res UNION ALL SELECT 'mentions', src, dst FROM men WHERE (src, dst) NOT IN (SELECT (src, dst) FROM res)
        UNION ALL SELECT 'epic', a.id, b.id FROM o a JOIN o b ON b.k = a.k + 1 WHERE a.k % 6 = 0""",
    "duplicate_decisions": """
        WITH m AS (SELECT o_custkey AS id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) + 1000000000 AS marked FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1),
             c AS (SELECT c_custkey AS id, marked, c_custkey % 2 = 0 AS closed, c_custkey % 7 = 0 AS as_dup, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 <> 0 THEN c_custkey - c_custkey % 5 END AS said, c_custkey % 11 = 0 AS label FROM customer LEFT JOIN m ON m.id = c_custkey),
             b AS (SELECT *, CASE WHEN as_dup THEN 'closed as duplicate' WHEN closed AND said IS NOT NULL THEN 'closing comment' WHEN marked IS NOT NULL THEN 'marked as duplicate' WHEN label THEN 'label' END AS basis FROM c)
        SELECT id, CASE WHEN basis = 'closing comment' THEN said ELSE coalesce(marked, CASE WHEN basis = 'closed as duplicate' THEN said END) END AS canonical, basis FROM b WHERE basis IS NOT NULL""",
    "event_groups": f"""
        WITH m AS (SELECT l_orderkey AS g, partkey AS i, CASE WHEN l_linenumber = 1 THEN 0 WHEN l_linenumber < 4 THEN 1 ELSE 2 END AS r FROM {LINES})
        SELECT p_partkey AS id, arg_min(g, (r, g)) AS group_id FROM part JOIN m ON m.i IN (p_partkey, p_partkey + 1) GROUP BY 1""",
    "note_rules": """
        WITH d AS (SELECT doc_id, split_part(text, chr(10), 1) AS t FROM documents), r AS (SELECT n_nationkey AS rule_id, ['the', 'der', 'que', 'zz', '[0-9]'][CAST(n_nationkey AS INTEGER) + 1] AS p, n_nationkey * 7 AS issue FROM nation WHERE n_nationkey < 5)
        SELECT doc_id AS note_id, rule_id FROM d, r WHERE (doc_id % 50 = issue OR regexp_matches(t, p)) AND NOT (rule_id % 2 = 0 AND regexp_matches(t, 'and'))""",
    "probe_roles": f"""
        WITH l AS (SELECT l_orderkey, l_linenumber % 3 AS r, CASE flag WHEN 'R' THEN true WHEN 'A' THEN false END AS p FROM {LINES})
        SELECT l_orderkey, bool_or(r = 0 AND coalesce(p, false)) AS opt_in, NOT bool_or(r = 1 AND coalesce(NOT p, false)) AS required_present, bool_or(r = 2 AND coalesce(p, false)) AS blocked, count(*) FILTER (r = 1 AND p IS NULL) AS required_unknown FROM l GROUP BY 1""",
    "earliest_orders": "SELECT * FROM (SELECT o_custkey, o_orderkey, o_orderdate, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS nth FROM orders) WHERE nth <= 3",
    "flag_defaults": """
        WITH b AS (SELECT p_brand AS place, min(p_size) AS s FROM part GROUP BY 1), f AS (SELECT p_brand, p_type AS name, max(p_size) AS m FROM part WHERE p_size > 20 GROUP BY 1, 2)
        SELECT place, n.name, CASE WHEN s >= 40 THEN NULL WHEN m IS NULL THEN 'missing' WHEN s % 2 = 0 THEN CASE WHEN m % 2 = 0 THEN 'on' ELSE 'off' END END AS state
        FROM b CROSS JOIN (SELECT DISTINCT name FROM f) n LEFT JOIN f ON f.p_brand = b.place AND f.name = n.name AND s < 40""",
    "contrary_docs": f"""
        SELECT entity, place, state FROM {CELLS} WHERE state IN ('available', 'in-build', 'opt-in', 'off') AND (entity, place) IN (SELECT (CAST(least(p_size // 10, 4) AS INTEGER), p_brand) FROM part WHERE p_partkey % 3 = 0)""",
    "evidence_cells": """
        SELECT entity, place, CAST(count(p_partkey) AS INTEGER) AS n, CAST(count(*) FILTER (p_size > 40) AS INTEGER) AS n_contrary
        FROM (SELECT DISTINCT p_type AS entity FROM part) CROSS JOIN (SELECT DISTINCT p_brand AS place FROM part) LEFT JOIN part ON p_type = entity AND p_brand = place GROUP BY 1, 2""",
    "compared_events": f"""
        WITH e AS (SELECT p_partkey AS id, CAST(least(p_size // 9, 5) AS INTEGER) AS entity, p_brand AS place, CASE WHEN p_partkey % 2 = 0 THEN 'available' ELSE 'absent' END AS state FROM part)
        SELECT e.*, c.state AS now, CASE WHEN c.state IS NULL THEN 'not-shown' WHEN c.state = e.state THEN 'same' ELSE 'changed-since' END AS verdict FROM e LEFT JOIN {CELLS} c USING (entity, place)""",
    "read_inputs": """
        SELECT o_orderkey AS id, o_orderpriority AS kind, o_custkey % 9 <> 0 AND NOT (o_orderpriority = '5-LOW' AND (SELECT count(*) FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'P') > 0) AS inputs_read FROM orders""",
    "notes_page": """
        WITH n AS (SELECT DISTINCT p_brand AS platform, p_size AS a, p_partkey % 5 AS b, p_name FROM part), g AS (SELECT platform, a, b, string_agg(p_name, '|' ORDER BY p_name) AS lines FROM n GROUP BY 1, 2, 3),
             c AS (SELECT p_brand AS platform, p_size AS a, p_partkey % 5 AS b, string_agg(DISTINCT CASE WHEN p_partkey % 20 = 0 THEN 'release' ELSE 'beta' END, ',' ORDER BY CASE WHEN p_partkey % 20 = 0 THEN 'release' ELSE 'beta' END) AS channels FROM part WHERE p_partkey % 10 = 0 GROUP BY 1, 2, 3)
        SELECT platform, a || '.' || b AS version, lines, CAST(row_number() OVER (PARTITION BY platform ORDER BY a DESC, b DESC) AS INTEGER) AS place, channels FROM g LEFT JOIN c USING (platform, a, b)""",
    "overview_page": f"""
        WITH a AS ({DERIVED["advisory_exposure"]}), o AS (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 6)
        SELECT 'work' AS part, 'total' AS label, count(*) AS n FROM orders UNION ALL SELECT 'work', 'open', count(*) FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'work', 'open_bugs', count(*) FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'
        UNION ALL SELECT 'work', 'regressions', count(*) FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT 'recent', o_orderpriority, count(*) FROM o GROUP BY 2
        UNION ALL SELECT 'advisories', CASE WHEN affected THEN 'affected' WHEN affected IS NULL THEN 'unknown' ELSE 'not-affected' END, count(*) FROM a GROUP BY 2""",
    "feed_counts": """
        SELECT p_type AS kind, count(*) AS n, count(*) FILTER (p_size > 25) AS highlights FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'widget') AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand') GROUP BY 1""",
    "sources_page": """
        WITH e AS (SELECT user_id AS source_id, max(ts) < TIMESTAMP '2024-01-30' - INTERVAL 48 HOURS AS stale, arg_max(event_type, (ts, event_id)) = 'error' AS failing FROM events GROUP BY 1)
        SELECT *, CASE WHEN failing THEN 'failing' WHEN stale THEN 'stale' ELSE 'fresh' END AS counts_as FROM e""",
    "work_search": """
        WITH x AS (SELECT p_partkey AS position, 'Feature' AS kind, lower(p_name) AS title, lower(p_name || ' ' || p_brand || ' ' || p_type) AS hay, 0 AS r FROM part
                   UNION ALL SELECT doc_id + 1000000000, 'Page', lower(split_part(text, chr(10), 1)), lower(text), 1 FROM documents)
        SELECT position, kind, CAST(r * 10 + CASE WHEN contains(title, 'the') AND contains(title, 'an') THEN 0 ELSE 5 END AS INTEGER) AS score FROM x WHERE contains(hay, 'the') AND contains(hay, 'an') ORDER BY 3, 1 LIMIT 40""",
    "severe_orders": """
        SELECT o_orderkey AS id, CASE WHEN o_totalprice > 400000 THEN 0 ELSE CAST(left(o_orderpriority, 1) AS INTEGER) END AS severity FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 2 = 0 AND o_orderpriority <> '5-LOW' ORDER BY 2, o_orderdate DESC, 1 LIMIT 200""",
    "page_guards": r"""
        SELECT page_id, CASE WHEN regexp_full_match(url, '(?i)https?://[^\s/?#"''<>]+[^\s"''<>]*') THEN url END AS url, '/p/' || page_id AS target, CAST(NULL AS VARCHAR) AS "foreign" FROM pages""",
    "uplift_labels": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey END AS pr, CASE WHEN o_orderkey % 2 = 0 THEN CAST(left(lpad(CAST(o_orderkey AS VARCHAR), 5, '1'), 5) AS BIGINT) END AS issue,
               array_to_string(list_filter((['own/repo#' || lpad(CAST(o_orderkey AS VARCHAR), 7, '2'), 'own/repo#' || o_orderkey || '99', 'own/repo#78', CASE WHEN o_orderkey % 5 = 0 THEN 'own/repo#4567' END, CASE WHEN o_orderkey % 2 = 1 THEN 'own/repo#' || o_orderkey END]), lambda n: n IS NOT NULL), ' ') AS names,
               'own/repo#' || o_orderkey AS id, 'https://host.example/a/b/pull/' || o_orderkey AS url FROM orders""",
    "rule_cells": "SELECT place, " + ", ".join(f"count(*) FILTER (state = '{s}') AS {s.replace('-', '_')}" for s in _STATE_COLUMNS) + f" FROM {CELLS} GROUP BY 1",
}
