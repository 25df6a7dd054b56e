"""Operator 5: a threshold table of quality rules, compiled into one projection without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# Frequent short words of the four languages.
STOP_WORDS = (
    "the of and to in is that it for was on as with be by this from or an are at not which have you "
    "le la les de des du et en un une que qui dans pour par sur au avec est ce pas "
    "der die das und ist von den mit für auf dem ein eine nicht zu im sich auch als "
    "el los las del y a un una por con para se lo su al es no como más"
).split()

#: A stop word counts in small letters, with a capital first, and in capitals.
STOP_FORMS = sorted({form for w in STOP_WORDS for form in (w, w.capitalize(), w.upper())})

#: name, amount, unit, least and most amount for 100 units (None: no limit). Counts are compared as whole numbers.
RULES: list[tuple[str, str, str, int | None, int | None]] = [
    ("characters a word", "word_chars", "n_words", 200, 1500),
    ("symbols a word", "n_symbols", "n_words", None, 20),
    ("stop words", "n_stop_words", "n_words", 3, None),
    ("capitals", "n_capitals", "word_chars", None, 40),
    ("exclamation marks a word", "n_exclamations", "n_words", None, 40),
    ("repeated lines", "n_dup_lines", "n_lines", None, 50),
    ("bullet lines", "n_bullet_lines", "n_lines", None, 90),
    ("ellipsis lines", "n_ellipsis_lines", "n_lines", None, 30),
]


def measured(documents: DataFrame) -> DataFrame:
    """documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the other counts of the rules."""
    text = F.coalesce(F.col("text"), F.lit(""))
    without_space = F.regexp_replace("_text", common.SPACE_CLASS + "+", "")
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(common.WORD_CLASS))
    counted = (
        documents.withColumn("_text", text)
        .withColumn("_words", common.words(F.col("_text")))
        .withColumn("_lines", lines)
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(without_space).cast("long"))
        .withColumn("n_symbols", F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long"))
        .withColumn("n_capitals", F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long"))
        .withColumn("n_exclamations", F.regexp_count("_text", F.lit("!")).cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_bullet_lines", F.size(F.filter("_lines", lambda x: x.rlike(r"\A[\x20\x09-\x0D]*[-*•]"))).cast("long"))
        .withColumn("n_ellipsis_lines", F.size(F.filter("_lines", lambda x: x.rlike(r"(?:\.\.\.|…)[\x20\x09-\x0D]*\z"))).cast("long"))
        .withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
        .withColumn("n_stop_words", F.size(F.filter("_hashes", lambda h: h.isin([F.xxhash64(F.lit(w)) for w in STOP_FORMS]))).cast("long"))
    )
    windows = "if(size(_hashes) >= 3, transform(sequence(0, size(_hashes) - 3), i -> xxhash64(_hashes[i], _hashes[i + 1], _hashes[i + 2])), cast(array() as array<bigint>))"
    counted = counted.withColumn("_windows", F.expr(windows))
    # windows found twice or more, in order of place; none are looked for where all differ
    sorted_windows = "if(size(array_distinct(_windows)) = size(_windows), cast(array() as array<struct<h: bigint, i: int>>), sort_array(transform(_windows, (h, i) -> named_struct('h', h, 'i', i))))"
    counted = counted.withColumn("_sorted", F.expr(sorted_windows))
    again = "sort_array(transform(filter(_sorted, (x, j) -> (j > 0 and x.h = get(_sorted, j - 1).h) or (j < size(_sorted) - 1 and x.h = get(_sorted, j + 1).h)), x -> x.i))"
    covered = f"aggregate({again}, named_struct('upto', 0, 'n', 0), (a, i) -> named_struct('upto', i + 3, 'n', a.n + least(3, i + 3 - a.upto)), a -> a.n)"
    counted = counted.withColumn("n_repeat_words", F.expr(covered).cast("long"))
    return counted.drop("_text", "_words", "_lines", "_hashes", "_windows", "_sorted")


def compiled(rules: list[tuple[str, str, str, int | None, int | None]] = RULES) -> Column:
    """The rules a row fails, as an array of names, in one expression."""
    failed = []
    for name, amount, unit, least, most in rules:
        low = 100 * F.col(amount) < least * F.col(unit) if least is not None else F.lit(False)
        high = 100 * F.col(amount) > most * F.col(unit) if most is not None else F.lit(False)
        failed.append(F.when(low | high, F.lit(name)))
    return F.filter(F.array(*failed), lambda x: x.isNotNull())


def judged(documents: DataFrame, rules: list[tuple[str, str, str, int | None, int | None]] = RULES) -> DataFrame:
    """documents with the counts, base_failed, failed_rules (names) and kept (neither the base nor a rule fails).

    Whole texts count. A null text counts as empty; empty texts have zero counts and fail the base. Each row is judged
    alone, so repeated rows and an empty table need no rule of their own. Columns with the name of a count or verdict
    are overwritten, and so are _text, _words, _lines, _hashes, _windows and _sorted, which go.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = measured(documents).withColumn("base_failed", base).withColumn("failed_rules", compiled(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def sql(rules: list[tuple[str, str, str, int | None, int | None]] = RULES) -> str:
    """The same in DuckDB's SQL."""
    stop = ", ".join(f"'{w}'" for w in STOP_FORMS)
    tests = [f"100 * {a} < {x} * {u}" for _, a, u, x, _ in rules if x is not None] + [f"100 * {a} > {x} * {u}" for _, a, u, _, x in rules if x is not None]
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT rid, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
        g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)),
        r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
        p AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + k AS at FROM r, (VALUES (0), (1), (2)) AS o(k)) GROUP BY rid),
        m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
                     CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                     CAST(length(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS BIGINT) AS n_capitals, CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclamations,
                     CAST(len(list_filter(ws, lambda x: x IN ({stop}))) AS BIGINT) AS n_stop_words,
                     CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
                     len(list_filter(ls, lambda x: regexp_matches(x, '\A[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines,
                     len(list_filter(ls, lambda x: regexp_matches(x, '(?:\.\.\.|…)[\x20\x09-\x0D]*\z'))) AS n_ellipsis_lines,
                     CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN p USING (rid)),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {' OR '.join(tests)}) AS kept FROM b"""
