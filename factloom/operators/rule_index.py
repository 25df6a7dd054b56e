"""Many patterns against many texts: three letters that a pattern needs are an index of it.

A text can only match a pattern if it has every run of letters that the pattern spells out. Of the threes of such a run the
one that the fewest texts have is the pattern's key; texts are joined with patterns on it, and the pattern itself decides.
Neither side is broadcast, and no rule is left out: patterns that spell out no three letters in a row meet all texts
(see `paired`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.sources.tables import paired, saved

#: Rules up to which all are tried on every text.
FEW = 64


def spelled_out(pattern: Column) -> Column:
    """Array of arrays: for each alternative of a pattern the runs of three or more letters and digits, in lower case, that
    all its matches have. NULL where nothing is certain: groups, classes, and characters that may be absent."""
    bare = F.regexp_replace(pattern, r"\A\(\?i\)", "")
    unsure = bare.rlike(r"[\[\](){}?*]|\\[QEpPuxkc0-9]")
    plain = F.regexp_replace(bare, r"\\.|[^A-Za-z0-9|]", " ")
    runs = F.transform(F.split(F.lower(plain), r"\|"), lambda a: F.regexp_extract_all(a, F.lit("[a-z0-9]{3,}"), F.lit(0)))
    return F.when(~unsure & ~F.exists(runs, lambda a: F.size(a) == 0), runs)


def threes(text: Column) -> Column:
    """The different threes of characters of a text in lower case; linear in the text."""
    chars = F.split(F.lower(text), "")
    return F.when(F.length(text) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(chars) - 3), lambda i: F.concat(F.get(chars, i), F.get(chars, i + 1), F.get(chars, i + 2)))))


def candidates(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """text_id, rule_id: for texts(text_id, text) and runs(rule_id, alternative, run), every pair where the text has the rarest
    three of all runs of an alternative; a superset of the texts that have all its runs. Unequal rules cost what they
    find: a rule whose rarest three is in no text is never met."""
    held = saved(texts.select("text_id", F.explode(threes(F.col("text"))).alias("three")), "threes")
    wanted = runs.select("rule_id", "alternative", F.explode(threes(F.col("run"))).alias("three")).distinct()
    often = held.join(wanted.select("three").distinct(), "three", "left_semi").groupBy("three").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(often, "three", "left").groupBy("rule_id", "alternative").agg(F.min_by("three", F.struct(F.coalesce("n", F.lit(0)), "three")).alias("three"))
    return held.join(rarest, "three").select("text_id", "rule_id").distinct()


def having(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """text_id, term: texts(text_id, text) that have a term of terms(term), upper and lower case alike."""
    terms = terms.select("term").distinct()
    met = candidates(texts, terms.filter("length(term) >= 3").select(F.col("term").alias("rule_id"), F.lit(0).alias("alternative"), F.col("term").alias("run")))
    found = met.join(texts, "text_id").filter(F.contains(F.lower("text"), F.lower("rule_id"))).select("text_id", F.col("rule_id").alias("term"))
    short = paired(texts, terms.filter("length(term) < 3"), F.contains(F.lower("text"), F.lower("term"))).select("text_id", "term")
    return found.unionByName(short)


def matching(texts: DataFrame, rules: DataFrame, few: int = FEW) -> DataFrame:
    """text_id, rule_id: texts(text_id, text) that have the pattern of rules(rule_id, pattern). Patterns are Java's; a rule
    without one matches nothing, and so does a null text. rule_id tells rules apart."""
    rules = rules.select("rule_id", "pattern").filter("pattern IS NOT NULL")
    if rules.limit(few + 1).count() <= few:
        return paired(texts, rules, F.rlike(F.col("text"), F.col("pattern"))).select("text_id", "rule_id")
    rules = saved(rules.withColumn("_runs", spelled_out(F.col("pattern"))), "rules")
    texts = saved(texts.filter("text IS NOT NULL"), "texts")
    runs = rules.filter("_runs IS NOT NULL").select("rule_id", F.posexplode("_runs").alias("alternative", "_each")).select("rule_id", "alternative", F.explode("_each").alias("run"))
    met = candidates(texts, runs).join(texts, "text_id").join(rules.select("rule_id", "pattern"), "rule_id").filter(F.rlike(F.col("text"), F.col("pattern"))).select("text_id", "rule_id")
    rest = paired(texts, rules.filter("_runs IS NULL").select("rule_id", "pattern"), F.rlike(F.col("text"), F.col("pattern"))).select("text_id", "rule_id")
    return met.unionByName(rest)
