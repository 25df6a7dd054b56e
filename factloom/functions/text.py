"""Text work as SQL expressions: references, excerpts, HTML, redaction, rule classification."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: A host, an owner and a name in an address, and the two parts of a short reference.
_HOST, _NAME = r"[^/\s]{1,200}+", r"[\w.-]++"


def extract_refs(text: Column, default_repo: Column) -> Column:
    """Addresses of issues and pull requests, `owner/name#12`, and bare `#123` (three to six digits) of the default
    repository, in this order; lower-case, distinct. Short forms start a word of their own. Linear in the text."""
    text = F.lower(F.coalesce(text, F.lit("")))
    urls = F.transform(F.regexp_extract_all(text, F.lit(rf"https?://{_HOST}/({_NAME}/{_NAME}/(?:issues|pull)/[0-9]+)"), F.lit(1)), lambda u: F.regexp_replace(u, r"/(?:issues|pull)/", "#"))
    short = F.regexp_extract_all(text, F.lit(rf"(?<![\w/.-]){_NAME}/{_NAME}#[0-9]++\b"), F.lit(0))
    bare = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![\w/#&])#([0-9]{3,6})\b"), F.lit(1)), lambda n: F.concat(F.lower(default_repo), F.lit("#"), n))
    return F.array_distinct(F.concat(urls, short, bare))


def resolves_refs(text: Column) -> Column:
    """What a closing keyword names, by address or as `owner/name#12`, as `owner/name#12` in lower case; bare numbers after a
    keyword name nothing."""
    named = rf"\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\b:?\s*+<?((?:https?://{_HOST}/{_NAME}/{_NAME}/issues/|{_NAME}/{_NAME}#)[0-9]+)"
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(named), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"\Ahttps?://[^/]+/", ""), "/issues/", "#")))


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def replace_spans(text: Column, begin: str, end: str, mark: str) -> Column:
    """Each span from `begin` to the next `end` (patterns) as a mark. Only the text up to the last `end` is searched, where
    every beginning has an end, so that time is linear; a beginning behind it has none and stays."""
    both = lambda t, head: F.concat(F.regexp_replace(head, rf"(?is){begin}.*?{end}", mark), F.substring(t, F.length(head) + 1, F.length(t)))
    return _let(text, lambda t: _let(F.regexp_extract(t, rf"(?is)\A(.*{end})", 1), lambda head: both(t, head)))


def decode_entities(text: Column) -> Column:
    """The named entities that pages use most."""
    for name, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(mark))
    return text


def decode_numeric(text: Column) -> Column:
    """Numeric character references, decimal and hexadecimal, as the characters they stand for; those of no character, and
    surrogates, as U+FFFD. Through the UTF-32 bytes of the number."""
    def char(n: Column) -> Column:
        value = F.when(n.rlike(r"\A[xX]"), F.conv(F.regexp_replace(n, r"\A[xX]", ""), 16, 10)).otherwise(n).cast("long")
        good = (value > 0) & (value <= 0x10FFFF) & ~value.between(0xD800, 0xDFFF)
        raw = F.unhex(F.lpad(F.hex(F.when(good, value).otherwise(0xFFFD)), 8, "0"))
        return F.decode(raw, "UTF-32")

    def decoded(t: Column) -> Column:
        parts = F.split(t, r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});", -1)
        found = F.regexp_extract_all(t, F.lit(r"&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), F.lit(1))
        return F.array_join(F.flatten(F.zip_with(parts, found, lambda p, n: F.array(p, F.when(n.isNull(), "").otherwise(char(n))))), "")

    return _let(text, lambda t: F.when(F.contains(t, F.lit("&#")), decoded(t)).otherwise(t))


#: White space of web texts: no-break and line separators too.
_BLANK = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"


def html_to_text(html: Column) -> Column:
    """Scripts and styles dropped, line ends where blocks end, other tags to spaces, entities decoded, white space of a line
    and empty lines collapsed. Linear in the page, also where marks are not closed."""
    bare = replace_spans(replace_spans(F.coalesce(html, F.lit("")), "<script", "</script>", " "), "<style", "</style>", " ")
    bare = replace_spans(bare, r"<(?:br|/p|/li|/h[0-9]|/div|/tr)(?=[^>]*>)", ">", "\n")
    text = decode_entities(decode_numeric(replace_spans(bare, "<(?!>)", ">", " ")))
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t\f\x0b]+", " "), r"\n\s*+", "\n"), r"\A\s+|\s+\z", ""))


def plain_excerpt(text: Column, most: int) -> Column:
    """Comments dropped; fences of code and pictures as marks; tags dropped, links to their text; marks of headings, quotes,
    emphasis and code dropped; entities decoded, control characters dropped, white space collapsed; cut at a word with an
    ellipsis. Linear in the text; link texts beyond 400 characters stay as they are."""
    plain = F.coalesce(text, F.lit(""))
    plain = replace_spans(replace_spans(plain, "<!--", "-->", " "), "```", "```", " [code] ")
    plain = replace_spans(replace_spans(plain, "<img", ">", " [image] "), "<(?!>)", ">", " ")
    images = lambda t: F.regexp_replace(t, r"!\[[^\]]{0,400}+\]\([^)]{0,2000}+\)", " [image] ")
    links = lambda t: F.regexp_replace(images(t), r"\[([^\]]{1,400}+)\]\([^)]{1,2000}+\)", "$1")
    plain = _let(plain, lambda t: F.when(F.contains(t, F.lit("](")), links(t)).otherwise(t))
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?m)^#{1,6}", ""), r"(?m)^[ \t]*+>++", "")
    plain = F.regexp_replace(plain, r"\*\*|__(?=\w)|(?<=\w)__|[*`]+", "")
    plain = F.regexp_replace(decode_entities(decode_numeric(plain)), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    plain = F.trim(F.regexp_replace(plain, _BLANK, " "))
    cut = lambda t: F.regexp_replace(F.substring(t, 1, most - 1), r" [^ ]*\z", "")
    return _let(plain, lambda t: F.when(F.length(t) <= most, t).otherwise(F.concat(cut(t), F.lit("…"))))


#: Shapes of secrets and personal marks: name, pattern, what stands instead.
REDACTIONS = [
    ("mail", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "[mail]"),
    ("key", r"\b[0-9a-fA-F]{32,64}\b", "[key]"),
    ("phone", r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "[phone]"),
    ("address", r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b", "[address]"),
    ("number", r"\b[0-9]{13,19}\b", "[number]"),
]


#: The mail shape as it is looked for: bounded and possessive, so that long runs take time in proportion to their length.
BOUNDED_MAIL = r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,20}+"


def redact(text: Column) -> tuple[Column, Column]:
    """The text without those shapes, and how many were replaced: the marks that came to it. Linear in its length."""

    def marks(of: Column, mark: str) -> Column:
        return ((F.length(of) - F.length(F.replace(of, F.lit(mark), F.lit("")))) / len(mark)).cast("int")

    text = F.coalesce(text, F.lit(""))
    out = text
    for name, pattern, mark in REDACTIONS:
        out = F.regexp_replace(out, BOUNDED_MAIL if name == "mail" else pattern, mark)
    count = F.lit(0)
    for _, _, mark in REDACTIONS:
        count = count + marks(out, mark) - marks(text, mark)
    return out, count


def redact_references(text: Column, allowed: list[str], rounds: int = 5) -> Column:
    """Links and `owner/name#12` to repositories that are not allowed become a mark, again and again until nothing more is
    found, at most `rounds` times: what a replacement puts next to each other may be another one."""
    listed = "|".join(re.escape(a) for a in allowed) or r"\b\B"
    name = r"[\w.-]{1,100}/[\w.-]{1,100}"
    link = rf"(?i)https?://[\w.-]{{1,100}}/(?!(?:{listed})(?![\w.-])){name}(?:/(?:issues|pull|commit|blob|tree)/[\w./#-]{{1,300}})?"
    short = rf"(?i)(?<![\w./-])(?!(?:{listed})(?![\w.-])){name}#[0-9]{{1,9}}"
    for _ in range(rounds):
        text = F.regexp_replace(F.regexp_replace(text, link, "[private link]"), short, "[private reference]")
    return text


def redact_columns(df: DataFrame, columns: list[str], allowed: list[str]) -> DataFrame:
    """df with those text columns without private references and secrets."""
    for c in columns:
        clean = redact(redact_references(F.col(c), allowed))[0]
        df = df.withColumn(c, F.when(F.col(c).isNotNull(), clean))
    return df


def page_fields(html: Column) -> Column:
    """struct(title, published, main): of the first article, else main, else the whole page; title and date from meta tags,
    else the title element; NULL where there is none. Linear in the page."""
    found = lambda pattern: F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))
    # what has no end cannot match, and is not looked for from every beginning
    whole = lambda tag: F.when(F.contains(F.lower(html), F.lit(f"</{tag}>")), found(rf"(?is)\A.*?<{tag}(?![a-z0-9])[^>]*>(.*?)</{tag}>"))
    main = F.coalesce(whole("article"), whole("main"), html)
    title = F.coalesce(found(r'(?i)<meta[^>]{0,200}property="og:title"[^>]{0,200}content="([^"]*)"'), F.trim(whole("title")))
    published = F.coalesce(found(r'(?i)<meta[^>]{0,200}property="article:published_time"[^>]{0,200}content="([^"]*)"'), found(r'(?i)<time[^>]{0,200}datetime="([^"]*)"'))
    return F.struct(title.alias("title"), published.alias("published"), html_to_text(main).alias("main"))


def topical_sentences(texts: DataFrame, vocabulary: str, limits: str, most: int = 8, longest: int = 320) -> DataFrame:
    """texts(id, text) -> id, place (from 1), sentence: sentences with a word of the vocabulary, each with the sentences right
    behind it that state limits of platforms, cut at `longest` characters, distinct, the first `most` of a text."""
    order = Window.partitionBy("id").orderBy("at")  # the sentences of one text
    rows = texts.select("id", F.posexplode(F.split("text", r"(?<=[.!?])[ \n]+")).alias("at", "s"))
    topical, limit = F.col("s").rlike(vocabulary), F.col("s").rlike(limits)
    grouped = rows.withColumn("_start", topical | ~limit).withColumn("_group", F.sum(F.col("_start").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = grouped.groupBy("id", "_group").agg(F.min("at").alias("at"), F.bool_or(topical).alias("topical"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]), " ").alias("sentence"))
    cut = F.when(F.length("sentence") <= longest, F.col("sentence")).otherwise(F.concat(F.regexp_replace(F.substring("sentence", 1, longest - 1), r" [^ ]*$", ""), F.lit("…")))
    one = joined.filter("topical").select("id", "at", cut.alias("sentence")).groupBy("id", "sentence").agg(F.min("at").alias("at"))
    return one.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("id", "place", "sentence")


def classify(first: Column, rest: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The first rule that matches the first text, else the first that matches the rest, else `otherwise`."""
    out = None
    for text in (first, rest):
        for name, pattern in rules:
            hit = F.coalesce(text, F.lit("")).rlike(pattern)
            out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def title_tokens(text: Column, stop: list[str]) -> Column:
    """Significant words: longer than two characters, not stop words, plural s dropped."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}0-9]+", " "), " ")
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(stop))
    return F.array_distinct(F.transform(kept, lambda w: F.regexp_replace(w, "s$", "")))
