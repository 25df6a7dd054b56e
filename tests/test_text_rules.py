"""Texts by their rules, and in linear time where marks are not closed."""

import time

import pytest
from pyspark.sql import functions as F

from factloom.functions import items, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


EXCERPTS = {
    None: "", "": "", "a <!-- b\n c --> d": "a d", "a <!-- b": "a <!-- b", "x ```\ncode\n``` y": "x [code] y", "<img src=a> b <b>c</b>": "[image] b c",
    "![p](q) [t](u) [n]": "[image] t [n]", "# Head\n> quoted\n **bold** `code`": "Head quoted bold code", "a &lt;b&gt; &#233;&amp;lt;": "a <b> é&lt;",
    "snake__case __strong__": "snakecase strong", "a\u00a0\u2028b\x07c": "a bc", "<> a": "<> a",
}


@pytest.mark.parametrize("given", list(EXCERPTS))
def test_excerpts(spark, given):
    assert one(spark, given, lambda c: text.plain_excerpt(c, 420)) == EXCERPTS[given]


def test_excerpts_end_at_a_word(spark):
    assert one(spark, "word " * 200, lambda c: text.plain_excerpt(c, 20)) == "word word word…"
    assert one(spark, "w" * 50, lambda c: text.plain_excerpt(c, 20)) == "w" * 19 + "…"


def test_html_keeps_the_ends_of_blocks(spark):
    page = "<style>p{}</style><h1>T</h1><script>if (a<b) {}</script><p>one<br>two &amp; <b>three</b></p>\n\n<ul><li>a</li><li>b</ul> end <script"
    assert one(spark, page, text.html_to_text) == "T\none\ntwo & three \na\nb end <script"


def test_time_is_linear_in_the_text(spark):
    marks = ["<!--", "[", "![", "<", "<script", "```", "a", " ", "\n", "a/", "x](", "fix ", "> ", "<article>", "https://"]
    table = spark.createDataFrame([(m * (1_000_000 // len(m)),) for m in marks], "t string").repartition(4)
    c = F.col("t")
    columns = [F.length(text.html_to_text(c)), F.length(text.plain_excerpt(c, 420)), F.size(text.extract_refs(c, F.lit("a/b"))), F.size(text.resolves_refs(c)), F.length(text.page_fields(c)["main"]), F.size(items.uplift_refs(c, c, c, F.lit("a/b")))]
    for column in columns:
        began = time.time()
        assert len(table.select(column).collect()) == len(marks)
        assert time.time() - began < 60  # quadratic patterns take an hour


def test_what_items_say(spark):
    row = spark.createDataFrame([("QA Pass-Win64", "word_57635_2", "Merge pull request #7 from x (#8) y")], "a string, b string, c string")
    got = row.select(items.qa_platform(F.col("a")), items.branch_ref(F.col("b")), items.branch_ref(F.col("c")), items.pr_number(F.col("c"))).first()
    assert tuple(got) == ("desktop", 57635, None, 7)
    body = "Uplift of #12\n- uplift from https://h.org/o/r/pull/13\n- #14 - title\n- see #15\nmentions #16"
    names = lambda head, title: spark.createDataFrame([(body, title, head)], "b string, t string, h string").select(items.uplift_refs(F.col("b"), F.col("t"), F.col("h"), F.lit("O/R")).alias("x")).first().x
    assert names("pr17_my_branch_1.98.x", "Uplift #18 to 1.98.x") == [f"o/r#{n}" for n in (12, 13, 14, 18, 17)]
    assert names("pr17_my_branch", "About #18") == [f"o/r#{n}" for n in (12, 13, 14)]
