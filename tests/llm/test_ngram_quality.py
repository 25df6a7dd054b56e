"""The classifier's limit: the quantile itself, of trusted texts that the model has not seen."""

import random

from pyspark.sql import functions as F

from factloom.llm import ngram_quality


def test_limit_is_the_quantile_of_texts_left_out(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("aeiounrstlm") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(20, 120))), "en") for i in range(1500)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = ngram_quality.judged(table, table.select("doc_id")).withColumn("own", ngram_quality.left_out(F.col("text"))).collect()
    own = [r for r in out if r.own]
    assert 200 < len(own) < 400
    ordered = sorted(r._perplexity for r in own)
    assert ordered[int(0.98 * len(own))] <= own[0]._limit < ordered[-1]
    assert 0 < sum(not r._kept for r in own) <= 0.011 * len(own) + 1


def brute_force(texts, order=ngram_quality.ORDER):
    """log p of a text under the model, straight from the formulas, with dictionaries of byte strings."""
    import math
    from collections import Counter

    padded = lambda t: bytes([ngram_quality.START]) * (order - 1) + t.encode() + bytes([ngram_quality.END])
    counts = {order: Counter(d[i : i + order] for d in map(padded, texts) for i in range(len(d) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts, totals, cuts = {}, {}, {}
    for k, c in counts.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        discounts[k] = [max(0, j - (j + 1) * y * n[j + 1] / n[j]) for j in (1, 2, 3)] if n[1] and n[2] and n[3] else [0.5, 1, 1.5]
        totals[k], cuts[k] = Counter(), Counter()
        for g, m in c.items():
            totals[k][g[:-1]] += m
            cuts[k][g[:-1]] += min(m, discounts[k][min(m, 3) - 1])

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / 256
        if not totals[k][g[:-1]]:
            return p(g[1:])
        m = counts[k][g]
        own = max(0, m - discounts[k][min(m, 3) - 1]) if m else 0
        return (own + cuts[k][g[:-1]] * p(g[1:])) / totals[k][g[:-1]]

    return lambda t: sum(math.log(p(d[i : i + order])) for d in [padded(t)] for i in range(len(d) - order + 1))


def test_scores_are_those_of_the_formulas(spark, monkeypatch):
    for name, value in (("CHUNK", 3000), ("MERGE", 500), ("SHARD", 700), ("TOGETHER", 2)):
        monkeypatch.setattr(ngram_quality, name, value)
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [some(rng.randrange(1, 60)) for _ in range(80)]
    score = brute_force(texts)
    model = ngram_quality.train(spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(3))
    others = [some(20), "zzz yyy", "", None, texts[0], texts[0], "ab " * 2000, "ñ\U0001f600"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(others + texts)], "doc_id long, text string, chunk string").repartition(2)
    got = {r.doc_id: r for r in ngram_quality.scored(docs, model).collect()}
    assert len(got) == len(others + texts) and {r.chunk for r in got.values()} == {"x"}
    for i, t in enumerate(others + texts):
        assert got[i]._units == len((t or "").encode()) + 1
        assert abs(got[i]._log_p - score(t or "")) <= 1e-5 * abs(score(t or ""))


def test_repeated_words_empty_tables_and_clashing_names(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeiounrstlm") for _ in range(rng.randrange(2, 9))) for _ in range(300)] + ["it"] * 30
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(60, 120))), "en", 1) for i in range(600)]
    odd = [(9000, "it " * 200, "en", 1), (9001, None, None, 1), (9002, "", "en", 1), (9003, rows[0][1], "xx", 1), (None, rows[1][1], "en", 1)]
    schema = "doc_id long, text string, lang string, _kept int"
    table = spark.createDataFrame(rows + odd, schema)
    ids = table.filter("doc_id < 600").select("doc_id")
    out = ngram_quality.judged(table, ids)
    assert out.columns == ["doc_id", "text", "lang", "_perplexity", "_floor", "_limit", "_kept"]
    kept = {r.doc_id: r._kept for r in out.collect()}
    assert len(kept) == 605 and not kept[9000] and kept[9001] and kept[9002] and kept[9003]
    assert ngram_quality.judged(table.limit(0), ids).collect() == []
    assert all(r._kept for r in ngram_quality.judged(table, ids.limit(0)).collect())


def test_columns_named_as_limits_once_were(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("aeiounrstlm") for _ in range(rng.randrange(2, 9))) for _ in range(200)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(40)), "en", i, "h", None) for i in range(100)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, _of int, _high string, _low double")
    out = ngram_quality.judged(table, table.select("doc_id"))
    assert out.columns == [*table.columns, "_perplexity", "_floor", "_limit", "_kept"]
    assert {(r.doc_id, r._of, r._high, r._low) for r in out.collect()} == {(i, i, "h", None) for i in range(100)}
