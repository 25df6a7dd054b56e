"""The pipeline against each stage's own rule by brute force."""

import random
import re

import corpus_pipeline

from factloom.llm import common


def test_stages_one_after_the_other(spark, tmp_path):
    rng = random.Random(6)
    words = ["the", "river", "runs", "past", "old", "mills", "and", "long", "fields", "where", "children", "walk", "every", "day", "in", "spring"]
    some = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "ly", "er"]) for _ in range(n))
    item = some(30)
    good = [some(rng.randrange(60, 200)) for _ in range(60)]
    near = good[0].split()
    near[5] = "other"
    texts = [*good, good[1], " ".join(near), some(40) + " " + item + " " + some(40), "### $$$ |||| %%%% " * 60, some(80) + " write to ann.smith@mail.example.com", None, ""]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    base = f"file://{tmp_path}"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    rows, kept = common.table(spark, base, "documents"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = common.saved(stage(spark, rows, base), "stage")
        assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r.text for r in rows.collect()}
    first, second, third, fourth = kept.values()
    assert set(first) == set(range(len(docs))) - {63}
    assert set(second) == set(first) - {60, 61}
    assert set(third) == set(second) - {62}
    assert set(fourth) == set(third) and not re.search("ann.smith@", fourth[64]) and {i: t for i, t in fourth.items() if i != 64} == {i: t for i, t in third.items() if i != 64}
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, base).collect()
    assert {r.doc_id for r in packed} == set(fourth) and sum(r.start == 0 for r in packed) == len(fourth)
