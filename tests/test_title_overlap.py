"""Titles share tokens however many documents hold them."""

import random

import duckdb
import pytest

from factloom.plans import texts


def test_frequent_tokens_count(spark, tmp_path):
    docs = [(i, "Alpha beta gammas\nrest") for i in range(1100)] + [(2000, "alpha beta rare\n"), (2001, "beta gamma alpha delta\n"), (2002, None), (2003, "rare delta epsilon")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, "alpha beta gamma"), (2, "alpha beta gamma delta zeta"), (3, "alpha beta"), (4, "rare delta epsilon alpha beta")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.doc_id, r.item_id, r.shared) for r in texts.title_overlap(spark, f"file://{tmp_path}").collect())
    want = [(i, k, 3) for i in range(1100) for k in (1, 2)] + [(2000, 4, 3), (2001, 1, 3), (2001, 2, 4), (2001, 4, 3), (2003, 4, 3)]
    assert got == want


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_long_titles_do_not_move_once_a_token(spark, tmp_path):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrtuvwxyz", k=9)) for _ in range(4000)]
    docs = [(i, " ".join(rng.sample(words, 1000))) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(i, " ".join(rng.sample(words[:400], 12))) for i in range(20)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = shuffled(spark)
    got = sorted((r.doc_id, r.item_id, r.shared) for r in texts.title_overlap(spark, f"file://{tmp_path}").collect())
    assert shuffled(spark) - before < 1_000_000  # the documents have 600,000 bytes
    assert got == [(i, k, n) for i, d in docs for k, t in items if (n := len({*d.split()} & {*t.split()})) >= 3]


@pytest.mark.parametrize("small", [True, False])
def test_rows_of_one_id_count_together(spark, tmp_path, monkeypatch, small):
    if not small:  # as if no side were small enough to be broadcast
        monkeypatch.setattr(texts, "broadcast_if_small", lambda df: df)
    docs = [(1, "alpha beta"), (1, "beta gamma"), (2, "alpha beta gamma"), (None, "rare delta"), (None, "delta\nx"), (3, "alpha"), (3, "alpha"), (3, "alpha"), (4, None), (5, "kappa lambda omega")]
    items = [(1, "alpha beta gamma"), (2, "alpha zeta"), (3, "delta rare"), (4, "kappa"), (4, "kappa lambda"), (None, "alpha beta"), (None, "beta zeta"), (6, None)]
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        spark.createDataFrame(rows, f"{key} long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    got = sorted(((r.doc_id, r.item_id, r.shared) for r in texts.title_overlap(spark, f"file://{tmp_path}").collect()), key=repr)
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == sorted(duck.execute(texts.SQL["title_overlap"]).fetchall(), key=repr) and (1, 1, 4) in got and (4, 1, 3) not in got and (5, 4, 3) in got
