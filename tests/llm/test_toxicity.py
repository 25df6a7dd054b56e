"""Toxicity on held-out rows of a made-up language."""

import random
import zlib

from factloom.llm import toxicity


def test_held_out_rows_are_told_apart(spark):
    rng = random.Random(7)
    parts = ["ba", "ko", "li", "mu", "ne", "ra", "so", "ti"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(1, 5)))
    bad = ["zxgrump", "zxvile", "zxfoul", "qqwretch", "qqscorn"]
    docs, labels = [], []
    for i in range(1200):
        words = [word() for _ in range(rng.randrange(20, 120))]
        toxic = int(i % 5 == 0)
        for _ in range(5 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words), "s"))
        labels.append((i, toxic))
    docs += [(5000, None, "s"), (5001, "", "s"), (None, "ba ko", "s"), (0, docs[0][1], "s")]
    table = spark.createDataFrame(docs, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.scored(table, marks).collect()
    assert len(got) == len(docs)
    truth = dict(labels)
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    right = sum(r.predicted == truth[r.doc_id] for r in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.predicted for r in got if r.doc_id in (5000, 5001, None)} == {0}
    none = toxicity.scored(table, marks.limit(0)).collect()
    assert {r.score for r in none} == {0.0} and len(none) == len(docs)


def test_rare_and_short_toxic_words_are_not_pushed_out(spark):
    rng = random.Random(12)
    usual = [f"word{i}" for i in range(60)]
    bad = ["zx", "zxvile", "zxfoul", "qqwretch", "qqs"]
    rows = []
    for i in range(600):
        words = [rng.choice(usual) for _ in range(40)]
        for w in bad if i % 5 == 0 else []:
            words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    learned = model.toxic.removeprefix(model.ordinary)
    assert all(b" " + w.encode() in learned for w in bad)


def test_samples_of_few_words_are_all_learned():
    rng = random.Random(3)
    usual = [f" chlla{i:03d} ".encode() for i in range(120)]
    bad = [b" idiot ", b" moron ", b" scum ", b" worthless "]
    samples = sorted([w for w in usual for _ in range(60)] + [rng.choice(bad) for _ in range(4000)])
    learned = toxicity.trained(samples, toxicity.TOXIC_BYTES)
    assert all(w in learned for w in usual + bad)


def test_frequent_samples_are_learned_where_not_all_have_room():
    rng = random.Random(4)
    rare = [f" w{rng.randrange(10**9)} ".encode() for _ in range(9000)]
    bad = [b" idiot ", b" moron ", b" scum ", b" worthless "]
    learned = toxicity.trained(sorted(rare + [rng.choice(bad) for _ in range(4000)]), toxicity.TOXIC_BYTES)
    assert len(learned) <= toxicity.TOXIC_BYTES and all(w.strip() in learned for w in bad)
