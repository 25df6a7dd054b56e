"""Benchmark passages against windows by brute force."""

import random
from collections import Counter

from factloom.llm import decontaminate


def grams(words):
    k = min(5, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter()


def brute(docs, items):
    found = set()
    for doc_id, text in docs:
        words = (text or "").lower().split()
        for item_id, item in items:
            own = (item or "").lower().split()
            want, k = grams(own), min(5, len(own))
            for start in range(max(0, len(words) - len(own)) + 1) if own else ():
                window = words[start : start + len(own)]
                if len(window) < k:
                    continue
                have = Counter(tuple(window[i : i + k]) for i in range(len(window) - k + 1))
                if 100 * (have & want).total() >= 80 * (have | want).total():
                    found.add((doc_id, item_id))
    return found


def test_same_hits_as_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "ß"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(rng.randrange(8, 60)))) for i in range(30)] + [(90, "two Words"), (91, None), (92, ""), (93, "a a a a a a a a a a")]
    items.append((94, items[0][1]))
    docs = [(1, None), (2, ""), (3, "two words"), (4, "a " * 30), (None, items[1][1])]
    for k in range(150):
        passage = items[rng.randrange(30)][1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            at = rng.randrange(len(passage))
            passage[at : at + rng.choice([0, 1, 1, 1])] = [rng.choice(vocabulary)]
        docs.append((10 + k, " ".join(some(rng.choice([0, 3, 40])) + passage + some(rng.choice([0, 5, 30])))))
    docs += [(10, docs[5][1]), (10, docs[5][1])]
    table = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    got = decontaminate.contaminated(table, bench)
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert found == brute(docs, items)
    left = decontaminate.without_contaminated(table, bench)
    assert left.columns == table.columns
    bad = {d for d, _ in found}
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, _ in docs if d not in bad)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contaminated(none, bench).collect() == []
    assert decontaminate.contaminated(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), bench.limit(0)).collect() == []


def test_passages_in_another_order_inside_long_texts(spark):
    rng = random.Random(11)
    fresh = iter(f"u{i}" for i in range(100_000))
    some = lambda n: [next(fresh) for _ in range(n)]
    items, docs = [], []
    for size in (20, 45, 60, 90):
        words = some(size)
        items.append((size, " ".join(words)))
        for cut in (2, size // 6, size // 3, size // 2, size - 3):
            docs.append((1000 * size + cut, " ".join(some(80) + words[cut:] + words[:cut] + some(80))))
        a, b = size // 3, 2 * size // 3
        docs.append((1000 * size + 500, " ".join(some(80) + words[b:] + words[a:b] + words[:a] + some(rng.randrange(40)))))
        docs.append((1000 * size + 501, " ".join(words[size // 2 :] + words[: size // 2])))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table, bench).collect()}
    assert found == brute(docs, items) and (60_030, 60) in found and (60_010, 60) in found


def test_changes_at_both_ends_and_insertions(spark):
    rng = random.Random(21)
    fresh = iter(f"v{i}" for i in range(1_000_000))
    some = lambda n: [next(fresh) for _ in range(n)]
    words = some(70)
    items, docs = [(1, " ".join(words))], [(1, " ".join(some(30) + ["x0"] + words[1:35] + ["y1", "y2", "y3"] + words[35:69] + ["z"] + some(30)))]
    for k in range(2, 60):
        own = some(rng.randrange(12, 90))
        items.append((k, " ".join(own)))
        edited = list(own)
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(edited))
            edited[at:at] = some(rng.randrange(1, 4))
        if k % 2:
            edited[0], edited[-1] = "first", "last"
        docs.append((k, " ".join(some(rng.randrange(40)) + edited + some(rng.randrange(40)))))
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table, bench).collect()}
    assert found == brute(docs, items) and (1, 1) in found and len(found) > 10


def test_long_and_repetitive_texts(spark):
    items = [(1, "the cat sat " * 12), (2, " ".join(f"q{i}" for i in range(50)))]
    docs = [(1, "the cat sat " * 3_000), (2, " ".join(f"r{i}" for i in range(60_000)) + " " + items[1][1]), (3, "a" * 200_000)]
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(1, 1), (2, 2)}
