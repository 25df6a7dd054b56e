"""The group join against all pairs by brute force."""

import random
import re

import pytest

from factloom.llm import jaccard_groups

SCHEMA = "doc_id long, text string, extra int"


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t, _ in rows]
    near = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])] for i in range(len(rows))]
    out = []
    for i, row in enumerate(rows):
        reached, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in reached:
                    reached.add(j)
                    todo.append(j)
        out.append((row[0], len(sets[i]), min(rows[j][0] for j in reached), len(near[i])))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "Été", "ß"]
    texts = [None, "", "  \n", "one", "One", "two words", "a b c", "A B  C"]
    for size in (10, 11, 12, 25, 60, 150, 300):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for edits in (0, 0, 1, 1, 1, 2, 3, 5, 8):
            words = list(base)
            for _ in range(edits):
                at = rng.randrange(len(words))
                words[at : at + rng.choice([0, 1])] = [rng.choice(vocabulary)]
            texts.append(" ".join(words))
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(30)) + " " + passage for _ in range(40)]
    base = [rng.choice(vocabulary) for _ in range(100)]
    for _ in range(250):  # a class larger than a group of the matrix
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(100)] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    rng.shuffle(texts)
    return [(1000 + 7 * i, t, i) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_same_classes_and_links_as_brute_force(spark, width, percent):
    rows = corpus(width)
    found = jaccard_groups.jaccard_classes(spark.createDataFrame(rows, SCHEMA).repartition(5), width, percent)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in found.collect())
    assert got == brute(rows, width, percent)


def test_one_of_each_class_stays(spark):
    rows = [(1, "a b c d e f", 1), (2, "A b c d e f", 2), (2, "A b c d e f", 2), (3, None, 3), (4, "", 4), (5, "z", 5), (5, "z", 5), (None, "q r", 6)]
    kept = jaccard_groups.keep_first(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "extra"]
    assert sorted(((r.doc_id or -1, r.text or "") for r in kept.collect())) == [(-1, "q r"), (1, "a b c d e f"), (3, ""), (4, ""), (5, "z")]


def test_no_rows(spark):
    assert jaccard_groups.jaccard_classes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_classes_alone_are_those_of_all_links(spark):
    rows = corpus(11)
    found = jaccard_groups.jaccard_classes(spark.createDataFrame(rows, SCHEMA).repartition(3), 5, 80, count_links=False)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == [r[:3] for r in brute(rows, 5, 80)]


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_similar_sets_share_more_keys_than_they_may_do_without(percent):
    rng, keys = random.Random(percent), jaccard_groups.Keys(percent)
    for _ in range(3000):
        union = rng.choice([3, 4, 5, 6, 9, 10, 15, 20, 40, 100, 150, 400])
        other = rng.randrange(union - -(-union * percent // 100) + 1)
        tokens = jaccard_groups.mixed(jaccard_groups.np.array([rng.getrandbits(64) for _ in range(union)], jaccard_groups.np.uint64))
        jaccard_groups.np.random.default_rng(rng.getrandbits(32)).shuffle(tokens)
        cut = rng.randrange(other + 1)
        a, b = jaccard_groups.np.sort(tokens[cut:]), jaccard_groups.np.sort(jaccard_groups.np.concatenate([tokens[:cut], tokens[other:]]))
        (of_a, room_a), (of_b, room_b) = keys.of(a), keys.of(b)
        assert len(a) == len(b) == union == 0 or len(jaccard_groups.np.intersect1d(of_a, of_b)) > max(room_a, room_b)


def passages(seed, pages):
    """Pages of one passage and words of their own, in shares about the limit, some with near copies; short and long."""
    rng = random.Random(seed)
    texts = []
    for size, many in ((60, pages), (900, pages // 5)):
        passage = [f"p{size}x{i}" for i in range(size)]
        for i in range(many):
            own = [f"o{rng.getrandbits(40):x}" for _ in range(rng.choice([2, size // 10, size // 7, size // 5, size // 2, size]))]
            texts.append(" ".join(passage + own))
            if i % 9 == 0:
                texts.append(" ".join([*passage, *own[:-1], "another"]))
    rng.shuffle(texts)
    return [(5 + 3 * i, t, i) for i, t in enumerate(texts)]


@pytest.mark.parametrize("wide", [1, 8])
def test_classes_of_pages_about_a_common_passage(spark, monkeypatch, wide):
    monkeypatch.setattr(jaccard_groups, "WIDE", wide)
    rows = passages(3, 150)
    found = jaccard_groups.jaccard_classes(spark.createDataFrame(rows, SCHEMA).repartition(3), 5, 80, count_links=False)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == [r[:3] for r in brute(rows, 5, 80)]


def test_unrelated_pages_take_no_questions_for_a_common_passage(spark):
    rng = random.Random(4)
    sets = [(i, sorted({*range(100), *(rng.getrandbits(60) + 1000 for _ in range(60))})) for i in range(400)]
    forms = [(i, len(t), f.tobytes()) for i, t in sets for f in jaccard_groups.short_forms(jaccard_groups.np.array(t, jaccard_groups.np.uint64), 80)]
    classed = [(i, i, True) for i, _ in sets]
    rare = jaccard_groups.rare_tokens(spark.createDataFrame(forms, "set_hash long, size long, tokens binary"), spark.createDataFrame(classed, "set_hash long, root long, asking boolean"), 80)
    assert rare.count() == 0


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_rare_tokens_meet_all_similar_sets_of_other_classes(spark, percent):
    rng = random.Random(percent)
    sets, base = {}, [rng.getrandbits(64) for _ in range(2400)]
    for i in range(150):
        kept = base[: rng.choice([4, 12, 90, 740, 900, 1600, 2400])]
        lost = rng.randrange(len(kept) * (100 - percent) // 100 + 1)
        tokens = set(kept[lost:]) | {rng.getrandbits(64) for _ in range(rng.randrange(lost + 1))}
        sets[i] = jaccard_groups.np.array(sorted(tokens), jaccard_groups.np.uint64)
    forms = [(i, len(t), f.tobytes()) for i, t in sets.items() for f in jaccard_groups.short_forms(t, percent)]
    looks = {i: i % 3 == 0 for i in sets}
    rare = jaccard_groups.rare_tokens(spark.createDataFrame(forms, "set_hash long, size long, tokens binary"), spark.createDataFrame([(i, i // 2, looks[i]) for i in sets], "set_hash long, root long, asking boolean"), percent)
    of = {}
    for r in rare.collect():
        of.setdefault(r.set_hash, set()).add(r.token)
    whole = {i: set(t.tolist()) for i, t in sets.items()}
    similar = [(a, b) for a in sets for b in sets if looks[a] and a // 2 != b // 2 and 100 * len(whole[a] & whole[b]) >= percent * len(whole[a] | whole[b])]
    assert len(similar) > 50
    assert all(of.get(a, set()) & of.get(b, set()) for a, b in similar)
