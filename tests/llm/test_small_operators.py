"""Token files, packing, rules, shards, piece counts and the classifier on small tables."""

import math
import random
import zlib

import pyarrow as pa
import pytest

from factloom.llm import balanced_shards, common, ngram_quality, packing, piece_counts, quality_rules, token_store
from factloom.llm.encoding import IdEncoder, default_vocabulary

SCHEMA = "doc_id long, text string, size string"
TEXTS = [None, "", " ", "a", "It's\n\nfine  now. ", "é" * 30, "x\n y", "\x1c z", "<|endoftext|> end", "in<|endoftext|>side<|endoftext|><|endoftext|>", "word " * 3000, "# $ % | a\na\na\nb b b b"]


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


def ids_of(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


def raw(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def rows():
    return [(i, t, "s") for i, t in enumerate(TEXTS)] + [(2, " ", "s"), (None, "no id", "s"), (3, "b", "s")]


def test_encoder_equals_the_library():
    rng, e = random.Random(1), IdEncoder(default_vocabulary(), limit=50)
    marks = [" ", "  ", "\n", "\n ", "\t", ". ", "'s ", " ", "\x85 ", "12", "é", "Ä", "日本", "a", "bc", "THE", "!", ",", "\x1c ", " \n", "<|endoftext|>", "<|endof"]
    for _ in range(400):
        text = "".join(rng.choice(marks) for _ in range(rng.randrange(14)))
        assert e.one(text) == raw(tokenizer().encode(text, add_special_tokens=False).ids), repr(text)


def test_small_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_store, "FILE_BYTES", 300)
    rng = random.Random(2)
    text = " ".join(str(rng.random()) for _ in range(6_000))
    table = spark.createDataFrame([(i, text, "s") for i in range(12)], SCHEMA).repartition(2)
    folder = common.new_folder(spark, "tokens")
    manifest = token_store.write_tokens(table, folder, default_vocabulary())
    assert manifest.count() > 8
    n = len(ids_of(text)) + 1
    got = sorted((r.doc_id, r.start, r.n_tokens) for r in token_store.token_digest(table, default_vocabulary(), common.new_folder(spark, "t")).collect())
    assert got == [(i, i * n, n) for i in range(12)]


def test_no_documents(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert token_store.token_digest(table, default_vocabulary(), common.new_folder(spark, "t")).collect() == []
    assert packing.pack_documents(table, default_vocabulary()).collect() == []
    assert quality_rules.judged(table).collect() == []
    assert piece_counts.piece_counts(table, default_vocabulary()).collect() == []


def test_pieces_hold_the_ids_of_their_documents(spark):
    rng = random.Random(8)
    texts = {i: " ".join(rng.choice(["ab", "cde", "<|endoftext|>", "f. g"]) for _ in range(rng.randrange(0, 90))) for i in range(60)}
    got = {}
    for r in packing.pack_documents(spark.createDataFrame([(i, t, "s") for i, t in texts.items()], SCHEMA), default_vocabulary(), capacity=40).collect():
        got.setdefault(r.doc_id, []).append(r)
    filled = {}
    for i, t in texts.items():
        ids = [*ids_of(t), 0]
        pieces = sorted(got[i], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces))) and pieces[-1].start + pieces[-1].length == len(ids)
        for p, nxt in zip(pieces, [*pieces[1:], None], strict=True):
            assert p.ids_crc32 == zlib.crc32(raw(ids[p.start : p.start + p.length])) and (nxt is None or nxt.start == p.start + p.length)
            filled.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert pieces[0].start == 0 and all(p.length == 40 for p in pieces[1:])
    for parts in filled.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:k]) for k, (o, _) in enumerate(parts)) and sum(n for _, n in parts) <= 40


def test_token_files_round_trip(spark):
    table = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    folder = common.new_folder(spark, "tokens")
    manifest = token_store.write_tokens(table, folder, default_vocabulary())
    back = {}
    for r in token_store.read_tokens(manifest, folder).collect():
        back.setdefault(r.doc_id, []).append(bytes(r.ids))
    want = {}
    for i, t, _ in rows():
        want.setdefault(i, []).append(raw([*ids_of(t), 2]))
    assert {k: sorted(v) for k, v in back.items()} == {k: sorted(v) for k, v in want.items()}
    file = manifest.orderBy("part").first()["file"]
    assert token_store.read_document("file://" + file, 4) in ([], [raw([*ids_of(TEXTS[4]), 2])])
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in token_store.token_digest(table, default_vocabulary(), common.new_folder(spark, "t")).collect())
    start, expected = 0, []
    for i, t, _ in sorted(rows(), key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        ids = [*ids_of(t), 2]
        expected.append((-1 if i is None else i, start, len(ids), zlib.crc32(raw(ids))))
        start += len(ids)
    assert sorted(expected) == got


def test_one_document_costs_one_frame_and_damage_is_seen():
    sink = pa.BufferOutputStream()
    writer = token_store.Writer(sink, 2, frame_bytes=64)
    for i in range(50):
        writer.add(i, raw(range(i, i + 20)))
    writer.close()
    data = sink.getvalue().to_pybytes()
    reader = token_store.Reader(pa.BufferReader(data))
    opened, frame = [], reader.frame
    reader.frame = lambda k: opened.append(k) or frame(k)
    assert reader.read(37) == raw(range(37, 57)) and len(opened) == 1 and len(reader.table) > 10
    broken = bytearray(data)
    broken[int(reader.places[3]) + reader.table[3][0] - 3] ^= 1
    bad = token_store.Reader(pa.BufferReader(bytes(broken)))
    with pytest.raises(Exception):
        bad.frame(3)


def test_packing_places_every_piece(spark):
    table = spark.createDataFrame([*rows(), *[(100 + i, "some words here " * (i % 90), "s") for i in range(400)]], SCHEMA)
    got = packing.pack_documents(table, default_vocabulary(), capacity=256).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault((r.doc_id, r.row_hash), []).append((r.piece, r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(len(ids_of(t)) + 1 for _, t, _ in [*rows(), *[(0, "some words here " * (i % 90), "") for i in range(400)]])
    assert sum(r.length for r in got) == total
    assert len(by_sequence) <= 1.02 * total / 256 + 2
    long = sorted(by_doc[9, next(h for d, h in by_doc if d == 9)])
    assert [p for p, _, _ in long] == list(range(len(long))) and all(n == 256 for _, _, n in long[1:])


def test_patterns_use_up_any_histogram():
    rng = random.Random(2)
    for _ in range(30):
        histogram = {rng.randrange(1, 129): rng.randrange(1, 500) for _ in range(rng.randrange(1, 60))}
        used = {}
        for lengths, times in packing.plan_patterns(histogram, 128, classes=16):
            assert sum(lengths) <= 128 and times > 0
            for x in lengths:
                used[x] = used.get(x, 0) + times
        assert used == histogram
    assert packing.plan_patterns({}, 128) == []


def test_rules_count_as_told(spark):
    got = {r.doc_id: r for r in quality_rules.judged(spark.createDataFrame([(1, "# $ % | a\na\na\n \n \nb b b b", "s"), (2, None, "s"), (3, "x y z x y z x", "s"), (4, "a a a", "s")], SCHEMA)).collect()}
    one = got[1]
    assert (one.n_words, one.word_chars, one.n_symbols, one.n_dup_lines, one.n_repeat_words, one.base_failed, one.kept, one.size) == (11, 11, 4, 1, 4, True, False, "s")
    assert (got[2].n_words, got[2].n_repeat_words, got[2].base_failed) == (0, 0, True)
    assert got[3].n_repeat_words == 7 and got[4].n_repeat_words == 0


def test_shards_differ_by_one_and_keep_groups(spark):
    texts = [f"t{i}" for i in range(300)] + [f"g{i // 5}" for i in range(200)] + ["hot"] * 150 + [None, ""]
    table = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], SCHEMA)
    got = balanced_shards.shard_documents(table).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    counts = [sum(r.shard == i for r in got) for i in range(8)]
    assert max(counts) - min(counts) <= 1
    for i in range(8):
        assert sorted(r.slot for r in got if r.shard == i) == list(range(counts[i]))
    groups = {}
    for r in got:
        if (texts[r.doc_id] or "").startswith("g"):
            groups.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(s) == 1 for s in groups.values()) >= 30
    assert balanced_shards.shard_documents(table.limit(0)).collect() == []


def test_piece_counts_equal_greedy_matching(spark):
    begin, rest = [b"a", b"ab", b"abcd", b"x"], [b"b", b"c", b"cd", b"bcx", b"d", b"x"]
    counter = piece_counts.PieceCounter(begin, rest)

    def greedy(word):
        at, n, pieces = 0, 0, begin
        while at < len(word):
            best = max((len(p) for p in pieces if word.startswith(p, at)), default=0)
            if not best:
                return 0
            at, n, pieces = at + best, n + 1, rest
        return n

    rng = random.Random(3)
    for _ in range(3000):
        word = bytes(rng.choice(b"abcdx") for _ in range(rng.randrange(1, 12)))
        assert counter.count(word) == greedy(word), word
    got = {r.doc_id: (r.n_words, r.n_pieces, r.n_unknown) for r in piece_counts.piece_counts(spark.createDataFrame([(1, None, ""), (2, "the the  house", ""), (3, "", "")], SCHEMA), default_vocabulary()).collect()}
    assert got[1] == got[3] == (0, 0, 0) and got[2][0] == 3 and got[2][1] >= 3 and got[2][2] == 0


def test_classifier_keeps_good_text_and_rejects_noise(spark):
    rng = random.Random(4)
    words = ["the", "house", "stands", "near", "a", "river", "and", "people", "walk", "there"]
    good = [(i, " ".join(rng.choice(words) for _ in range(60)), "en") for i in range(200)]
    bad = [(1000 + i, " ".join("".join(chr(rng.randrange(33, 127)) for _ in range(7)) for _ in range(60)), "en") for i in range(20)]
    odd = [(2000, None, "en"), (2001, "", None), (2002, "the house", None), (2003, good[0][1], "xx")]
    table = spark.createDataFrame([*good, *bad, *odd], "doc_id long, text string, lang string")
    ids = spark.createDataFrame([(i,) for i in range(0, 200, 2)], "doc_id long")
    kept = {r.doc_id: r._kept for r in ngram_quality.judged(table, ids).collect()}
    assert all(kept[i] for i, _, _ in [*good, *odd]) and not any(kept[i] for i, _, _ in bad)
    assert all(r._kept for r in ngram_quality.judged(table, ids.limit(0)).collect())
    model = ngram_quality.train(table.filter("doc_id < 200").select("text"))
    told = {r["code"]: r for r in model.collect()}
    code = lambda *gram: (len(gram) << ngram_quality.BITS) + int.from_bytes(bytes(gram), "big")

    def p(*gram):
        row = told.get(code(*gram))
        if row and row["log_p"] is not None:
            return math.exp(row["log_p"])
        return math.exp(told[code(*gram[:-1])]["left"]) * (p(*gram[1:]) if len(gram) > 1 else 1 / 256)

    assert abs(sum(p(x) for x in range(256)) - 1) < 1e-6 and abs(sum(p(ord("h"), x) for x in range(256)) - 1) < 1e-6
