"""Operator 8: exact Jaccard join of word n-gram sets through a token-group matrix.

1. Every whole text gives its set of shingles (64-bit hashes, which also order it). Equal sets are one set from here on.
2. Keys say which sets can be similar at all: a key is made of RUN tokens that follow each other in a set's order. In
   the union of two similar sets few tokens are in one of them only, so that runs of shared tokens remain, and those
   are runs of both sets. Up to `Keys.most` tokens a set gives all its runs, and some shared one is certain. Of a larger
   set the runs among its `most` smallest hashes do: as hashes are random, two similar sets have no more than `room` of
   them in common with a chance under 10^-15, less than that of two shingles with one 64-bit hash. Keys of many sets say
   little; a set with no more than `room` of them does without.
3. Sets that share keys are partitioned into groups of similar sets, about `GROUP` each; a large class becomes several
   groups by hash, so that no group grows with the data.
4. The token-group matrix holds for each group its sets and the union of their tokens. Sets are compared within their
   group, and ask other groups with which they share keys. A query set whose overlap with a group's union is under the
   threshold's share of its own size can match none of its sets. That is bounded first on samples of both (of tokens,
   not of documents: what a sample lacks is lacking for certain), so that whole sets are fetched for what passes only;
   then on the whole, and only for the sets that pass is the group opened and similarity computed exactly.
5. To know the classes, the sets of a key first ask the group of its smallest set, so that a class of n near copies takes
   about n questions. Sets that then are in another class than most sets of a key ask its other groups, if they are few
   (`WIDE`); else those groups with which they share one of their rarest tokens (`rare_tokens`, exact), so that n
   unrelated texts with a common passage take no questions for it. To count links, all groups that share a key meet, which is n x n / 2 comparisons for such a class.
6. A comparison returns how many links each set has, and links enough to connect what is linked, instead of all
   pairs. Components come from joins over those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

#: Sets in a group of the matrix, about.
GROUP = 96
#: Tokens in a key; keys that a set may do without; the chance at which a link may be lost.
RUN, ROOM, CHANCE = 3, 4, 1e-15
#: A key of more sets than this is common.
COMMON = 32
#: With the sets of more groups than this a set does not meet by a key alone.
WIDE = 8
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
MIX_1, MIX_2, MIX_3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * MIX_2
    x = (x ^ (x >> np.uint64(27))) * MIX_3
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of whole texts; keeps hashes of words it has met, up to `limit`."""

    def __init__(self, width: int, limit: int = 150_000):
        self.width, self.limit = width, limit
        self.kept: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        found = list(map(self.kept.get, words))
        if None in found:
            if len(self.kept) > self.limit:
                self.kept.clear()
            for i, h in enumerate(found):
                if h is None:
                    found[i] = self.kept[words[i]] = xxhash.xxh64_intdigest(words[i])
        return np.array(found, np.uint64)

    def shingles(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
        if not words:
            return np.empty(0, np.uint64)
        h = self.hashes(words)
        n = max(1, len(h) - self.width + 1)
        out = np.full(n, min(len(h), self.width), np.uint64)
        for i in range(min(len(h), self.width)):
            out = out * MIX_1 + h[i : i + n]
        return np.unique(mixed(out))


class Keys:
    """Keys of sets: sets with 100 x intersection >= percent x union share more than they may do without."""

    def __init__(self, percent: int):
        self.percent = percent
        # with fewer than three shared tokens to each other one, long runs are not certain
        self.run = RUN if percent >= 75 else 1
        self.most = self._most()
        # sizes of unions in which differing tokens can break all runs
        self.broken = max((u for u in range(1, 12 * self.run) if self._other(u) and self._certain(u) < 1), default=0)

    def _other(self, union: int) -> int:
        """Tokens of a union of this size that may be in one set only."""
        return union - -(-union * self.percent // 100)

    def _certain(self, union: int) -> int:
        """Shared runs that such a union has at least."""
        return union - self._other(union) - (self.run - 1) * (self._other(union) + 1)

    def _most(self) -> int:
        """So many tokens that, each shared with the chance `percent`, they hold ROOM runs or fewer with CHANCE at most."""
        p = self.percent / 100
        state = np.zeros((self.run + 1, ROOM + 2))  # by length of the run at the end, and by runs so far
        state[0, 0] = 1
        for m in range(1, 100_000):
            after = np.zeros_like(state)
            after[0] = (1 - p) * state.sum(0)
            for k in range(self.run + 1):
                if k < self.run - 1:
                    after[k + 1] += p * state[k]
                else:
                    after[self.run, 1:] += p * state[k, :-1]
                    after[self.run, -1] += p * state[k, -1]
            state = after
            if state[:, :-1].sum() < CHANCE:
                return m
        raise ValueError("the threshold is too low for keys")

    def of(self, tokens: np.ndarray) -> tuple[np.ndarray, int]:
        """Keys of a sorted set, and how many it may do without."""
        n, few = len(tokens), tokens[: self.most]
        keys = np.zeros(max(0, len(few) - self.run + 1), np.uint64)
        for i in range(self.run if len(keys) else 0):
            keys = mixed(keys * MIX_1 + few[i : i + len(keys)])
        if n <= self.broken and self.run > 1:
            keys = np.concatenate([keys, mixed(few + MIX_3)])
            return keys, 0
        if 100 * n > self.percent * self.most:
            return keys, ROOM
        certain = min(self._certain(u) for u in range(n, 100 * n // self.percent + 1))
        return keys, max(0, min(ROOM, certain - 1))


def set_hash(tokens: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(tokens.tobytes())).astype(np.int64))


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text")


def describe_sets(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, row_hash, set_hash, n (size of the set), keys (null for an empty set and for a set that the same task
    has met before), room (as Keys.of says)."""
    common.ship(documents.sparkSession)
    names = ["doc_id", "row_hash", "set_hash", "n", "keys", "room"]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, maker, met = Shingler(width), Keys(percent), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                hashes, sizes, keys, rooms = [], [], [], []
                for text in part.column(2):
                    tokens = shingler.shingles(text.as_py())
                    h = set_hash(tokens)
                    found, room = (None, 0) if h in met or not len(tokens) else maker.of(tokens)
                    met.add(h)
                    hashes.append(h)
                    sizes.append(len(tokens))
                    keys.append(None if found is None else found.view(np.int64))
                    rooms.append(room)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(rooms, pa.int32())], names)

    return _keyed(documents).mapInArrow(common.lean(describe), "doc_id long, row_hash long, set_hash long, n long, keys array<long>, room int")


def sampled(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Short forms (32 bits) of the tokens whose hash falls in a fixed share of the space, wide enough that a set
    with nothing in common with a group is known not to belong there by these alone."""
    share = min(1.0, 2 * (100 - percent) / 100)
    upto = len(tokens) if share >= 1 else int(np.searchsorted(tokens, np.uint64(int(share * 2.0**63) * 2)))
    return np.unique((tokens[:upto] & np.uint64(0xFFFFFFFF)).astype(np.uint32))


def whole_tokens(tokens: np.ndarray) -> list[np.ndarray]:
    """All tokens of a set, sorted, 64 bits each."""
    return [tokens]


def short_forms(tokens: np.ndarray, percent: int) -> list[np.ndarray]:
    """Short forms for `rare_tokens`: of the sample where it is so large that it holds more than the tokens which a set may
    lack with a chance as CHANCE, and of all tokens for smaller sets. Two similar sets of which one is small have both
    all their tokens here, so sets about that size give both forms, the sample first. A form begins with its kind."""
    large = 15_000 // max(1, 100 - percent)
    forms = [(1, sampled(tokens, percent))] if len(tokens) >= large else []
    if len(tokens) * percent < large * 100:
        forms.append((0, np.unique((tokens & np.uint64(0xFFFFFFFF)).astype(np.uint32))))
    return [np.concatenate([np.array([kind], np.uint32), form]) for kind, form in forms]


def fetch(documents: DataFrame, wanted: DataFrame, width: int, forms: Callable[[np.ndarray], list[np.ndarray]]) -> DataFrame:
    """set_hash, size, tokens of the documents in wanted(doc_id, row_hash), a row for each of the forms of a set, each set
    once a task."""
    keyed, few = _keyed(documents), common.broadcast_if_small(wanted.select("doc_id", "row_hash"))
    chosen = keyed.join(few, keyed["doc_id"].eqNullSafe(few["doc_id"]) & (keyed["row_hash"] == few["row_hash"]), "left_semi").select("text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, met = Shingler(width), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = []
                for text in batch.slice(at, 512).column(0):
                    tokens = shingler.shingles(text.as_py())
                    if (h := set_hash(tokens)) not in met:
                        met.add(h)
                        rows.extend((h, len(tokens), form.tobytes()) for form in forms(tokens))
                kinds = pa.int64(), pa.int64(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(3)], ["set_hash", "size", "tokens"])

    return chosen.mapInArrow(common.lean(read), "set_hash long, size long, tokens binary")


def sample_matrix(samples: DataFrame, percent: int) -> DataFrame:
    """The matrix of the samples alone, of samples(gid, set_hash, size, tokens): gid, union_sample, alive (the sets that
    may be similar to another set of the group: neither's sample lacks too much of the other's)."""
    held = samples.groupBy("gid").agg(F.collect_list(F.struct("set_hash", "size", "tokens")).alias("rows"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gid, rows in zip(batch.column(0), batch.column(1), strict=True):
                own = {r["set_hash"]: r for r in rows.as_py()}
                sets = sorted(own)
                parts = [np.frombuffer(own[s]["tokens"], np.uint32) for s in sets]
                sizes = np.array([own[s]["size"] for s in sets])
                union = np.unique(np.concatenate(parts))
                places = np.concatenate([np.searchsorted(union, p) for p in parts])
                lengths = np.array([len(p) for p in parts])
                owner = np.repeat(np.arange(len(sets)), lengths)
                alive = []
                for i, p in enumerate(parts if len(sets) > 1 else []):
                    mark = np.zeros(len(union), bool)
                    mark[np.searchsorted(union, p)] = True
                    both = np.bincount(owner, mark[places], minlength=len(sets))
                    possible = (100 * (sizes[i] - (lengths[i] - both)) >= percent * sizes[i]) & (100 * (sizes - (lengths - both)) >= percent * sizes)
                    possible[i] = False
                    if possible.any():
                        alive.append(sets[i])
                yield pa.RecordBatch.from_arrays([pa.array([gid.as_py()], pa.int64()), pa.array([union.tobytes()], pa.binary()), pa.array([alive], pa.list_(pa.int64()))], ["gid", "union_sample", "alive"])

    return held.select("gid", "rows").mapInArrow(common.lean(unite), "gid long, union_sample binary, alive array<long>")


def matrix(tokens: DataFrame) -> DataFrame:
    """The token-group matrix of tokens(gid, set_hash, copies, tokens): gid, sets, copies, tokens (one array of bytes
    a set), token_union (sorted)."""
    held = tokens.groupBy("gid").agg(F.collect_list(F.struct("set_hash", "copies", "tokens")).alias("rows"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gid, rows in zip(batch.column(0), batch.column(1), strict=True):
                own = {r["set_hash"]: r for r in rows.as_py()}  # a set may come from several tasks
                sets = sorted(own)
                union = np.unique(np.concatenate([np.frombuffer(own[s]["tokens"], np.uint64) for s in sets]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([gid.as_py()], pa.int64()), pa.array([sets], pa.list_(pa.int64())), pa.array([[own[s]["copies"] for s in sets]], pa.list_(pa.int64())), pa.array([[own[s]["tokens"] for s in sets]], pa.list_(pa.binary())), pa.array([union.tobytes()], pa.binary())],
                    ["gid", "sets", "copies", "tokens", "token_union"],
                )

    return held.select("gid", "rows").mapInArrow(common.lean(unite), "gid long, sets array<long>, copies array<long>, tokens array<binary>, token_union binary")


def compare(queries: dict, group: dict | None, percent: int) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """Links that connect, and the number of links of each set, between query sets and the sets of a group, or (group
    None) within the queries' own group."""
    other = queries if group is None else group
    union = np.frombuffer(other["token_union"], np.uint64)
    members = [np.frombuffer(t, np.uint64) for t in other["tokens"]]
    sizes = np.array([len(m) for m in members])
    places = np.concatenate([np.searchsorted(union, m) for m in members])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links, counts = [], {}
    for i, (own, copies, raw) in enumerate(zip(queries["sets"], queries["copies"], queries["tokens"], strict=True)):
        q = np.frombuffer(raw, np.uint64)
        at = np.minimum(np.searchsorted(union, q), len(union) - 1)
        shared = at[union[at] == q]
        if 100 * len(shared) < percent * len(q):
            continue  # no set of this group can be similar enough
        mark = np.zeros(len(union), np.int64)
        mark[shared] = 1
        both = np.add.reduceat(mark[places], starts)
        for j in np.flatnonzero(100 * both >= percent * (len(q) + sizes - both)):
            if group is None and j <= i:
                continue
            to = other["sets"][j]
            counts[own] = counts.get(own, 0) + other["copies"][j]
            counts[to] = counts.get(to, 0) + copies
            if root(own) != root(to):
                parent[root(own)] = root(to)
                links.append((own, to))
    return links, counts


FOUND = "a long, b long, links long"


def _found(links: list[tuple[int, int]], counts: dict[int, int]) -> list[pa.Array]:
    rows = [(a, b, 0) for a, b in links] + [(a, None, n) for a, n in counts.items()]
    return [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]


def compare_within(groups: DataFrame, percent: int) -> DataFrame:
    """a, b, links: rows with b are links that connect, rows without b say how many links a has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                yield pa.RecordBatch.from_arrays(_found(*compare(own, None, percent)), ["a", "b", "links"])

    return groups.select("sets", "copies", "tokens", "token_union").mapInArrow(common.lean(run), FOUND)


def _meet(asked: DataFrame, sets: DataFrame, groups: DataFrame, function, schema: str) -> DataFrame:
    """function(queries, group) on all queries of a group, of the saved table asked(set_hash, gid) with what
    sets(set_hash, ...) says of them; where a group has many, they come in several parts, and the group with each."""
    parts = asked.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / 2_000).cast("int").alias("parts"))
    parts = common.broadcast_if_small(common.saved(parts, "parts-of-questions"))
    dealt = asked.join(parts, "gid").select("set_hash", "gid", F.pmod(F.xxhash64("set_hash"), "parts").cast("int").alias("part"))
    left = dealt.join(sets, "set_hash")
    right = groups.join(parts, "gid").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return left.groupBy("gid", "part").cogroup(right.groupBy("gid", "part")).applyInArrow(function, schema)


def qualify(asked: DataFrame, samples: DataFrame, unions: DataFrame, percent: int) -> DataFrame:
    """Of asked(set_hash, gid), those whose overlap with the group's union may reach the threshold's share of the set,
    by the samples: tokens that are in the set's and not in the union's are missing for certain."""

    def bound(queries: pa.Table, group: pa.Table) -> pa.Table:
        union = np.frombuffer(group.column("union_sample")[0].as_py(), np.uint32) if group.num_rows else np.empty(0, np.uint32)
        open_to = []
        for size, raw in zip(queries.column("size").to_pylist(), queries.column("tokens").to_pylist(), strict=True):
            missing = int(np.isin(np.frombuffer(raw, np.uint32), union, assume_unique=True, invert=True).sum())
            open_to.append(100 * (size - missing) >= percent * size)
        return queries.select(["set_hash", "gid"]).filter(pa.array(open_to, pa.bool_()))

    return _meet(asked, samples.select("set_hash", "size", "tokens"), unions.select("gid", "union_sample"), bound, "set_hash long, gid long")


def compare_between(asked: DataFrame, tokens: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Groups opened to the query sets in asked(set_hash, gid); result as compare_within."""

    def run(queries: pa.Table, group: pa.Table) -> pa.Table:
        sets = {"sets": queries.column("set_hash").to_pylist(), "copies": queries.column("copies").to_pylist(), "tokens": queries.column("tokens").to_pylist()}
        opened = {name: group.column(name)[0].as_py() for name in ("sets", "copies", "tokens", "token_union")}
        return pa.Table.from_arrays(_found(*compare(sets, opened, percent)), ["a", "b", "links"])

    return _meet(asked, tokens.select("set_hash", "copies", "tokens"), groups.select("gid", "sets", "copies", "tokens", "token_union"), run, FOUND)


def shared_keys(described: DataFrame) -> DataFrame:
    """key, set_hash, low (the smallest set of the key), of the keys that different sets share; common ones are left out
    where a set may do without. Keys are counted by partial sums first, so that a frequent one is no large group."""
    entries = described.filter("keys IS NOT NULL").select(F.explode("keys").alias("key"), "set_hash", "room")
    counted = entries.groupBy("key").agg(F.min("set_hash").alias("low"), F.max("set_hash").alias("high"), F.count(F.lit(1)).alias("sets"))
    several = common.saved(counted.filter("low < high").select("key", "low", (F.col("sets") > COMMON).alias("common")), "keys-of-several")
    alike = common.saved(entries.join(common.broadcast_if_small(several), "key").distinct(), "sets-of-keys")
    often = alike.filter("common").groupBy("set_hash").agg(F.count(F.lit(1)).alias("often"))
    told = alike.join(common.broadcast_if_small(common.saved(often, "common-keys")), "set_hash", "left")
    return told.filter("NOT common OR often > room").select("key", "set_hash", "low").distinct()


def rare_tokens(forms: DataFrame, classed: DataFrame, percent: int) -> DataFrame:
    """set_hash, token, asks: the tokens by which a set meets all similar sets of other classes.

    forms(set_hash, size, tokens) are `short_forms`, classed(set_hash, root, asking) says of which class a set is, and
    whether it looks for others. A set lacks no more than its size x (100 - percent) / 100 tokens of a similar one, so of
    one more than that, first in an order that is the same for all sets, both have one in common. First come tokens that
    lead nowhere (of one class alone, or of sets that do not look), which are left out but counted; then rare before
    frequent ones. asks is the number of sets that look for a token.
    """
    few = common.broadcast_if_small(classed)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [np.frombuffer(t, np.uint32) for t in part.column(2).to_pylist()]
                # a token of another kind is another token
                tokens = pa.array([f[1:].astype(np.int64) + (int(f[0]) << 32) for f in found], pa.list_(pa.int64()))
                # so many tokens of a set count, less those that lead nowhere
                spare = [n * (100 - percent) // 100 + 1 - (len(f) - 1) for n, f in zip(part.column(1).to_pylist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spare, pa.int64()), tokens], ["set_hash", "spare", "tokens"])

    sets = forms.mapInArrow(common.lean(unpack), "set_hash long, spare long, tokens array<long>")
    classes = sets.join(few, "set_hash").select("root", "asking", F.explode("tokens").alias("token"))
    known = classes.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("sets"), F.count_if("asking").alias("asks"))
    known = common.saved(known.filter("low < high AND asks > 0").select("token", "sets", "asks"), "tokens-of-classes")
    leading = sets.select("set_hash", "spare", F.explode("tokens").alias("token")).join(common.broadcast_if_small(known, 200_000), "token")
    own = Window.partitionBy("set_hash", F.shiftright("token", 32))
    ranked = leading.withColumn("nth", F.row_number().over(own.orderBy("sets", "token"))).withColumn("leads", F.count(F.lit(1)).over(own))
    return ranked.filter("nth <= spare + leads").select("set_hash", "token", "asks")


class Questions:
    """Sets asking groups: what is read once for all questions."""

    def __init__(self, documents: DataFrame, described: DataFrame, placed: DataFrame, width: int, percent: int):
        self.documents, self.placed, self.width, self.percent = documents, placed, width, percent
        first = described.join(placed.select("set_hash"), "set_hash", "left_semi").groupBy("set_hash").agg(F.min(F.struct("doc_id", "row_hash")).alias("d"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"))
        self.first = common.saved(first.select("set_hash", "copies", "n", "d.doc_id", "d.row_hash"), "group-documents")
        self.samples = common.saved(fetch(documents, self.first, width, lambda t: [sampled(t, percent)]).join(placed, "set_hash").dropDuplicates(["set_hash"]), "group-samples")
        self.unions = common.saved(sample_matrix(self.samples, percent), "sample-matrix")
        sizes = self.first.join(placed, "set_hash")
        self.sizes = common.saved(sizes.groupBy("gid").agg(F.min("n").alias("least"), F.max("n").alias("most")), "group-sizes")

    def further(self, classed: DataFrame) -> DataFrame:
        """set_hash, gid: the groups of other classes that the sets which ask in classed(set_hash, gid, root, asking) must
        still ask. A token for which many sets ask is dealt into parts, and its groups come to each part."""
        wanted = self.first.join(classed.select("set_hash"), "set_hash", "left_semi")
        percent = self.percent
        forms = fetch(self.documents, wanted, self.width, lambda t: short_forms(t, percent)).dropDuplicates(["set_hash", "tokens"])
        rare = common.saved(rare_tokens(common.saved(forms, "short-forms"), classed.select("set_hash", "root", "asking"), percent), "rare-tokens")
        dealt = rare.join(classed, "set_hash").withColumn("parts", F.ceil(F.col("asks") / 2_000).cast("int"))
        groups = dealt.groupBy("token", "gid").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("parts").alias("parts"))
        groups = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        asking = dealt.filter("asking").select("token", F.pmod(F.xxhash64("set_hash"), "parts").cast("int").alias("part"), "set_hash", F.col("gid").alias("own"), "root")
        meet = asking.join(groups, ["token", "part"]).filter("own <> gid AND (low <> root OR high <> root)")
        return meet.select("set_hash", "gid").distinct()

    def answers(self, asked: DataFrame, within: bool) -> DataFrame:
        """What compare_between finds for asked(set_hash, gid), and (within) what compare_within finds in all groups."""
        few = common.broadcast_if_small(self.sizes)
        sized = asked.join(self.first.select("set_hash", "n"), "set_hash").join(few, "gid")
        sized = sized.filter((F.col("n") * 100 >= F.col("least") * self.percent) & (F.col("most") * 100 >= F.col("n") * self.percent))
        asked = common.saved(sized.select("set_hash", "gid"), "asked-groups")
        asked = common.saved(qualify(asked, self.samples, self.unions, self.percent), "qualifying-groups")
        needed = self.placed.join(asked.select("gid").distinct(), "gid", "left_semi").select("set_hash").unionByName(asked.select("set_hash"))
        if within:
            needed = needed.unionByName(self.unions.select(F.explode("alive").alias("set_hash")))
        wanted = common.saved(self.first.join(needed.distinct(), "set_hash", "left_semi"), "needed-documents")
        tokens = fetch(self.documents, wanted, self.width, whole_tokens).join(self.placed, "set_hash").join(wanted.select("set_hash", "copies"), "set_hash")
        tokens = common.saved(tokens.dropDuplicates(["set_hash"]), "group-tokens")
        groups = common.saved(matrix(tokens), "token-group-matrix")
        found = compare_between(asked, tokens, groups, self.percent)
        return common.saved(found.union(compare_within(groups, self.percent)) if within else found, "set-links")


def similar_sets(documents: DataFrame, described: DataFrame, width: int, percent: int, count_links: bool) -> tuple[DataFrame, DataFrame]:
    """links(a, b) that connect similar different sets, and counts(set_hash, links); without count_links the counts are
    not those of all links."""
    shared = common.saved(shared_keys(described), "shared-keys")
    labels = shared.groupBy("set_hash").agg(F.min("low").alias("label"))
    chunks = labels.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("chunks"))
    placed = labels.join(chunks, "label").select("set_hash", F.xxhash64("label", F.pmod(F.xxhash64("set_hash"), "chunks")).alias("gid"))
    placed = common.saved(placed, "group-members")
    questions = Questions(documents, described, placed, width, percent)
    keyed = common.saved(shared.join(placed, "set_hash"), "keys-of-groups")
    if count_links:
        members = placed.groupBy("gid").agg(F.count(F.lit(1)).alias("sets"))
        a = keyed.select("key", F.col("gid").alias("ga")).distinct().join(members.select(F.col("gid").alias("ga"), F.col("sets").alias("na")), "ga")
        b = keyed.select("key", "gid").distinct().join(members.select("gid", F.col("sets").alias("nb")), "gid")
        # of two groups, the sets of the smaller one ask the larger one
        smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("ga") < F.col("gid")))
        meeting = a.join(b, "key").filter(smaller).select("ga", "gid").distinct()
        found = questions.answers(placed.select("set_hash", F.col("gid").alias("ga")).join(meeting, "ga").select("set_hash", "gid"), within=True)
    else:
        of_low = placed.select(F.col("set_hash").alias("low"), F.col("gid").alias("to"))
        ask_low = keyed.join(of_low, "low", "left").filter("to IS NOT NULL AND gid <> to").select("set_hash", F.col("to").alias("gid"))
        asked = common.saved(ask_low.distinct(), "first-questions")
        found = questions.answers(asked, within=True)
        roots = components(found.filter("b IS NOT NULL").select("a", "b"))
        rooted = keyed.join(roots, keyed["set_hash"] == roots["node"], "left").select("key", "set_hash", "gid", F.coalesce("root", "set_hash").alias("root"))
        by_root = common.saved(rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("sets")), "classes-of-keys")
        cores = by_root.groupBy("key").agg(F.max(F.struct("sets", "root")).alias("m"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").select("key", F.col("m.root").alias("core"))
        cores = common.broadcast_if_small(common.saved(cores, "classes-of-most"))
        open_keys = common.saved(rooted.join(cores, "key"), "open-keys")
        groups = open_keys.groupBy("key", "gid").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        wide = groups.groupBy("key").agg(F.count(F.lit(1)).alias("groups")).filter(F.col("groups") > WIDE).select("key")
        wide = common.broadcast_if_small(common.saved(wide, "wide-keys"))
        asking = open_keys.filter("root <> core").join(wide, "key", "left_anti").select("key", "set_hash", F.col("gid").alias("own"), "root")
        by_key = asking.join(groups.join(wide, "key", "left_anti"), "key").filter("own <> gid AND (low <> root OR high <> root)").select("set_hash", "gid")
        classed = open_keys.join(wide, "key", "left_semi").groupBy("set_hash").agg(F.first("gid").alias("gid"), F.first("root").alias("root"), F.bool_or(F.col("root") != F.col("core")).alias("asking"))
        by_token = questions.further(common.saved(classed, "sets-of-wide-keys"))
        further = by_key.union(by_token).distinct().join(asked, ["set_hash", "gid"], "left_anti")
        found = found.unionByName(questions.answers(further, within=False))
    return found.filter("b IS NOT NULL").select("a", "b"), found.filter("b IS NULL").groupBy(F.col("a").alias("set_hash")).agg(F.sum("links").alias("links"))


def jaccard_classes(documents: DataFrame, width: int = 5, percent: int = 80, count_links: bool = True) -> DataFrame:
    """One row a document: doc_id, row_hash, n_shingles, component_id, n_links, is_first.

    Two documents link when 100 x intersection >= percent x union of their sets of word shingles, in whole texts with
    A-Z lower-cased; with fewer words than `width` the whole sequence is one shingle. component_id is the smallest
    doc_id that links reach, itself included; n_links counts linked documents, copies too (null without count_links,
    which spares comparisons in large classes). Null texts and texts
    without words have empty sets and no links. is_first marks the rows with the smallest (doc_id, hash of text) of
    their component: one, but for repeated rows. A null doc_id counts as smaller than all for is_first and as none
    for component_id. No documents give no rows.
    """
    described = common.saved(describe_sets(documents, width, percent), "shingle-sets")
    links, counts = similar_sets(documents, described, width, percent, count_links)
    roots = components(links)
    sets = described.filter("n > 0").groupBy("set_hash").agg(F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "row_hash")).alias("first"), F.count(F.lit(1)).alias("copies"))
    named = sets.join(roots.withColumnRenamed("node", "set_hash"), "set_hash").join(counts, "set_hash", "left")
    named = common.saved(named, "linked-sets")
    lows = named.groupBy("root").agg(F.min("low").alias("low"), F.min("first").alias("first"))
    lows = common.broadcast_if_small(common.saved(lows, "first-of-classes"))
    linked = named.select("set_hash", "root", "copies", "links").join(lows, "root").select("set_hash", "low", "first", "copies", "links")
    alone = sets.join(roots, sets["set_hash"] == roots["node"], "left_anti").withColumn("links", F.lit(0).cast("long"))
    every = linked.unionByName(alone)
    own = described.select("doc_id", "row_hash", "set_hash", F.col("n").alias("n_shingles"))
    with_words = own.filter("n_shingles > 0").join(every, "set_hash")
    first = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.row_hash") == F.col("row_hash"))
    full = with_words.select("doc_id", "row_hash", "n_shingles", F.col("low").alias("component_id"), (F.col("copies") - 1 + F.col("links") if count_links else F.lit(None).cast("long")).alias("n_links"), first.alias("is_first"))
    none = F.lit(0 if count_links else None).cast("long")
    empty = own.filter("n_shingles = 0").select("doc_id", "row_hash", "n_shingles", F.col("doc_id").alias("component_id"), none.alias("n_links"), F.lit(True).alias("is_first"))
    return full.unionByName(empty)


def keep_first(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """documents with one row of each class of near copies, all columns as they are; texts without words all stay, and of
    rows alike in doc_id and text one. Whole texts count, however long; no rows give none."""
    classes = common.saved(jaccard_classes(documents, width, percent, count_links=False), "classes")
    drop = classes.groupBy("doc_id", "row_hash").agg(F.count(F.lit(1)).alias("_rows"), F.bool_or("is_first").alias("_first"), F.max("n_shingles").alias("_n"))
    drop = drop.filter("NOT _first OR (_n > 0 AND _rows > 1)").select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"), "_first")
    drop = common.broadcast_if_small(common.saved(drop, "dropped"))
    same = documents["doc_id"].cast("long").eqNullSafe(drop["_id"]) & (F.xxhash64(documents["text"]) == drop["_hash"])
    kept = documents.join(drop, same, "left_anti")
    mark = "_" + "_".join(documents.columns)  # no column's name
    repeated = documents.join(drop.filter("_first"), same, "left_semi").withColumn(mark, F.xxhash64("text")).dropDuplicates(["doc_id", mark]).drop(mark)
    return kept.unionByName(repeated)
