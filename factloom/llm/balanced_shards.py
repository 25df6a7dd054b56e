"""Operator 6: balanced label propagation into shards; DataFrame operations only.

Documents link by sharing a key (an equal text is one). Labels start from a hash of the key, or of the document where it has none or
one too large for a shard, and so depend on no numbering. In each round a document counts its
neighbours' shards, through one row of counts a key, and wants the shard that most of them are in (at a tie the same
one for all that share the key). How many want to go
from each shard to each other is a table of shards x shards; from it come quotas: moves in both directions pair up, and
beyond that a shard takes no more than it has room for. A hash of the key (of the document, for keys too large for
one shard) decides who goes, so that linked documents move together. At the end shards above their exact size give up
documents, those without links first, then those of texts too frequent for one shard, to shards below it, so that counts differ by one at most.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def _unit(*parts: Column) -> Column:
    """A number from 0 to 1 from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 20)) / float(1 << 20)


def quotas(load: list[int], size: list[int], wants: dict[tuple[int, int], int]) -> dict[tuple[int, int], float]:
    """The share of the wishes from each shard to each other that is granted: pairs of opposite moves, then what fits
    beyond the load, in order of wishes."""
    granted = {(i, j): min(n, wants.get((j, i), 0)) for (i, j), n in wants.items()}
    room = [max(0, s - n) for n, s in zip(load, size, strict=True)]
    for i, j in sorted(wants, key=lambda p: (-wants[p], p)):
        more = min(room[j], wants[i, j] - granted[i, j])
        granted[i, j] += more
        room[j] -= more
        room[i] += more
    return {p: granted[p] / wants[p] for p in wants if granted[p]}


def propagate(labels: DataFrame, members: DataFrame, size: list[int], rounds: int) -> DataFrame:
    """labels(node, shard) of all nodes and members(node, key) of linked ones -> labels after `rounds` rounds at most."""
    shards = len(size)
    linked = labels.join(members.select("node").distinct(), "node", "left_semi")
    loads = {r["shard"]: r["n"] for r in labels.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a shard
    load = [loads.get(i, 0) for i in range(shards)]
    large = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    members = common.saved(members.join(large, "key").select("node", "key", (F.col("n") * 4 > min(size)).alias("large")), "members")
    linked = common.saved(linked, "linked-labels")
    columns = [f"c{i}" for i in range(shards)]
    late = False
    for turn in range(rounds):
        late = late or turn >= rounds // 2
        placed = members.join(linked, "node")
        votes = placed.groupBy("key").agg(*[F.count_if(F.col("shard") == i).alias(c) for i, c in enumerate(columns)])
        heard = placed.join(votes, "key").groupBy("node").agg(F.first("shard").alias("shard"), F.min("key").alias("any_key"), F.min(F.when(~F.col("large"), F.col("key"))).alias("key"), *[F.sum(c).alias(c) for c in columns])
        # one target for all documents of a key: own votes count too, and ties fall by an order of the key's own
        rank = F.array(*[F.struct(F.col(c).alias("n"), F.xxhash64("any_key", F.lit(i)).alias("h"), F.lit(i).alias("to")) for i, c in enumerate(columns)])
        wish = common.saved(heard.select("node", "shard", "key", F.array_max(rank)["to"].alias("to")), "wishes")
        wish = wish if late else wish.withColumn("to", F.when(F.col("key").isNull(), F.col("shard")).otherwise(F.col("to")))  # keys too large for one shard wait
        wants = {(r["shard"], r["to"]): r["n"] for r in wish.filter("shard <> to").groupBy("shard", "to").agg(F.count(F.lit(1)).alias("n")).collect()}  # shards x shards
        share = quotas(load, [s + s // 20 + 1 for s in size], wants)  # 5 % above its size; the end levels that
        if not share:  # nobody may move any more
            if late:
                break
            late = True
            continue
        chain = F.lit(0.0)
        for (i, j), x in share.items():
            chain = F.when((F.col("shard") == i) & (F.col("to") == j), x).otherwise(chain)
        goes = (F.col("shard") != F.col("to")) & (_unit(F.coalesce("key", "node"), F.lit(turn)) < chain)
        moved = common.saved(wish.select("node", F.when(goes, F.col("to")).otherwise(F.col("shard")).alias("shard"), goes.alias("went"), F.col("shard").alias("was")), "linked-labels")
        for r in moved.filter("went").groupBy("was", "shard").agg(F.count(F.lit(1)).alias("n")).collect():  # shards x shards
            load[r["was"]] -= r["n"]
            load[r["shard"]] += r["n"]
        linked = moved.select("node", "shard")
    alone = labels.join(members.select("node").distinct(), "node", "left_anti")
    ties = members.groupBy("node").agg(F.when(F.bool_and("large"), 1).otherwise(2).alias("tie"))
    return alone.withColumn("tie", F.lit(0)).unionByName(linked.join(ties, "node"))


def levelled(labels: DataFrame, size: list[int]) -> DataFrame:
    """labels(node, shard, tie) with exactly size[i] nodes in shard i: what is above goes to where there is room, nodes
    without links (tie 0) first, then those of keys that no shard holds whole (1), then others (2)."""
    counted = {(r["shard"], r["tie"]): r["n"] for r in labels.groupBy("shard", "tie").agg(F.count(F.lit(1)).alias("n")).collect()}  # three rows a shard
    shards = range(len(size))
    ahead = {(i, tie): sum(counted.get((i, t), 0) for t in range(tie)) for i in shards for tie in range(4)}
    excess = [ahead[i, 3] - size[i] for i in shards]
    numbered = common.number_within(labels, ["shard", "tie"], ["node"], "_at")
    at, over, first = F.col("_at"), F.lit(0), F.lit(0)
    before = [0, *accumulate(max(0, e) for e in excess)]
    for i in shards:
        here = F.col("shard") == i
        for tie in (1, 2):
            at = F.when(here & (F.col("tie") == tie), F.col("_at") + ahead[i, tie]).otherwise(at)
        over, first = F.when(here, max(0, excess[i])).otherwise(over), F.when(here, before[i]).otherwise(first)
    released, place, upto = at < over, first + at, 0
    to = F.col("shard")
    for i in shards:
        if excess[i] < 0:
            to = F.when(released & (place >= upto) & (place < upto - excess[i]), i).otherwise(to)
            upto -= excess[i]
    return numbered.select("node", to.cast("int").alias("shard"))


def balanced(nodes: DataFrame, members: DataFrame, shards: int = 8, rounds: int = 8) -> DataFrame:
    """node, shard for nodes(node, seed) and members(node, key), saved tables; seed: a hash of the row's own content: linked nodes together where the sizes allow;
    sizes differ by one at most, the first shards being the larger ones. No nodes give no rows."""
    n = nodes.count()
    size = [n // shards + (i < n % shards) for i in range(shards)]
    # what shares a key that a shard can hold starts together; whatever shares a larger one, and what is alone, is spread evenly
    counts = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * 4 <= min(size))
    first = members.join(counts, "key").groupBy("node").agg(F.min("key").alias("first"))
    start = nodes.join(first, "node", "left").select("node", F.pmod(F.xxhash64(F.coalesce("first", "seed")), F.lit(shards)).cast("int").alias("shard"))
    moved = propagate(common.saved(start, "labels"), members, size, rounds)
    return common.saved(levelled(common.saved(moved, "labels"), size), "shards")


def shard_documents(documents: DataFrame, shards: int = 8, rounds: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null under this law), text_hash.

    Documents with equal texts are linked. size: bytes of the text in UTF-8 plus one; a null text has none and links
    with null and empty texts. slot numbers the documents of a shard from 0 without gaps. Repeated rows are documents
    of their own; documents alike in doc_id and text are interchangeable.
    """
    text = F.coalesce("text", F.lit(""))
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    base = common.saved(base.withColumn("_all", F.lit(0)), "sized")
    base = common.saved(common.number_within(base, ["_all"], ["text_hash", "doc_id"], "node").drop("_all"), "nodes")
    shared = base.groupBy("text_hash", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = common.broadcast_if_small(common.saved(shared.drop("n"), "shared-texts"))
    members = common.saved(base.join(shared, ["text_hash", "size", "text_crc32"]).select("node", F.xxhash64("text_hash", "size", "text_crc32").alias("key")), "links")
    placed = base.join(balanced(base.select("node", F.xxhash64("doc_id", "text_hash").alias("seed")), members, shards, rounds), "node")
    placed = common.saved(placed, "placed")
    slots = common.number_within(placed, ["shard"], ["node"], "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "text_hash")
