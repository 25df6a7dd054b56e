"""Graph work by joins: closure, roots of functional graphs, reachability under ambiguous edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.tables import saved


def closure(edges: DataFrame) -> DataFrame:
    """edges(src, dst) -> src, dst, depth: all pairs of different nodes that a path joins, with the shortest length.
    Semi-naive: each round extends only the pairs that the last one found; cycles end it as others do. The result is all
    pairs by definition: for graphs of short chains, such as prerequisites; for what some roots reach, see `walk`."""
    edges = saved(edges.select("src", "dst").distinct())
    new = saved(edges.filter("src <> dst").withColumn("depth", F.lit(1)))
    every, depth = new, 1
    while not new.isEmpty():
        depth += 1
        step = new.select("src", F.col("dst").alias("via")).join(edges.select(F.col("src").alias("via"), "dst"), "via").filter("src <> dst").select("src", "dst").distinct()
        new = saved(step.join(every, ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)))
        every = every.unionByName(new)
        if depth % 8 == 0:
            every = saved(every)
    return every


def walk(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node, depth: what the roots(node) reach over edges(src, dst), themselves at depth 0, each node once. One join a
    round between the nodes met last and their edges, so that the work is that of the edges."""
    edges = saved(edges.select("src", "dst").distinct())
    new = saved(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    met, depth = new, 0
    while not new.isEmpty():
        depth += 1
        step = new.join(edges, new["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        new = saved(step.join(met, "node", "left_anti").withColumn("depth", F.lit(depth)))
        met = met.unionByName(new)
        if depth % 8 == 0:
            met = saved(met)
    return met


def levels(needs: DataFrame) -> DataFrame:
    """entity, level of needs(entity, needed): 0 for what needs nothing, else one more than the highest level that it
    needs. A cycle is an error. One join a level."""
    needs = saved(needs.select("entity", "needed").distinct())
    nodes = saved(needs.select("entity").union(needs.select("needed")).distinct())
    left, done, level = nodes, None, 0
    while not left.isEmpty():
        waiting = needs.join(left.select(F.col("entity").alias("needed")), "needed", "left_semi").select("entity").distinct()
        ready = saved(left.join(waiting, "entity", "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            raise ValueError("prerequisites form a cycle")
        done = ready if done is None else done.unionByName(ready)
        left = saved(left.join(ready, "entity", "left_anti"))
        level += 1
    return nodes.withColumn("level", F.lit(0)).limit(0) if done is None else done


def _clean(edges: DataFrame) -> DataFrame:
    return saved(edges.select("parent", "child").filter("parent <> child").distinct())


def _single(edges: DataFrame) -> DataFrame:
    """node, parent of nodes with one parent."""
    return saved(edges.groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("_n"), F.min("parent").alias("parent")).filter("_n = 1").drop("_n"))


def _condensed(edges: DataFrame, single: DataFrame, ends: DataFrame) -> DataFrame:
    """src, dst, low, cyclic: edges into nodes of several parents, each from where the chain of single parents above the
    parent begins; low: the lowest node of that chain."""
    into = edges.join(single.select(F.col("node").alias("child")), "child", "left_anti")
    return saved(into.join(ends.withColumnRenamed("node", "parent"), "parent", "left").select(F.coalesce("root", "parent").alias("src"), F.col("child").alias("dst"), "low", F.coalesce("cyclic", F.lit(False)).alias("cyclic")).distinct())


def pushed(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """node, label: every node that a node of labels(node, label) reaches over edges(parent, child), and itself, with its label.

    Chains of single parents are passed by doubling, in as many rounds as the logarithm of their length; nodes of
    several parents then pass labels on among themselves, a round for each such node on a way. Rows are those of the
    result, never all pairs of nodes."""
    edges, labels = _clean(edges), saved(labels.select("node", "label").distinct())
    single = _single(edges)
    ends = saved(chains(single))
    on_chain = saved(labels.join(single.select("node"), "node", "left_semi"))
    up, n, rounds = single.select("node", F.col("parent").alias("to")), single.count(), 0
    while 2**rounds <= n and not up.isEmpty():
        on_chain = saved(on_chain.unionByName(up.join(on_chain.withColumnRenamed("node", "to"), "to").select("node", "label")).distinct())
        up = saved(up.join(up.select(F.col("node").alias("to"), F.col("to").alias("_to")), "to").select("node", F.col("_to").alias("to")))
        rounds += 1
    condensed = _condensed(edges, single, ends)
    own = labels.join(single.select("node"), "node", "left_anti")
    brought = edges.join(single.select(F.col("node").alias("child")), "child", "left_anti").join(on_chain.withColumnRenamed("node", "parent"), "parent").select(F.col("child").alias("node"), "label")
    new = saved(own.unionByName(brought).distinct())
    met, rounds = new, 0
    while not new.isEmpty():
        step = new.join(condensed.filter("NOT cyclic").select(F.col("src").alias("node"), "dst"), "node").select(F.col("dst").alias("node"), "label").distinct()
        new = saved(step.join(met, ["node", "label"], "left_anti"))
        rounds += 1
        met = met.unionByName(new) if rounds % 8 else saved(met.unionByName(new))
    below = ends.filter("NOT cyclic").join(met.withColumnRenamed("node", "root"), "root").select("node", "label")
    return on_chain.unionByName(met).unionByName(below).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component of nodes(node) and edges(src, dst) among them: strongly connected components, named by their highest
    node. Each turn colours nodes by the highest node that reaches them; what a colour's own node is reached from within the
    colour is its component."""
    left, found = saved(nodes.select("node").distinct()), None
    edges = saved(edges.select("src", "dst").distinct())
    while not left.isEmpty():
        colour = left.withColumn("colour", F.col("node"))
        while True:
            heard = edges.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("_heard"))
            colour = saved(colour.join(heard, "node", "left").select("node", F.greatest("colour", "_heard").alias("colour"), (F.col("_heard") > F.col("colour")).alias("_new")))
            if colour.filter("_new").isEmpty():
                break
            colour = colour.drop("_new")
        colour = colour.drop("_new")
        within = edges.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("_a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("_b")), "dst").filter("_a = _b")
        back = saved(within.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        part = walk(back, colour.filter("node = colour").select("node")).select("node").join(colour, "node").select("node", F.col("colour").alias("component"))
        part = saved(part)
        found = part if found is None else found.unionByName(part)
        left = saved(left.join(part, "node", "left_anti"))
        edges = saved(edges.join(left.select(F.col("node").alias("src")), "src", "left_semi").join(left.select(F.col("node").alias("dst")), "dst", "left_semi"))
    return nodes.select("node", F.col("node").alias("component")).limit(0) if found is None else found


def roots_of(edges: DataFrame) -> DataFrame:
    """node, root of edges(parent, child): ancestors without parents; of what only hangs below cycles, the lowest node of
    those cycles. The lowest node of a cycle is its own root and has no row; so has a node without parents. Labels go down
    from the roots (see pushed); cycles are looked for only in what no root reaches."""
    edges = _clean(edges)
    above = edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")
    tops = saved(pushed(edges, above.select("node", F.col("node").alias("label"))).filter("node <> label").select("node", F.col("label").alias("root")))
    rest = saved(edges.select(F.col("child").alias("node")).distinct().join(tops.select("node"), "node", "left_anti"))
    if rest.isEmpty():
        return tops
    edges = saved(edges.join(rest.select(F.col("node").alias("child")), "child", "left_semi"))  # whose parents are of the rest too
    single = _single(edges)
    ends = saved(chains(single))
    into = _condensed(edges, single, ends)
    several = rest.join(single.select("node"), "node", "left_anti")
    whole = components(several, into.filter("NOT cyclic").select("src", "dst"))
    inner = into.filter("NOT cyclic").join(whole.select(F.col("node").alias("src"), F.col("component").alias("_a")), "src").join(whole.select(F.col("node").alias("dst"), "component"), "dst").filter("_a = component")
    lows = inner.groupBy("component").agg(F.min(F.least("src", "dst", "low")).alias("label"))
    start = whole.join(lows, "component").select("node", "label").unionByName(into.filter("cyclic").select(F.col("dst").alias("node"), F.col("src").alias("label")))
    held = saved(start.groupBy("node").agg(F.min("label").alias("label")))
    new = held
    while not new.isEmpty():  # the lowest label goes down
        step = new.join(into.filter("NOT cyclic").select(F.col("src").alias("node"), "dst"), "node").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("_label"))
        joined = saved(step.join(held, "node", "left").filter("label IS NULL OR _label < label").select("node", F.col("_label").alias("label")))
        held = saved(held.join(joined, "node", "left_anti").unionByName(joined))
        new = joined
    below = ends.filter("NOT cyclic").join(held.withColumnRenamed("node", "root"), "root").select("node", F.col("label").alias("root"))
    cyclic = ends.filter("cyclic").select("node", "root")
    found = held.select("node", F.col("label").alias("root")).unionByName(below).unionByName(cyclic)
    return tops.unionByName(found.filter("node <> root"))


def rank_within(rows: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """rows with their number from 1 within each key in an order that tells them apart. Rows are dealt by ranges of key
    and order, numbered in each range, and ranges start where those before end: no key comes to one task."""
    dealt = rows.repartitionByRange(F.col(key), *order).withColumn("_range", F.spark_partition_id())
    dealt = saved(dealt)
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n")).select(key, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = dealt.withColumn("_at", F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order)))
    return local.join(starts, [key, "_range"]).withColumn(name, (F.col("_start") + F.col("_at")).cast("int")).drop("_range", "_at", "_start")


def chains(parents: DataFrame) -> DataFrame:
    """parents(node, parent), one parent a node at most -> node, root, low, cyclic: the end of the chain above a node and the
    lowest node on it, without the end; where it runs into a cycle, root is the cycle's lowest node. Pointer doubling: as many
    rounds as the logarithm of the longest chain."""
    jumps = saved(parents.select("node", F.col("parent").alias("to"), F.col("node").alias("low")))
    rounds, nodes = 1, jumps.count()
    while True:
        nxt = jumps.select(F.col("node").alias("_n"), F.col("to").alias("_to"), F.col("low").alias("_low"))
        jumps = saved(jumps.join(nxt, jumps["to"] == nxt["_n"], "left").select("node", F.coalesce("_to", "to").alias("to"), F.least("low", "_low").alias("low"), F.col("_n").isNotNull().alias("moving")))
        rounds += 1
        if jumps.filter("moving").isEmpty() or 2**rounds > 4 * nodes + 4:  # one round more than the longest chain takes
            break
        jumps = jumps.drop("moving")
    # what still moves is on a cycle or leads to one: `to` is on the cycle, and its low is the cycle's lowest
    cycle = jumps.filter("moving").select(F.col("node").alias("_n"), F.col("low").alias("_low"))
    ended = jumps.join(cycle, jumps["to"] == cycle["_n"], "left")
    return ended.select("node", F.when(F.col("moving"), F.coalesce("_low", "to")).otherwise(F.col("to")).alias("root"), "low", F.col("moving").alias("cyclic"))


def canonical(parents: DataFrame) -> DataFrame:
    """parents(node, parent), one parent a node at most -> node, root: the end of the chain, or the lowest node of the
    cycle it runs into."""
    return chains(parents).select("node", "root")
