"""Propagation goes on while anybody may move."""

from factloom.llm import balanced_shards, common


def test_the_last_split_group_is_joined(spark):
    nodes = [(i, i // 2 % 2, i // 2) for i in range(1000)]
    nodes[1] = (1, 1, 0)
    labels = common.saved(spark.createDataFrame([n[:2] for n in nodes], "node long, shard int"), "labels")
    members = common.saved(spark.createDataFrame([(n, k) for n, _, k in nodes], "node long, key long"), "members")
    shard = {r.node: r.shard for r in balanced_shards.propagate(labels, members, [510, 510], 8).collect()}
    assert all(shard[i] == shard[i + 1] for i in range(0, 1000, 2))
