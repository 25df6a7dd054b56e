"""Connected components of a link table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """links(a, b), any direction, repeats allowed -> node, root: the smallest node that links reach.

    Each round takes the smallest label among neighbours and then the label of the label, so long chains halve; every
    round is a table in the shared folder. Ends when a round changes nothing.
    """
    both = common.saved(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = common.saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        step = common.saved(step, "labels")
        of_root = step.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        labels = step.join(of_root, step["root"] == of_root["_node"], "left").select("node", "was", F.least("root", "_root").alias("root"))
        labels = common.saved(labels, "labels")
        if labels.filter("root < was").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")
