"""Connected components of an edge table, by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import forget, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of an edge (a, b): root is the smallest node reachable.

    Each round shuffles edges and labels once.  A hub's edges are pre-aggregated
    by min, so no round gathers a node's neighbours in one task.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    both = stored(both, "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"), F.col("a").alias("old")), "labels")
    while True:
        seen = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        step = labels.join(seen, "node", "left").select("node", "root", F.least("root", F.coalesce("seen", "root")).alias("next"))
        up = labels.select(F.col("node").alias("next"), F.col("root").alias("top"))
        new = step.join(up, "next", "left").select("node", F.least("next", F.coalesce("top", "next")).alias("root"), F.col("root").alias("old"))
        new = stored(new, "labels")
        forget(labels)
        labels = new
        if new.where("root <> old").isEmpty():
            forget(both)
            return labels.select("node", "root")
