"""Connected components by minimum labels and pointer jumping, in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """edges: columns a, b of one type, null-free. Returns node, root for each node
    with a link; root is the smallest node that it reaches. In each round a node
    takes the smallest label among its own and its neighbours' and then the label of
    that label. Minima are pre-aggregated before each shuffle, so a node with very
    many links costs no task more than others; joins on such a node are split by AQE.
    The labels of each round are checkpointed to the shared folder. Raises if
    `rounds` don't suffice (a path doubles its reach in each round)."""
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")).checkpoint()
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        hooked = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        parent = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
        # what a node's root learnt from its own neighbours comes along with the jump
        jumped = hooked.join(parent, "root", "left").select("node", "was", F.coalesce(F.least("root", "up"), "root").alias("root")).checkpoint()
        changed = jumped.where("root <> was").limit(1).count()
        labels = jumped.select("node", "root")
        if not changed:
            return labels
    raise RuntimeError("components: more rounds are needed")
