"""Connected components of an undirected graph given as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import cut


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, root, root_rank`` for ``nodes(node, rank)`` and ``edges(a, b)``:
    the root is the node with the least (rank, node) that edges lead to.

    In each round a node takes the least root among its neighbours' and its own,
    then its root's root, which halves long chains; rounds end when no root
    changes.  Nodes without edges keep out of the rounds, and each round is
    written to the shared checkpoint folder.  A null rank comes last.

    The edges are written before they are read in both directions: where a task
    picks one of several sets of links that connect the same nodes, two
    evaluations may pick differently, and half of each connects nothing."""
    edges = cut(edges.select("a", "b"))
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    last = F.lit((1 << 63) - 1)
    own = nodes.select("node", F.struct(F.coalesce("rank", last).alias("rank"), "node").alias("label"))
    linked = cut(own.join(both.select(F.col("a").alias("node")).distinct(), "node"))
    while True:
        offers = (both.join(linked.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("offer")))
        near = linked.join(offers, "node").select("node", F.col("label").alias("was"), F.least("label", "offer").alias("label"))
        roots = near.select(F.col("node").alias("r"), F.col("label").alias("further"))
        jumped = cut(near.join(roots, near["label.node"] == roots["r"]).select("node", "was", F.least("label", "further").alias("label")))
        linked = jumped.select("node", "label")
        if jumped.where("was <> label").isEmpty():
            break
    alone = own.join(both.select(F.col("a").alias("node")).distinct(), "node", "left_anti")
    out = linked.union(alone)
    return out.select("node", F.col("label.node").alias("root"), F.when(F.col("label.rank") != last, F.col("label.rank")).alias("root_rank"))
