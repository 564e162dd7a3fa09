"""Weighted shortest paths, blast radius and path simulation on edge tables.

``shortest_paths`` is a frontier relaxation (distributed Bellman-Ford): each
round joins the rows improved in the previous round with the edge table,
keeps the best candidate per (src, dst) and merges it into the path table.
Only improved rows travel to the next round, the loop stops when none
improved, and every round's path table is cut from its lineage with a
reliable ``checkpoint`` in the cluster's shared checkpoint folder (so a lost
executor does not replay all rounds).  Ties between equal-length paths are
broken by the path text, so results are deterministic.

Scale note: the closure from every node can reach n² pairs; the blast score
alone only needs distances to the critical nodes, which ``critical_distances``
computes from the critical side on reversed edges (n × |critical| rows).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.session import ensure_checkpoint_dir

PATH_SEP = ">"


def _best(df: DataFrame) -> DataFrame:
    """One row per (src, dst): smallest dist, then smallest path text."""
    key = F.struct(F.col("dist"), F.col("path_key"))
    return (df.groupBy("src", "dst")
              .agg(F.min_by(F.struct("dist", "path_key", "path"), key).alias("b"))
              .select("src", "dst", F.col("b.dist").alias("dist"), F.col("b.path_key").alias("path_key"),
                      F.col("b.path").alias("path")))


def shortest_paths(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """All shortest weighted paths from ``sources`` (default: every node, of
    which those without incoming edges are left out of the rounds, see
    ``_paths_from_all``).

    nodes(id), edges(src, dst, weight) → (src, dst, dist, hops, path array,
    path_key).  A node reaches itself with distance 0.

    Each round's improvements are kept as a checkpointed delta; a candidate
    counts as improved when no existing row for its (src, dst) is at least as
    good (an anti-join on the pair with a distance / path condition), so the
    path table is never rewritten between rounds.  The best row per pair is
    resolved once at the end."""
    if sources is None:
        return _paths_from_all(nodes, edges)
    spark = nodes.sparkSession
    ensure_checkpoint_dir(spark)
    e = edges.select(F.col("src").alias("e_src"), F.col("dst").alias("e_dst"),
                     F.col("weight").cast("double").alias("w"))
    starts = sources.select(F.col("id").alias("src"))
    base = starts.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("dist"),
                         F.col("src").alias("path_key"), F.array(F.col("src")).alias("path")).checkpoint()
    deltas = [base]
    frontier = base
    while True:  # ends when no path improved; weights are not negative
        cand = (frontier.join(e, frontier["dst"] == e["e_src"])
                .where(~F.array_contains("path", F.col("e_dst")))
                .select("src", F.col("e_dst").alias("dst"), (F.col("dist") + F.col("w")).alias("dist"),
                        F.concat(F.col("path_key"), F.lit(PATH_SEP), F.col("e_dst")).alias("path_key"),
                        F.concat(F.col("path"), F.array(F.col("e_dst"))).alias("path")))
        best = _best(cand)
        known = reduce(DataFrame.unionByName, deltas).select(
            F.col("src").alias("o_src"), F.col("dst").alias("o_dst"), F.col("dist").alias("o_dist"),
            F.col("path_key").alias("o_key"))
        at_least_as_good = ((best["src"] == known["o_src"]) & (best["dst"] == known["o_dst"])
                            & ((known["o_dist"] < best["dist"])
                               | ((known["o_dist"] == best["dist"]) & (known["o_key"] <= best["path_key"]))))
        improved = best.join(known, at_least_as_good, "left_anti").checkpoint()
        if improved.isEmpty():
            break
        deltas.append(improved)
        frontier = improved
    paths = _best(reduce(DataFrame.unionByName, deltas)).checkpoint()
    return paths.withColumn("hops", F.size("path") - 1)


def _paths_from_all(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Paths from every node.  No path leads through a node without incoming
    edges, so the rounds run from the other nodes only, and such a node's paths
    are one edge and a path from that edge's end: one join instead of rounds."""
    entered = edges.select(F.col("dst").alias("id")).distinct()
    core = shortest_paths(nodes, edges, nodes.join(entered, "id", "left_semi"))
    outer = nodes.join(entered, "id", "left_anti").select(F.col("id").alias("src"))
    first = edges.select("src", F.col("dst").alias("via"), F.col("weight").cast("double").alias("w")).join(outer, "src")
    onward = core.select(F.col("src").alias("via"), "dst", "dist", "path_key", "path")
    led = _best(first.join(onward, "via").select(
        "src", "dst", (F.col("w") + F.col("dist")).alias("dist"),
        F.concat("src", F.lit(PATH_SEP), "path_key").alias("path_key"), F.concat(F.array("src"), F.col("path")).alias("path")))
    own = outer.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("dist"), F.col("src").alias("path_key"), F.array("src").alias("path"))
    return core.drop("hops").unionByName(led).unionByName(own).withColumn("hops", F.size("path") - 1)


def blast_radius(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Per node: score Σ 1/(d+1) over reachable critical nodes (4 dp, halves
    to even), reachable count, path to the nearest critical node (ties → node
    order) and the movement pattern.  nodes(id, critical_asset, node_ord)."""
    crit = nodes.where("critical_asset").select(F.col("id").alias("dst"), F.col("node_ord").alias("c_ord"))
    reach = paths.groupBy("src").agg(F.count(F.lit(1)).alias("affected"))
    # Critical nodes are few in practice, but not bounded: AQE converts this
    # join to a broadcast at run time when the measured side is small.
    cp = paths.join(crit, "dst")
    per = (cp.groupBy("src")
             .agg(F.bround(F.sum(1.0 / (F.col("dist") + 1.0)), 4).alias("blast_radius_score"),
                  F.min_by(F.struct("dst", "path", "dist"), F.struct("dist", "c_ord")).alias("near")))
    out = (nodes.select(F.col("id").alias("node"), "node_ord")
           .join(reach, F.col("node") == F.col("src"), "left").drop("src")
           .join(per, F.col("node") == F.col("src"), "left").drop("src"))
    return out.select(
        "node",
        F.coalesce("blast_radius_score", F.lit(0.0)).alias("blast_radius_score"),
        F.coalesce("affected", F.lit(0)).cast("bigint").alias("affected_count"),
        F.col("near.dst").alias("nearest_critical"),
        F.coalesce(F.col("near.path"), F.array().cast("array<string>")).alias("path_to_nearest_critical"),
        F.when(F.coalesce("affected", F.lit(0)) > 1, F.lit("LATERAL_MOVEMENT")).otherwise(F.lit("DIRECT_ATTACK"))
         .alias("movement_pattern"))


def critical_distances(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, critical, dist) from the critical side on reversed edges."""
    rev = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    crit = nodes.where("critical_asset").select("id")
    p = shortest_paths(nodes, rev, sources=crit)
    return p.select(F.col("dst").alias("node"), F.col("src").alias("critical"), "dist")


def simulate_paths(requests: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """requests(source, target) → hops, path, risk exposure max(0, 100 − 10·dist)
    (2 dp); unknown or unreachable pairs give 0 / [] / 0.0."""
    p = paths.select(F.col("src").alias("source"), F.col("dst").alias("target"), "dist", "path")
    return risk_of_paths(requests.join(p, ["source", "target"], "left"))


def risk_of_paths(j: DataFrame) -> DataFrame:
    """``source, target, dist, path`` of requests, null where there is no path → their figures."""
    found = F.col("dist").isNotNull()
    return j.select(
        "source", "target",
        F.when(found, F.greatest(F.size("path") - 1, F.lit(0))).otherwise(F.lit(0)).alias("hops"),
        F.when(found, F.col("path")).otherwise(F.array().cast("array<string>")).alias("path"),
        F.when(found, F.bround(F.greatest(F.lit(0.0), 100.0 - F.col("dist") * 10.0), 2)).otherwise(F.lit(0.0))
         .alias("risk_exposure"))


def graph_summary(nodes: DataFrame, edges: DataFrame, display_critical_types: list[str]) -> DataFrame:
    """Node / edge / critical counts in one aggregation over both tables."""
    both = (nodes.select(F.lit(1).alias("is_node"), F.col("critical_asset"), F.col("node_type"))
            .unionByName(edges.select(F.lit(0).alias("is_node"), F.lit(False).alias("critical_asset"),
                                      F.lit(None).cast("string").alias("node_type"))))
    return both.agg(F.sum("is_node").cast("bigint").alias("total_nodes"),
                    F.count(F.when(F.col("is_node") == 0, 1)).alias("total_edges"),
                    F.count(F.when(F.col("critical_asset"), 1)).alias("n_critical"),
                    F.count(F.when(F.col("node_type").isin(*display_critical_types), 1)).alias("display_critical"))


def listing(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All nodes with label and type and all edges with protocol, UNKNOWN where there is none."""
    none = F.lit(None).cast("string")
    return (nodes.select(F.lit("node").alias("kind"), F.col("id").alias("source"), none.alias("target"), F.col("id").alias("label"),
                         F.coalesce("node_type", F.lit("UNKNOWN")).alias("detail"))
            .unionByName(edges.select(F.lit("edge").alias("kind"), F.col("src").alias("source"), F.col("dst").alias("target"), none.alias("label"),
                                      F.coalesce("protocol", F.lit("UNKNOWN")).alias("detail"))))


def critical_list(nodes: DataFrame) -> DataFrame:
    """Critical nodes with their number in order of the node order."""
    from vigil.functions.ordered import running_totals
    some = running_totals(nodes.where("critical_asset").select("id", "node_type", "node_ord"), "node_ord", [])
    return some.select((F.col("idx") + 1).alias("nth"), F.col("id").alias("node"), "node_type")
