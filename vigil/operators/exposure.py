"""Blast radius from the critical side, without a table of all pairs.

Distances and first hops are relaxed from the targets over reversed edges (a row
per node and target).  A node's path to its nearest target follows first hops: the
nearest target of the next node is the same one, so paths need a row per node and
double in length each round.  How many nodes a node can reach is counted in bitsets
of 64 nodes a word, merged along the edges until none changes.

No path leads through a node without incoming edges, so all rounds run among the
others, the *core*, and such nodes are added by one join at the end.  Rounds are cut
with reliable checkpoints, ``STEPS`` relaxations each, and end when a digest of the
table stays the same.  Weights are positive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.ordered import running_totals
from vigil.operators.graph import PATH_SEP, shortest_paths
from vigil.session import materialize

STEPS = 3


def prepared(edges: DataFrame) -> DataFrame:
    """``src, dst, weight, inner``: the shortest of parallel edges; inner ones start in the core."""
    entered = edges.select(F.col("dst").alias("src")).distinct().withColumn("inner", F.lit(True))
    least = edges.groupBy("src", "dst").agg(F.min(F.col("weight").cast("double")).alias("weight"))
    return materialize(least.join(entered, "src", "left").withColumn("inner", F.coalesce("inner", F.lit(False))))


def settled(table: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step`` applied until the table stays as it is."""
    digest = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*df.columns))).first())
    table, last = materialize(table), None
    while last != (last := digest(table)):
        for _ in range(STEPS):
            table = step(table)
        table = materialize(table)
    return table


def routes(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """``node, target, dist, next`` of every node that reaches one of ``targets(id)``;
    ``next`` is null at the target itself.  Of equally long paths the one whose
    text is least counts.  ``edges`` are ``prepared``."""
    inner = edges.where("inner").select("src", "dst", "weight")
    core = edges.select(F.col("dst").alias("id")).distinct()
    own = targets.select(F.col("id").alias("node"), F.col("id").alias("target"), F.lit(0.0).alias("dist"))
    start = own.join(core.select(F.col("id").alias("node")), "node", "left_semi")

    def relaxed(dist: DataFrame) -> DataFrame:
        onward = inner.join(dist, F.col("dst") == F.col("node")).select(F.col("src").alias("node"), "target", (F.col("weight") + F.col("dist")).alias("dist"))
        return dist.unionByName(onward).groupBy("node", "target").agg(F.min("dist").alias("dist"))

    dist = settled(start, relaxed)
    text = F.when(F.col("node") == F.col("target"), F.col("node")).otherwise(F.concat("node", F.lit(PATH_SEP)))
    hops = (edges.join(dist, F.col("dst") == F.col("node")).where(F.col("src") != F.col("target"))
            .select(F.col("src").alias("at"), "target", (F.col("weight") + F.col("dist")).alias("far"), text.alias("text"), F.col("node").alias("next"))
            .groupBy("at", "target").agg(F.min(F.struct("far", "text", "next")).alias("best")))
    return hops.select(F.col("at").alias("node"), "target", F.col("best.far").alias("dist"), F.col("best.next").alias("next")).unionByName(
        own.withColumn("next", F.lit(None).cast("string")))


def followed(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, target, path`` of ``pairs(node, target, next)``, which hold the pair
    of every next node with the same target."""
    core = edges.select(F.col("dst").alias("node")).distinct()
    rows = materialize(pairs.join(core, "node", "left_semi").select("node", "target", F.array("node").alias("path"), "next"))
    while not rows.where("next is not null").isEmpty():
        for _ in range(2):
            ahead = rows.select(F.col("node").alias("next"), "target", F.col("path").alias("rest"), F.col("next").alias("after"))
            rows = rows.join(ahead, ["next", "target"], "left").select(
                "node", "target", F.concat("path", F.coalesce("rest", F.array().cast("array<string>"))).alias("path"), F.col("after").alias("next"))
        rows = materialize(rows)
    paths = rows.select("node", "target", "path")
    outer = pairs.join(core, "node", "left_anti")
    onward = paths.select(F.col("node").alias("next"), "target", F.col("path").alias("rest"))
    led = outer.join(onward, ["next", "target"], "left").select(
        "node", "target", F.concat(F.array("node"), F.coalesce("rest", F.array().cast("array<string>"))).alias("path"))
    return paths.unionByName(led)


def reachable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, affected``: how many nodes each of ``nodes(id)`` reaches, itself included."""
    core = nodes.select("id").join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
    bit = F.expr("shiftleft(1L, cast(idx % 64 as int))")
    start = running_totals(core, "id", []).select(F.col("id").alias("node"), F.floor(F.col("idx") / 64).cast("long").alias("word"), bit.alias("bits"))
    inner = edges.where("inner").select("src", "dst")

    def merged(sets: DataFrame) -> DataFrame:
        onward = inner.join(sets, F.col("dst") == F.col("node")).select(F.col("src").alias("node"), "word", "bits")
        return sets.unionByName(onward).groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))

    sets = settled(start, merged)
    outer = edges.where("not inner").join(sets, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("id"), "word").agg(F.bit_or("bits").alias("bits"))
    every = sets.select(F.col("node").alias("id"), "word", "bits", F.lit(0).alias("own")).unionByName(outer.withColumn("own", F.lit(1)))
    counts = every.groupBy("id").agg((F.sum(F.bit_count("bits")) + F.max("own")).alias("n"))
    return nodes.select("id").join(counts, "id", "left").select(F.col("id").alias("node"), F.coalesce("n", F.lit(1)).cast("long").alias("affected"))


def pattern(affected: Column) -> Column:
    return F.when(affected > 1, F.lit("LATERAL_MOVEMENT")).otherwise(F.lit("DIRECT_ATTACK"))


def nearest_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, blast_radius_score, nearest_critical, path`` of the nodes that reach
    a critical one; equally near ones count by node order."""
    critical = nodes.where("critical_asset")
    found = routes(edges, critical.select("id")).join(critical.select(F.col("id").alias("target"), "node_ord"), "target")
    per = materialize(found.groupBy("node").agg(
        F.bround(F.sum(1.0 / (F.col("dist") + 1.0)), 4).alias("blast_radius_score"),
        F.min_by(F.struct("target", "next"), F.struct("dist", "node_ord")).alias("near"))
        .select("node", "blast_radius_score", F.col("near.target").alias("target"), F.col("near.next").alias("next")))
    return per.join(followed(per.select("node", "target", "next"), edges), ["node", "target"]).select(
        "node", "blast_radius_score", F.col("target").alias("nearest_critical"), "path")


def blast_radius(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """As ``graph.blast_radius``, from ``nodes(id, critical_asset, node_ord)`` and ``edges(src, dst, weight)``."""
    edges = prepared(edges)
    near = nearest_paths(nodes, edges)
    return (reachable(nodes, edges).join(near, "node", "left")
            .select("node", F.coalesce("blast_radius_score", F.lit(0.0)).alias("blast_radius_score"), F.col("affected").alias("affected_count"),
                    "nearest_critical", F.coalesce("path", F.array().cast("array<string>")).alias("path_to_nearest_critical"),
                    pattern(F.col("affected")).alias("movement_pattern")))


def simulated(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """``requests(source, target)`` with ``dist, path`` (null if there is none), from the side of the distinct targets."""
    edges = prepared(edges)
    found = materialize(routes(edges, requests.select(F.col("target").alias("id")).distinct()))
    core = edges.select(F.col("dst").alias("node")).distinct()
    asked = requests.select(F.col("source").alias("node"), "target").distinct()
    wanted = found.join(core, "node", "left_semi").unionByName(found.join(core, "node", "left_anti").join(asked, ["node", "target"], "left_semi"))
    paths = followed(wanted.select("node", "target", "next"), edges)
    return (requests.join(found.select(F.col("node").alias("source"), "target", "dist"), ["source", "target"], "left")
            .join(paths.withColumnRenamed("node", "source"), ["source", "target"], "left"))


def affected(requests: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """For each of ``requests(node)`` the nodes it reaches, nearest first (then by
    name): ``node, nth, affected_node, dist, movement_pattern``.  A node that the
    graph does not hold has one row, number 0, with the pattern UNKNOWN.  Paths are searched
    only from the core nodes that a request is or leads to."""
    asked = materialize(requests.select("node").distinct().join(nodes.select(F.col("id").alias("node"), F.lit(True).alias("known")), "node", "left"))
    known, edges = asked.where("known"), prepared(edges)
    core = edges.select(F.col("dst").alias("id")).distinct()
    ends = edges.select(F.col("src").alias("node"), F.col("dst").alias("via"), "weight")
    inside = known.join(core.withColumnRenamed("id", "node"), "node", "left_semi").select("node", F.col("node").alias("via"), F.lit(0.0).alias("weight"))
    led = known.join(core.withColumnRenamed("id", "node"), "node", "left_anti").select("node").join(ends, "node")
    first = materialize(inside.unionByName(led))
    paths = shortest_paths(nodes, edges, first.select(F.col("via").alias("id")).distinct()).select(F.col("src").alias("via"), "dst", "dist")
    reached = first.join(paths, "via").groupBy("node", F.col("dst").alias("affected_node")).agg(F.min(F.col("weight") + F.col("dist")).alias("dist"))
    itself = known.select("node", F.col("node").alias("affected_node"), F.lit(0.0).alias("dist"))
    every = reached.where("node <> affected_node").unionByName(itself)
    counts = every.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    order = F.expr("row_number() over (partition by node order by dist, affected_node)")
    listed = every.withColumn("nth", order).join(counts, "node").select("node", "nth", "affected_node", "dist", pattern(F.col("n")).alias("movement_pattern"))
    nothing = asked.where("known is null").select("node", F.lit(0).alias("nth"), F.lit(None).cast("string").alias("affected_node"), F.lit(0.0).alias("dist"),
                                                  F.lit("UNKNOWN").alias("movement_pattern"))
    return listed.unionByName(nothing)


def marked(paths: DataFrame, links: DataFrame) -> DataFrame:
    """The hops of ``paths(path)`` against the ``links(src, dst, protocol)`` on
    display, by one full outer join on both ends: ``MARKED`` links lie on a path,
    ``PLAIN`` ones do not, ``ADDED`` hops have no link; with the number of paths."""
    ends = F.transform(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), lambda x, i: F.struct(x.alias("src"), F.get("path", i + 1).alias("dst")))
    hops = paths.select(F.explode(ends).alias("h")).groupBy("h.src", "h.dst").agg(F.count(F.lit(1)).alias("n_paths"))
    shown = links.groupBy("src", "dst").agg(F.min("protocol").alias("protocol")).withColumn("shown", F.lit(True))
    outcome = F.when(F.col("shown").isNull(), F.lit("ADDED")).when(F.col("n_paths").isNull(), F.lit("PLAIN")).otherwise(F.lit("MARKED"))
    return hops.join(shown, ["src", "dst"], "full_outer").select("src", "dst", "protocol", outcome.alias("outcome"), F.coalesce("n_paths", F.lit(0)).cast("long").alias("n_paths"))
