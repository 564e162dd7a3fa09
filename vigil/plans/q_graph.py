"""Graph queries over the topology derived from customer / supplier / nation / region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import exposure as X
from vigil.operators import graph as G
from vigil.plans.common import table
from vigil.sources import dims
from vigil.sources.topology import derived_topology, with_node_order


def _topo(spark, sf_dir):
    nodes, edges = derived_topology(spark, sf_dir)
    return with_node_order(nodes), edges


def _paths(spark, sf_dir):
    nodes, edges = _topo(spark, sf_dir)
    return nodes, edges, G.shortest_paths(nodes, edges)


def graph_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, p = _paths(spark, sf_dir)
    return p.select("src", "dst", "dist", "hops", F.array_join("path", ">").alias("path"))


def blast_radius_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.blast_radius(*_topo(spark, sf_dir))
    return b.select("node", "blast_radius_score", "affected_count", "nearest_critical",
                    F.array_join("path_to_nearest_critical", ">").alias("path_to_nearest_critical"),
                    "movement_pattern")


def critical_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores-only blast radius: distances computed from the critical side."""
    nodes, edges = _topo(spark, sf_dir)
    d = G.critical_distances(nodes, edges)
    return d.groupBy("node").agg(F.count(F.lit(1)).alias("n_critical_reachable"),
                                 F.bround(F.sum(1.0 / (F.col("dist") + 1.0)), 4).alias("blast_radius_score"))


def _requests(spark, sf_dir) -> DataFrame:
    """A path request per customer and order segment; every 97th order asks for an unknown target."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("C:"), F.col("o_custkey").cast("string")).alias("source"),
                    F.when(F.col("o_orderkey") % 97 == 0, F.lit("N:unknown"))
                     .otherwise(F.concat(F.lit("N:"), (F.col("o_orderkey") % 25).cast("string"))).alias("target")).distinct()


def attack_path_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = _topo(spark, sf_dir)
    s = G.risk_of_paths(X.simulated(_requests(spark, sf_dir), edges))
    return s.select("source", "target", "hops", F.array_join("path", ">").alias("path"), "risk_exposure")


def affected_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that each customer with orders reaches, in order, and the row
    of an unknown node: customers of every 97th order are asked for by a name
    that the graph does not hold."""
    nodes, edges = _topo(spark, sf_dir)
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.when(F.col("o_orderkey") % 97 == 0, F.lit("X:")).otherwise(F.lit("C:")), F.col("o_custkey").cast("string"))
    return X.affected(o.select(name.alias("node")), nodes, edges)


def path_marking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links on display, marked where a path to the nearest critical node
    runs; the display leaves out SSH links, which paths add."""
    nodes, edges = _topo(spark, sf_dir)
    paths = X.nearest_paths(nodes, X.prepared(edges))
    return X.marked(paths, edges.where("protocol <> 'SSH'"))


def topology_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _topo(spark, sf_dir)
    return G.listing(nodes, edges)


def critical_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _topo(spark, sf_dir)
    return G.critical_list(nodes)


def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _topo(spark, sf_dir)
    return G.graph_summary(nodes, edges, dims.DISPLAY_CRITICAL_TYPES)


def path_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges on each node's path to its nearest critical node, with protocol
    (path hops are consecutive pairs of the path; every hop is a graph edge)."""
    nodes, edges = _topo(spark, sf_dir)
    b = X.nearest_paths(nodes, X.prepared(edges)).where(F.size("path") > 1)
    path = F.col("path")
    pairs = F.transform(F.slice(path, 1, F.size(path) - 1), lambda x, i: F.struct((i + 1).alias("hop"), x.alias("hop_src"), F.get(path, i + 1).alias("hop_dst")))
    hops = b.select("node", F.explode_outer(pairs).alias("h")).select("node", "h.hop", "h.hop_src", "h.hop_dst")
    e = edges.select(F.col("src").alias("hop_src"), F.col("dst").alias("hop_dst"), "protocol", "weight")
    return hops.join(e, ["hop_src", "hop_dst"], "left").select("node", "hop", "hop_src", "hop_dst", "protocol", "weight")


def graphml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived topology → GraphML elements in the shared folder → XML reader →
    per edge protocol and node type: counts, weights and critical flags."""
    from vigil.session import shared_path
    from vigil.sources.topology import read_graphml, write_graphml
    nodes, edges = derived_topology(spark, sf_dir)
    path = shared_path(spark, "graphml")
    write_graphml(nodes, edges, path)
    n, e = read_graphml(spark, path)
    ek = e.groupBy(F.lit("edge").alias("kind"), F.col("protocol").alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total"))
    nk = n.groupBy(F.lit("node").alias("kind"), F.col("node_type").alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("critical_asset").cast("double")).alias("total"))
    return ek.unionByName(nk)


QUERIES = {
    "graphml_roundtrip": graphml_roundtrip,
    "path_edges": path_edges,
    "graph_paths": graph_paths,
    "blast_radius_nodes": blast_radius_nodes,
    "critical_exposure": critical_exposure,
    "attack_path_sim": attack_path_sim,
    "graph_summary": graph_summary,
    "affected_nodes": affected_nodes,
    "path_marking": path_marking,
    "topology_listing": topology_listing,
    "critical_list": critical_list,
}

_TOPO = """
nodes AS (
  SELECT 'C:' || CAST(c_custkey AS VARCHAR) AS id, 'WORKSTATION' AS node_type, false AS critical_asset FROM customer
  UNION ALL SELECT 'S:' || CAST(s_suppkey AS VARCHAR), 'DATABASE', s_acctbal > 9000.0 FROM supplier
  UNION ALL SELECT 'N:' || CAST(n_nationkey AS VARCHAR), 'SERVER', r.r_name IS NOT NULL
    FROM nation LEFT JOIN (SELECT * FROM region WHERE r_name = 'ASIA') r ON n_regionkey = r.r_regionkey
  UNION ALL SELECT 'R:' || CAST(r_regionkey AS VARCHAR), 'DOMAIN_CONTROLLER', r_name = 'EUROPE' FROM region
),
edges AS (
  SELECT 'C:' || CAST(c_custkey AS VARCHAR) AS src, 'N:' || CAST(c_nationkey AS VARCHAR) AS dst, CAST(c_custkey % 3 + 1 AS DOUBLE) AS weight FROM customer
  UNION ALL SELECT 'S:' || CAST(s_suppkey AS VARCHAR), 'N:' || CAST(s_nationkey AS VARCHAR), CAST(s_suppkey % 4 + 1 AS DOUBLE) FROM supplier
  UNION ALL SELECT 'N:' || CAST(n_nationkey AS VARCHAR), 'R:' || CAST(n_regionkey AS VARCHAR), 2.0 FROM nation
  UNION ALL SELECT 'R:' || CAST(n_regionkey AS VARCHAR), 'N:' || CAST(n_nationkey AS VARCHAR), 3.0 FROM nation
  UNION ALL SELECT 'R:' || CAST(r_regionkey AS VARCHAR), 'R:' || CAST((r_regionkey + 1) % (SELECT count(*) FROM region) AS VARCHAR), 4.0 FROM region
)"""
_WALK = "WITH RECURSIVE " + _TOPO.strip() + """,
walk(src, dst, dist, path) AS (
  SELECT id, id, CAST(0.0 AS DOUBLE), [id] FROM nodes
  UNION ALL
  SELECT w.src, e.dst, w.dist + e.weight, list_append(w.path, e.dst)
  FROM walk w JOIN edges e ON w.dst = e.src WHERE NOT list_contains(w.path, e.dst)
),
best AS (
  SELECT * FROM (
    SELECT src, dst, dist, path, row_number() OVER (PARTITION BY src, dst ORDER BY dist, array_to_string(path, '>')) AS rn
    FROM walk) WHERE rn = 1
)"""

ORACLE = {
    "graphml_roundtrip": "WITH " + _TOPO.strip() + """,
pe AS (SELECT src, dst, weight, CASE WHEN src LIKE 'C:%' THEN 'SMB' WHEN src LIKE 'S:%' THEN 'DB'
                                     WHEN src LIKE 'N:%' THEN 'RDP' WHEN dst LIKE 'N:%' THEN 'RDP' ELSE 'SSH' END AS protocol FROM edges)
SELECT 'edge' AS kind, protocol AS key, count(*) AS n, sum(weight) AS total FROM pe GROUP BY ALL
UNION ALL
SELECT 'node', node_type, count(*), sum(CASE WHEN critical_asset THEN 1.0 ELSE 0.0 END) FROM nodes GROUP BY ALL""",
    "path_edges": _WALK + """,
cp AS (SELECT b.* FROM best b JOIN nodes n ON b.dst = n.id AND n.critical_asset),
near AS (SELECT src, arg_min(path, (dist, dst)) AS path FROM cp GROUP BY 1),
hops AS (SELECT src AS node, i AS hop, path[i] AS hop_src, path[i + 1] AS hop_dst
         FROM (SELECT src, path, generate_subscripts(path, 1) AS i FROM near WHERE len(path) > 1) WHERE i < len(path)),
pe AS (SELECT src, dst, weight, CASE WHEN src LIKE 'C:%' THEN 'SMB' WHEN src LIKE 'S:%' THEN 'DB'
                                     WHEN src LIKE 'N:%' THEN 'RDP' WHEN dst LIKE 'N:%' THEN 'RDP' ELSE 'SSH' END AS protocol FROM edges)
SELECT h.node, CAST(h.hop AS INTEGER) AS hop, h.hop_src, h.hop_dst, pe.protocol, pe.weight
FROM hops h LEFT JOIN pe ON pe.src = h.hop_src AND pe.dst = h.hop_dst""",
    "graph_paths": _WALK + """
SELECT src, dst, dist, CAST(len(path) - 1 AS INTEGER) AS hops, array_to_string(path, '>') AS path FROM best""",
    "blast_radius_nodes": _WALK + """,
reach AS (SELECT src, count(*) AS affected FROM best GROUP BY 1),
cp AS (SELECT b.* FROM best b JOIN nodes n ON b.dst = n.id AND n.critical_asset),
per AS (SELECT src, round_even(sum(1.0 / (dist + 1.0)), 4) AS score,
          arg_min(dst, (dist, dst)) AS near, arg_min(array_to_string(path, '>'), (dist, dst)) AS near_path
        FROM cp GROUP BY 1)
SELECT n.id AS node, coalesce(per.score, 0.0) AS blast_radius_score, CAST(coalesce(reach.affected, 0) AS BIGINT) AS affected_count,
  per.near AS nearest_critical, coalesce(per.near_path, '') AS path_to_nearest_critical,
  CASE WHEN coalesce(reach.affected, 0) > 1 THEN 'LATERAL_MOVEMENT' ELSE 'DIRECT_ATTACK' END AS movement_pattern
FROM nodes n LEFT JOIN reach ON reach.src = n.id LEFT JOIN per ON per.src = n.id""",
    "critical_exposure": _WALK + """
SELECT b.src AS node, count(*) AS n_critical_reachable, round_even(sum(1.0 / (b.dist + 1.0)), 4) AS blast_radius_score
FROM best b JOIN nodes n ON b.dst = n.id AND n.critical_asset GROUP BY 1""",
    "attack_path_sim": _WALK + """,
req AS (SELECT DISTINCT 'C:' || CAST(o_custkey AS VARCHAR) AS source,
          CASE WHEN o_orderkey % 97 = 0 THEN 'N:unknown' ELSE 'N:' || CAST(o_orderkey % 25 AS VARCHAR) END AS target FROM orders)
SELECT r.source, r.target,
  CAST(CASE WHEN b.dist IS NULL THEN 0 ELSE greatest(len(b.path) - 1, 0) END AS INTEGER) AS hops,
  CASE WHEN b.dist IS NULL THEN '' ELSE array_to_string(b.path, '>') END AS path,
  CASE WHEN b.dist IS NULL THEN 0.0 ELSE round_even(greatest(0.0, 100.0 - b.dist * 10.0), 2) END AS risk_exposure
FROM req r LEFT JOIN best b ON b.src = r.source AND b.dst = r.target""",
    "affected_nodes": _WALK + """,
req AS (SELECT DISTINCT CASE WHEN o_orderkey % 97 = 0 THEN 'X:' ELSE 'C:' END || CAST(o_custkey AS VARCHAR) AS node FROM orders)
SELECT r.node, CASE WHEN b.src IS NULL THEN 0 ELSE CAST(row_number() OVER (PARTITION BY r.node ORDER BY b.dist, b.dst) AS INTEGER) END AS nth,
  b.dst AS affected_node, coalesce(b.dist, 0.0) AS dist, CASE WHEN b.src IS NULL THEN 'UNKNOWN' WHEN count(b.src) OVER (PARTITION BY r.node) > 1 THEN 'LATERAL_MOVEMENT' ELSE 'DIRECT_ATTACK' END AS movement_pattern
FROM req r LEFT JOIN best b ON b.src = r.node""",
    "path_marking": _WALK + """,
cp AS (SELECT b.* FROM best b JOIN nodes n ON b.dst = n.id AND n.critical_asset),
near AS (SELECT src, arg_min(path, (dist, dst)) AS path FROM cp GROUP BY 1),
hops AS (SELECT path[i] AS src, path[i + 1] AS dst, count(*) AS n FROM (SELECT path, generate_subscripts(path, 1) AS i FROM near WHERE len(path) > 1) WHERE i < len(path) GROUP BY ALL),
pe AS (SELECT src, dst, CASE WHEN src LIKE 'C:%' THEN 'SMB' WHEN src LIKE 'S:%' THEN 'DB'
                             WHEN src LIKE 'N:%' THEN 'RDP' WHEN dst LIKE 'N:%' THEN 'RDP' ELSE 'SSH' END AS protocol FROM edges),
shown AS (SELECT * FROM pe WHERE protocol <> 'SSH')
SELECT coalesce(h.src, s.src) AS src, coalesce(h.dst, s.dst) AS dst, s.protocol,
  CASE WHEN s.src IS NULL THEN 'ADDED' WHEN h.src IS NULL THEN 'PLAIN' ELSE 'MARKED' END AS outcome, coalesce(h.n, 0) AS n_paths
FROM hops h FULL OUTER JOIN shown s ON h.src = s.src AND h.dst = s.dst""",
    "topology_listing": "WITH " + _TOPO.strip() + """
SELECT 'node' AS kind, id AS source, NULL AS target, id AS label, node_type AS detail FROM nodes
UNION ALL
SELECT 'edge', src, dst, NULL, CASE WHEN src LIKE 'C:%' THEN 'SMB' WHEN src LIKE 'S:%' THEN 'DB'
                                    WHEN src LIKE 'N:%' THEN 'RDP' WHEN dst LIKE 'N:%' THEN 'RDP' ELSE 'SSH' END FROM edges""",
    "critical_list": "WITH " + _TOPO.strip() + """
SELECT row_number() OVER (ORDER BY id) AS nth, id AS node, node_type FROM nodes WHERE critical_asset""",
    "graph_summary": "WITH " + _TOPO.strip() + f"""
SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM edges) AS total_edges,
  (SELECT count(*) FROM nodes WHERE critical_asset) AS n_critical,
  (SELECT count(*) FROM nodes WHERE node_type IN ({', '.join("'" + t + "'" for t in dims.DISPLAY_CRITICAL_TYPES)})) AS display_critical""",
}
