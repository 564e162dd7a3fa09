"""Infrastructure graphs as (nodes, edges) tables.

``builtin_topology`` is the fixed 18-node corporate network.  ``derived_topology``
builds a graph that grows with the test tables: customers and suppliers are
hosts attached to their nation's segment, nations hang off their region's
core, regions form a ring.  Critical assets: the EUROPE core, the ASIA
segments and suppliers with a balance above 9000.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.sources import dims

CRITICAL_REGION = "EUROPE"
CRITICAL_SEGMENT_REGION = "ASIA"
CRITICAL_SUPPLIER_BALANCE = 9000.0


def builtin_topology(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return dims.topology_nodes(spark), dims.topology_edges(spark)


def derived_topology(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rd = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    cust, supp, nat, reg = rd("customer"), rd("supplier"), rd("nation"), rd("region")
    cid = F.concat(F.lit("C:"), F.col("c_custkey").cast("string"))
    sid = F.concat(F.lit("S:"), F.col("s_suppkey").cast("string"))
    nid = lambda c: F.concat(F.lit("N:"), F.col(c).cast("string"))
    rid = lambda c: F.concat(F.lit("R:"), F.col(c).cast("string"))
    crit_regions = reg.where(F.col("r_name") == CRITICAL_SEGMENT_REGION).select(F.col("r_regionkey").alias("crk"))
    nations = (nat.join(crit_regions, F.col("n_regionkey") == F.col("crk"), "left")
               .select(nid("n_nationkey").alias("id"), F.lit("SERVER").alias("node_type"),
                       F.col("crk").isNotNull().alias("critical_asset")))
    nodes = (cust.select(cid.alias("id"), F.lit("WORKSTATION").alias("node_type"), F.lit(False).alias("critical_asset"))
             .unionByName(supp.select(sid.alias("id"), F.lit("DATABASE").alias("node_type"),
                                      (F.col("s_acctbal") > CRITICAL_SUPPLIER_BALANCE).alias("critical_asset")))
             .unionByName(nations)
             .unionByName(reg.select(rid("r_regionkey").alias("id"), F.lit("DOMAIN_CONTROLLER").alias("node_type"),
                                     (F.col("r_name") == CRITICAL_REGION).alias("critical_asset"))))
    nreg = reg.count()
    edges = (cust.select(cid.alias("src"), nid("c_nationkey").alias("dst"),
                         (F.col("c_custkey") % 3 + 1).cast("double").alias("weight"), F.lit("SMB").alias("protocol"))
             .unionByName(supp.select(sid.alias("src"), nid("s_nationkey").alias("dst"),
                                      (F.col("s_suppkey") % 4 + 1).cast("double").alias("weight"), F.lit("DB").alias("protocol")))
             .unionByName(nat.select(nid("n_nationkey").alias("src"), rid("n_regionkey").alias("dst"),
                                     F.lit(2.0).alias("weight"), F.lit("RDP").alias("protocol")))
             .unionByName(nat.select(rid("n_regionkey").alias("src"), nid("n_nationkey").alias("dst"),
                                     F.lit(3.0).alias("weight"), F.lit("RDP").alias("protocol")))
             .unionByName(reg.select(rid("r_regionkey").alias("src"),
                                     F.concat(F.lit("R:"), ((F.col("r_regionkey") + 1) % F.lit(nreg)).cast("string")).alias("dst"),
                                     F.lit(4.0).alias("weight"), F.lit("SSH").alias("protocol"))))
    return nodes, edges


def with_node_order(nodes: DataFrame) -> DataFrame:
    """Stable node order for tie-breaks: the id itself (lexicographic)."""
    return nodes.withColumn("node_ord", F.col("id"))


GRAPHML_ROW_SCHEMA = {
    "node": "_id string, data array<struct<_VALUE:string,_key:string>>",
    "edge": "_source string, _target string, data array<struct<_VALUE:string,_key:string>>",
}


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Write GraphML ``<node>`` / ``<edge>`` elements with Spark's XML writer
    (``_``-prefixed columns become attributes, ``<data key=…>`` children carry
    the values); each task writes its own well-formed file, no single-file
    funnel.  Read back with :func:`read_graphml`."""
    def data(key, col):
        return F.struct(col.cast("string").alias("_VALUE"), F.lit(key).alias("_key"))
    n = nodes.select(F.col("id").alias("_id"),
                     F.array(data("node_type", F.col("node_type")),
                             data("critical_asset", F.lower(F.col("critical_asset").cast("string")))).alias("data"))
    e = edges.select(F.col("src").alias("_source"), F.col("dst").alias("_target"),
                     F.array(data("weight", F.col("weight")), data("protocol", F.col("protocol"))).alias("data"))
    n.write.format("xml").option("rootTag", "graph").option("rowTag", "node").save(f"{path}/nodes")
    e.write.format("xml").option("rootTag", "graph").option("rowTag", "edge").save(f"{path}/edges")


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """GraphML elements → nodes(id, node_type, critical_asset), edges(src, dst, weight, protocol)."""
    def attr(key):
        return F.get(F.filter("data", lambda d: d["_key"] == key), 0)["_VALUE"]
    rd = lambda tag: (spark.read.format("xml").option("rowTag", tag).option("recursiveFileLookup", "true")
                      .schema(GRAPHML_ROW_SCHEMA[tag]).load(path))
    rn, re_ = rd("node"), rd("edge")
    nodes = rn.select(F.col("_id").alias("id"), attr("node_type").alias("node_type"),
                      (F.lower(attr("critical_asset")) == "true").alias("critical_asset"))
    edges = re_.select(F.col("_source").alias("src"), F.col("_target").alias("dst"),
                       attr("weight").cast("double").alias("weight"), attr("protocol").alias("protocol"))
    return nodes, edges
