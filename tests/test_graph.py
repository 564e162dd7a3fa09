import pytest
from pyspark.sql import functions as F

from vigil.operators import graph as G
from vigil.sources.topology import builtin_topology

EXPECTED = {
    "INTERNET_GW": (0.1742, 16), "FIREWALL_1": (0.2679, 13), "WEB_SERVER": (0.45, 12), "APP_SERVER": (0.8333, 11),
    "JUMP_BOX": (0.8333, 12), "DOMAIN_CTRL": (1.1429, 11), "DB_PROD": (1.0, 1), "SIEM_SERVER": (0.3095, 12),
    "WS_1": (0.45, 11), "WS_5": (0.45, 11), "BACKUP_SERVER": (0.0, 1), "HONEYPOT_1": (0.0, 1),
}


@pytest.fixture(scope="module")
def topo(spark):
    nodes, edges = builtin_topology(spark)
    paths = G.shortest_paths(nodes, edges)
    return nodes, edges, paths


def test_pair_count(topo):
    assert topo[2].count() == 148


def test_blast_radius(topo):
    nodes, _, paths = topo
    got = {r.node: r for r in G.blast_radius(nodes, paths).collect()}
    for node, (score, affected) in EXPECTED.items():
        assert got[node].blast_radius_score == pytest.approx(score), node
        assert got[node].affected_count == affected, node
    assert got["INTERNET_GW"].path_to_nearest_critical == ["INTERNET_GW", "FIREWALL_1", "WEB_SERVER", "APP_SERVER", "DB_PROD"]
    assert got["DOMAIN_CTRL"].path_to_nearest_critical == ["DOMAIN_CTRL"]
    assert got["DB_PROD"].movement_pattern == "DIRECT_ATTACK"
    assert got["WEB_SERVER"].movement_pattern == "LATERAL_MOVEMENT"


def test_simulate(spark, topo):
    nodes, _, paths = topo
    req = spark.createDataFrame([("INTERNET_GW", "DB_PROD"), ("NOPE", "DB_PROD"), ("DB_PROD", "INTERNET_GW")],
                                "source string, target string")
    got = {(r.source, r.target): r for r in G.simulate_paths(req, nodes, paths).collect()}
    assert got[("INTERNET_GW", "DB_PROD")].hops == 4
    assert got[("INTERNET_GW", "DB_PROD")].risk_exposure == 0.0
    assert got[("NOPE", "DB_PROD")].hops == 0 and got[("NOPE", "DB_PROD")].path == []
    assert got[("DB_PROD", "INTERNET_GW")].risk_exposure == 0.0


def test_critical_side_distances_match(spark, topo):
    nodes, edges, paths = topo
    d = G.critical_distances(nodes, edges)
    scores = {r.node: r.s for r in d.groupBy("node").agg(F.bround(F.sum(1.0 / (F.col("dist") + 1.0)), 4).alias("s")).collect()}
    assert scores["INTERNET_GW"] == pytest.approx(0.1742)
    assert scores["DOMAIN_CTRL"] == pytest.approx(1.1429)


def test_graphml_roundtrip(spark, topo):
    import tempfile
    from vigil.sources.topology import read_graphml, write_graphml
    nodes, edges, _ = topo
    path = tempfile.mkdtemp(prefix="vigil-graphml-") + "/g"
    write_graphml(nodes, edges, path)
    n2, e2 = read_graphml(spark, path)
    assert n2.count() == 18 and e2.count() == 23
    assert sorted(r.id for r in n2.where("critical_asset").collect()) == ["DB_PROD", "DOMAIN_CTRL"]
    from vigil.operators import graph as G
    assert G.shortest_paths(n2, e2).count() == 148
