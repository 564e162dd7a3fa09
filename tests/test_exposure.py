import heapq
import random

import pytest

from vigil.operators import exposure as X
from vigil.operators import graph as G
from vigil.sources.topology import builtin_topology, with_node_order

NODES, EDGES = "id string, critical_asset boolean, node_ord string", "src string, dst string, weight double, protocol string"


def dijkstra(edges, source):
    """Distance and least path text to each node that ``source`` reaches."""
    best, heap = {}, [(0.0, source, (source,))]
    while heap:
        d, text, path = heapq.heappop(heap)
        if path[-1] in best:
            continue
        best[path[-1]] = (d, path)
        for s, t, w, _ in edges:
            if s == path[-1] and t not in best:
                heapq.heappush(heap, (d + w, text + ">" + t, (*path, t)))
    return best


def drawn(seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(26)]
    nodes = [(n, rng.random() < 0.2, n) for n in names]
    edges = {(a, b): float(rng.randint(1, 3)) for a, b in (rng.sample(names[4:], 2) for _ in range(45))}
    edges |= {(a, rng.choice(names[4:])): 1.0 for a in names[:4]}  # hosts that nothing leads to
    edges |= {("n9", "n9"): 1.0}
    return nodes, [(a, b, w, "SSH" if w == 3 else "DB") for (a, b), w in edges.items()] + [("n5", "n6", 9.0, "DB")]


@pytest.mark.parametrize("seed", [1, 2])
def test_blast_radius_equals_a_plain_search(spark, seed):
    rows, links = drawn(seed)
    nodes, edges = spark.createDataFrame(rows, NODES), spark.createDataFrame(links, EDGES)
    critical = {n for n, c, _ in rows if c}
    got = {r.node: r for r in X.blast_radius(nodes, edges).collect()}
    assert len(got) == len(rows)
    for n, _, _ in rows:
        best = dijkstra(links, n)
        near = min(((best[c][0], c) for c in critical if c in best), default=None)
        r = got[n]
        assert r.blast_radius_score == pytest.approx(sum(1 / (best[c][0] + 1) for c in critical if c in best), abs=6e-5)
        assert (r.affected_count, r.nearest_critical) == (len(best), near and near[1])
        assert r.path_to_nearest_critical == (list(best[near[1]][1]) if near else [])
        assert r.movement_pattern == ("LATERAL_MOVEMENT" if len(best) > 1 else "DIRECT_ATTACK")


def test_routes_to_any_targets_and_reached_nodes(spark):
    rows, links = drawn(3)
    nodes, edges = spark.createDataFrame(rows, NODES), spark.createDataFrame(links, EDGES)
    asked = [(s, t) for s in ("n0", "n1", "n7", "n8", "gone") for t in ("n0", "n5", "n11", "n7", "nowhere")]
    got = {(r.source, r.target): r for r in X.simulated(spark.createDataFrame(asked, "source string, target string"), edges).collect()}
    known = {n for n, *_ in rows}
    for s, t in asked:
        best = dijkstra(links, s).get(t) if s in known and t in known else None
        assert (got[s, t].dist, got[s, t].path) == ((best[0], list(best[1])) if best else (None, None)), (s, t)
    listed = X.affected(spark.createDataFrame([("n0",), ("n7",), ("n7",), ("gone",)], "node string"), nodes, edges).collect()
    for s in ("n0", "n7"):
        want = sorted((d, t) for t, (d, _) in dijkstra(links, s).items())
        assert [(r.dist, r.affected_node) for r in sorted((r for r in listed if r.node == s), key=lambda r: r.nth)] == want
    assert [(r.nth, r.affected_node, r.movement_pattern) for r in listed if r.node == "gone"] == [(0, None, "UNKNOWN")]


def test_the_built_in_topology_gives_the_same_as_all_pairs(spark):
    nodes, edges = builtin_topology(spark)
    one = sorted(map(tuple, X.blast_radius(nodes, edges).collect()), key=str)
    assert one == sorted(map(tuple, G.blast_radius(nodes, G.shortest_paths(nodes, edges)).collect()), key=str) and len(one) == 18
    listing = G.listing(nodes, edges)
    assert listing.where("kind = 'node'").count() == 18 and listing.where("kind = 'edge'").count() == 23
    numbers = [(r.nth, r.node) for r in G.critical_list(with_node_order(nodes.drop("node_ord"))).orderBy("nth").collect()]
    assert numbers == list(enumerate(sorted(r.id for r in nodes.where("critical_asset").collect()), 1))


def test_marked_links(spark):
    paths = spark.createDataFrame([(["a", "b", "c"],), (["b", "c"],), (["c"],), ([],)], "path array<string>")
    links = spark.createDataFrame([("a", "b", "DB"), ("x", "y", "RDP"), ("c", "b", "DB")], "src string, dst string, protocol string")
    got = {(r.src, r.dst): (r.protocol, r.outcome, r.n_paths) for r in X.marked(paths, links).collect()}
    assert got == {("a", "b"): ("DB", "MARKED", 1), ("b", "c"): (None, "ADDED", 2), ("x", "y"): ("RDP", "PLAIN", 0), ("c", "b"): ("DB", "PLAIN", 0)}


def test_an_empty_graph(spark):
    nodes, edges = spark.createDataFrame([("a", True, "a"), ("b", False, "b")], NODES), spark.createDataFrame([], EDGES)
    got = {r.node: (r.blast_radius_score, r.affected_count, r.nearest_critical) for r in X.blast_radius(nodes, edges).collect()}
    assert got == {"a": (1.0, 1, "a"), "b": (0.0, 1, None)}
    assert X.blast_radius(nodes.limit(0), edges).count() == 0
