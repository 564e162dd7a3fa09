import math
import random
import re

import numpy as np
import pytest

from vigil.llm import ranked_search as R

DOCS, ITEMS = "doc_id long, text string, term string, rank string", "item_id long, text string, score string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute(docs, items, k=10):
    """The contract's formulas, document by document."""
    rows = [(d, TERM.findall(lower(t))) for d, t in docs]
    rows = [(d, ts) for d, ts in rows if ts]
    n_docs, total = len(rows), sum(len(ts) for _, ts in rows)
    out = []
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(TERM.findall(lower(t)))
    for i, ts in wanted.items():
        scored = []
        for d, words in rows:
            m, s = 100 - 90 + (90 * len(words) * n_docs) // total, 0
            for t in ts:
                df, tf = sum(t in set(w) for _, w in rows), words.count(t)
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def got(spark, docs, items, **more):
    found = R.ranked(spark.createDataFrame([(d, t, "", "") for d, t in docs], DOCS).repartition(3), spark.createDataFrame([(i, t, "") for i, t in items], ITEMS), **more)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted([tuple(r) for r in found.collect()], key=str)


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Été", "ÜBER", "x1", "日本"]
    draw = lambda size: " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=size))
    docs = [(i, draw(rng.randint(1, 30))) for i in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(25)]  # copies tie
    return docs, [(i, draw(rng.randint(1, 9)) + rng.choice(["", " unknown", "-W3!"])) for i in range(12)]


@pytest.mark.parametrize("leaf, tree, block", [(4, 1 << 20, 1 << 17), (8, 100, 10), (1, 1 << 20, 1 << 17)])
def test_equals_brute_force(spark, monkeypatch, leaf, tree, block):
    monkeypatch.setattr(R, "LEAF", leaf)
    monkeypatch.setattr(R, "TREE_TERMS", tree)
    docs, items = corpus(leaf)
    assert got(spark, docs, items, block_terms=block) == brute(docs, items)


def test_defined_results(spark):
    docs = [(5, "alpha beta"), (None, "alpha beta"), (3, "alpha beta"), (3, "Alpha, beta"), (1, None), (2, ""), (4, "-- !!"), (6, "gamma " * 5000 + "alpha"), (7, "delta")]
    items = [(1, "ALPHA"), (1, "beta beta"), (2, "nothing here"), (3, ""), (4, None), (None, "gammaé gamma")]
    assert got(spark, docs, items) == brute(docs, items)
    assert [r[2] for r in sorted(got(spark, docs, [(1, "beta")]), key=lambda r: r[1])] == [3, 3, 5, None]
    assert got(spark, [], items) == [] and got(spark, docs, []) == [] and got(spark, [(1, None)], [(1, "a")]) == []


def tree_of(docs, words):
    number = {w: i for i, w in enumerate(words)}
    vectors = [sorted((number[w], ts.count(w)) for w in set(ts)) for ts in docs]
    sizes = np.array([len(v) for v in vectors])
    flat = np.array([e for v in vectors for e in v])
    m = R.length_part(np.array([len(ts) for ts in docs]), len(docs), sum(map(len, docs)))
    weights = np.arange(len(words), 0, -1) * 100
    return R.Tree(np.arange(len(docs)), m, flat[:, 0], flat[:, 1], sizes, weights)


def test_bounds_hold_and_leave_subtrees_out(monkeypatch):
    monkeypatch.setattr(R, "LEAF", 8)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    docs = [rng.choices(words, [i + 1 for i in range(60)], k=rng.randint(2, 40)) for _ in range(600)] + [["w0", "w1"]] * 30
    tree = tree_of(docs, words)
    nodes, leaves = [tree.root], []
    while nodes:
        node = nodes.pop()
        item = np.array([0, 1, 20, 59])
        here = np.isin(tree.numbers, item) * tree.adds
        scores = np.array([here[tree.starts[d]:tree.starts[d + 1]].sum() for d in range(node.low, node.high)])
        assert node.bound(item) >= scores.max()
        if node.children:
            assert [c.low for c in node.children[1:]] == [c.high for c in node.children[:-1]]
            assert (node.children[0].low, node.children[-1].high) == (node.low, node.high)
            nodes += node.children
        else:
            assert node.scores(item).tolist() == scores.tolist()
            leaves.append(node)
    assert sum(leaf.high - leaf.low for leaf in leaves) == 630 and any(leaf.high - leaf.low == 30 for leaf in leaves)
    found, scored = tree.best(np.array([0, 1, 5]), 10)
    assert len(found) == 10 and scored < 400


def test_lengths_beyond_a_long():
    n = np.array([1 << 40, 3])
    assert R.length_part(n, 1 << 40, 1 << 50).tolist() == [10 + 90 * (1 << 30), 10]
