import random
import re

import numpy as np
import pytest

from vigil.llm import ngram_join as J
from vigil.llm.components import connected


def brute(rows, n, num, den):
    sets = []
    for d, t in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        sets.append((d, {tuple(w)} if 0 < len(w) < n else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}))
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((d, len(x), find(d)) for d, x in sets)


def corpus(seed, hot):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(400)] + ["é", "the", "THE"]
    rows, texts = [], []
    for _ in range(60):
        base = rng.choices(words, k=rng.choice([1, 2, 3, 4, 8, 15, 30, 60, 150, 300]))
        texts.append(base)
        for _ in range(rng.choice([0, 1, 3, 8])):
            near = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                at = rng.randrange(len(near))
                near[at:at + rng.choice([0, 1])] = [rng.choice(words)] if rng.random() < 0.7 else []
                near = near or ["x"]
            texts.append(near)
    base = rng.choices(words, k=80)
    for i in range(hot):  # copies with one word changed: alike to the base, less so to each other
        near = list(base)
        near[i % 80] = f"new{i}"
        texts.append(near)
    texts.append(base)
    rows = [(d, " ".join(t)) for d, t in zip(rng.sample(range(5000), len(texts)), texts, strict=True)]
    return rows + [(6000, None), (6001, ""), (6002, " \n\t"), (6003, "a b"), (6004, "A  B"), (6005, "rep " * 3000), (6006, "rep " * 2999)]


@pytest.mark.parametrize(("n", "num", "den", "seed", "hot"), [(3, 90, 100, 1, 60), (5, 80, 100, 2, 40)])
def test_against_all_pairs(spark, n, num, den, seed, hot):
    rows = corpus(seed, hot)
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, cls string").repartition(3)
    got = sorted(tuple(r) for r in J.jaccard_components(df, n, num, den).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(rows, n, num, den)


def test_similar_sets_share_a_probed_key():
    """The pigeonhole bound itself: whichever of two similar sets is larger probes a key of the other."""
    rng = np.random.default_rng(4)
    for num, den in ((90, 100), (80, 100)):
        rule = J.Partitioning(num, den)
        for _ in range(400):
            a = int(rng.integers(2, 400))
            x = rng.integers(0, 1 << 63, size=a, dtype=np.uint64)
            drop, add = int(rng.integers(0, a // 8 + 1)), int(rng.integers(0, a // 8 + 1))
            y = np.unique(np.concatenate([x[drop:], rng.integers(0, 1 << 63, size=add, dtype=np.uint64)]))
            x = np.unique(x)
            both = len(np.intersect1d(x, y))
            if den * both < num * (len(x) + len(y) - both) or (len(x) == len(y) == both):
                continue
            big, small = (x, y) if len(x) >= len(y) else (y, x)
            keys, probed = rule.signatures(big)
            others, _ = rule.signatures(small)
            assert np.isin(keys[probed], others).any()


def test_nulls_repeats_and_empty(spark):
    schema = "doc_id long, text string, key string"
    rows = [(None, "one two three four", ""), (4, "one two three four", ""), (4, "one two three four", ""), (None, None, ""), (9, "other words entirely here", "")]
    got = [tuple(r) for r in J.jaccard_components(spark.createDataFrame(rows, schema), 3, 90, 100).collect()]
    assert sorted(got, key=repr) == sorted([(None, 2, 4), (4, 2, 4), (4, 2, 4), (None, 0, None), (9, 2, 9)], key=repr)
    assert J.jaccard_components(spark.createDataFrame([], schema), 3, 90, 100).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200)]
    rng.shuffle(edges)
    nodes = [(i, i) for i in [*range(41), *range(100, 140), 200, 201, 300]] + [(301, None)]
    df = connected(spark.createDataFrame(nodes, "node long, rank long"), spark.createDataFrame(edges, "a long, b long"))
    got = {r.node: r.root for r in df.collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200, 300: 300, 301: 301}


def test_components_of_edges_that_differ_between_evaluations(spark):
    """Each evaluation connects the same 60 nodes by another random tree."""
    def tree(batches):
        import pandas as pd
        for b in batches:
            order = np.random.default_rng().permutation(60)
            yield pd.DataFrame([(int(order[i]), int(order[np.random.default_rng().integers(i)])) for i in range(1, 60) for _ in range(len(b))], columns=["a", "b"])

    edges = spark.range(1, numPartitions=1).mapInPandas(tree, "a long, b long")
    nodes = spark.range(60).selectExpr("id as node", "id as rank")
    assert {r.root for r in connected(nodes, edges).collect()} == {0}


def test_spanning_links_do_not_depend_on_the_order_of_rows():
    import pandas as pd
    rng = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    raws = [" ".join([*base[:i], f"new{i}", *base[i + 1:]]).encode() for i in range(100)]
    rows = [(J.set_code(J.ngram_set(r, 3)), r) for r in raws]
    found = set()
    for _ in range(4):
        rng.shuffle(rows)
        block = pd.DataFrame([(c, c, r) for c, r in rows], columns=["cls", "part", "raw"])
        found.add(tuple(sorted(J.spanning_links(block, None, 3, 85, 100))))
    assert len(found) == 1 and len(found.pop()) == 99


def test_rows_without_an_id_link_with_near_copies(spark):
    rng = random.Random(6)
    text = lambda: [f"w{rng.randrange(10_000)}" for _ in range(200)]
    near = lambda words, i: " ".join([*words[:i], "other", *words[i + 1:]])
    base, alone = text(), text()
    rows = [(7, " ".join(base)), (None, near(base, 0)), (None, near(base, 199)), (9, " ".join(text())), (None, " ".join(alone)), (None, near(alone, 0)), (7, "a text of its own")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(df, 3, 90, 100).collect()), key=repr)
    assert got == sorted([(7, 198, 7), (None, 198, 7), (None, 198, 7), (9, 198, 9), (None, 198, None), (None, 198, None), (7, 3, 7)], key=repr)


def test_sketches_never_forbid_similar_sets():
    import numpy as np
    from vigil.llm import ngram_join as J
    rng = np.random.default_rng(7)
    for size in (1, 9, 300, 5_000, 90_000):
        x = np.unique(rng.integers(0, 1 << 63, size=size).astype(np.uint64) * np.uint64(2))
        for gone in (0, 1, len(x) // 10, len(x) // 2):
            y = np.unique(np.concatenate([x[gone:], rng.integers(0, 1 << 63, size=gone).astype(np.uint64)]))
            a, b = (np.frombuffer(J.sketch(s), np.uint8).astype(int) for s in (x, y))
            assert np.abs(a - b).sum() <= len(np.setxor1d(x, y))
