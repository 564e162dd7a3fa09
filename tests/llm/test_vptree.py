import numpy as np
import pytest

from vigil.llm import vptree as V


def brute(base, queries, k):
    out = {}
    for q, v in queries:
        scored = sorted(((-float((np.array(v) * np.array(x)).sum()), i) for i, x in base if i != q and len(x) == len(v)))[:k]
        out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


def test_factor_one_is_exact_and_larger_factors_prune(monkeypatch):
    monkeypatch.setattr(V, "LEAF", 16)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8)) * 3
    x = centres[rng.integers(20, size=2000)] + rng.normal(size=(2000, 8)) * 0.2
    x[::3] *= rng.uniform(0.2, 2, size=(len(x[::3]), 1))
    q = x[:100]
    tree = V.VPTree(x)
    want = np.sort(q @ x.T, axis=1)[:, ::-1][:, :10]
    exact, where, all_scores = tree.search(q, 10, 1.0)
    assert np.allclose(exact, want)
    assert np.allclose(np.take_along_axis(q @ x.T, where, 1), exact)
    scores, recall = [all_scores], []
    for factor in (1.2, 1.5, 4.0):
        got, _, n = tree.search(q, 10, factor)
        scores.append(n)
        recall.append(np.mean([np.isin(w.round(9), g.round(9)).mean() for w, g in zip(want, got, strict=True)]))
    assert scores == sorted(scores, reverse=True) and scores[0] < 100 * 2000 and scores[-1] < scores[0]
    assert recall == sorted(recall, reverse=True) and recall[0] > 0.8


def test_equal_vectors_only(monkeypatch):
    monkeypatch.setattr(V, "LEAF", 4)
    best, where, _ = V.VPTree(np.ones((50, 3))).search(np.ones((2, 3)), 5, 1.0)
    assert np.allclose(best, 3) and (where >= 0).all()


@pytest.mark.parametrize("shard_rows", [40, 10_000])
def test_against_brute_force(spark, shard_rows):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(150)]
    rows += [(200 + i, rows[7][1]) for i in range(70)]  # ties
    odd = [(300, None), (301, []), (302, [0.0] * 6), (303, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (304, [float("nan")] * 6), (305, [float("inf")] * 6), (None, [1.0] * 6), (306, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, score string")
    f32 = [(i, [float(np.float32(c)) for c in v]) for i, v in rows + [odd[-1]]]
    queries = [r for r in f32 if r[0] % 10 == 0 or r[0] == 306]
    got = {}
    for r in V.nearest(df, df.where("vec_id % 10 = 0 or vec_id = 306"), 5, 1.0, shard_rows).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = {q: rows for q, rows in brute(f32, queries, 5).items() if rows}
    assert set(got) == set(want)
    for q, rows in want.items():
        assert [x[:2] for x in sorted(got[q])] == [x[:2] for x in rows]
        assert np.allclose([x[2] for x in sorted(got[q])], [x[2] for x in rows], rtol=0, atol=1e-12)


def test_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in V.nearest(df, df.where("vec_id = 0"), 5).collect()] == [(0, 1)]
    assert V.nearest(df.limit(0), df, 5).count() == 0 and V.nearest(df, df.limit(0), 5).count() == 0


def test_recall_on_the_given_table(spark):
    from vigil.llm.queries import op3_vptree
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = {}
    for r in op3_vptree(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = np.mean([len(got[q] & {x[1] for x in w}) / len(w) for q, w in want.items()])
    assert recall >= 0.9


@pytest.mark.parametrize("factor, shard_rows", [(1.0, 10_000), (1.5, 10_000), (1.5, 150)])
def test_ties_of_different_vectors_go_to_the_smaller_ids(spark, factor, shard_rows):
    rng = np.random.default_rng(7)
    ids = rng.permutation(399) + 1  # the order of vectors says nothing about ids
    rows = [(0, [1.0, 0.0, 0.0])] + [(int(i), [0.1, float(np.cos(j)), float(np.sin(j))]) for j, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id) for r in V.nearest(df, df.where("vec_id = 0"), 20, factor, shard_rows).collect())
    assert got == [(i, i) for i in range(1, 21)]


def test_ties_inside_a_split_tree(monkeypatch):
    monkeypatch.setattr(V, "LEAF", 16)
    rng = np.random.default_rng(8)
    x = rng.integers(-2, 3, size=(3000, 5)).astype(float)  # quantised: many equal scores
    q = rng.integers(-2, 3, size=(60, 5)).astype(float)
    best, where, _ = V.VPTree(x).search(q, 20, 1.0)
    for i in range(len(q)):
        want = sorted((-float((q[i] * v).sum()), j) for j, v in enumerate(x))[:20]
        assert [(-b, w) for b, w in zip(best[i], where[i], strict=True)] == want


def test_rows_that_share_an_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0])] + [(0, [2.0 + i, 2.0 + i]) for i in range(30)] + [(i, [float(i), -float(i)]) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame(rows[:3], df.schema)
    got = sorted((r["rank"], r.vec_id, r.score) for r in V.nearest(df, asked, 3, 1.0).collect())
    assert got == [(1, 1, -1.0), (1, 8, 8.0), (2, 2, -2.0), (2, 7, 7.0), (3, 3, -3.0), (3, 6, 6.0)]


def test_recall_over_a_full_shard_with_pruning():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(200, 8)) * 2
    x = centres[rng.integers(200, size=V.SHARD_ROWS)] + rng.normal(size=(V.SHARD_ROWS, 8)) * 0.3
    q = x[::50]
    got, _, n = V.VPTree(x).search(q, 21, V.FACTOR)
    want = np.sort(q @ x.T, axis=1)[:, ::-1][:, :21]
    assert (got >= want[:, -1:] - 1e-9).mean() >= 0.9 and n < 0.7 * len(q) * len(x)
