import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators import oversample as S


def brute(rows, k):
    """Nearest other rows by (distance, vector), per different vector."""
    out = {}
    for i, x in enumerate(rows):
        near = sorted((float(((np.array(x) - np.array(y)) ** 2).sum()), y) for j, y in enumerate(rows) if j != i)
        out[x] = [y for _, y in near[:k]]
    return out


@pytest.mark.parametrize("kind", ["spread", "copies", "grid", "line"])
def test_neighbours_are_exact(spark, monkeypatch, kind):
    monkeypatch.setattr(S, "CELL", 16)
    monkeypatch.setattr(S, "VISITS", 7)
    rng = np.random.default_rng(4)
    rows = {"spread": lambda: rng.normal(size=(300, 3)) * [1, 5, 0.1],
            "copies": lambda: np.concatenate([np.repeat(rng.normal(size=(9, 3)), 40, axis=0), rng.normal(size=(60, 3))]),
            "grid": lambda: rng.integers(0, 5, size=(250, 3)).astype(float),
            "line": lambda: np.stack([np.arange(200.0), np.zeros(200), np.ones(200)], axis=1)}[kind]()
    rows = [tuple(r) for r in rows.tolist()]
    df = spark.createDataFrame([(list(r),) for r in rows], "v array<double>").repartition(5)
    got = S.neighbours(df.groupBy("v").agg(F.count(F.lit(1)).alias("n")), 5).collect()
    want = brute(rows, 5)
    assert len(got) == len(want)
    for r in got:
        listed = [tuple(e.v) for e in r.near for _ in range(min(e.n, 5))][:5]
        assert listed == want[tuple(r.v)]


def frame(spark, sizes, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(f"{c}{i}", c, *map(float, rng.normal(size=2) + 5 * ord(c))) for c, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "id string, label string, x double, y double")


def test_classes_are_filled_up(spark):
    df = frame(spark, {"a": 200, "b": 30, "c": 7})
    made = S.oversampled(df, "id", ["x", "y"], "label").collect()
    assert {c: sum(r.label == c for r in made) for c in "abc"} == {"a": 0, "b": 170, "c": 193}
    of = {r.id: r for r in df.collect()}
    near = {c: brute([(r.x, r.y) for r in of.values() if r.label == c], 5) for c in "bc"}
    for r in made:
        base = of[r.base]
        to = near[r.label][base.x, base.y][r.neighbour - 1]
        gaps = [(v - b) / (t - b) for v, b, t in ((r.x, base.x, to[0]), (r.y, base.y, to[1]))]
        assert 0 <= gaps[0] < 1 and abs(gaps[0] - gaps[1]) < 1e-6
    assert len({r.base for r in made if r.label == "b"}) == 30 and {r.neighbour for r in made} == {1, 2, 3, 4, 5}
    again = S.oversampled(df.repartition(9), "id", ["x", "y"], "label").collect()
    assert sorted(map(tuple, made)) == sorted(map(tuple, again))


def test_few_rows_and_nulls(spark):
    few = S.oversampled(frame(spark, {"a": 20, "b": 5}), "id", ["x", "y"], "label").collect()
    assert len(few) == 15 and {r.neighbour for r in few} == {1}
    one = frame(spark, {"a": 6, "b": 1})
    only = one.where("label = 'b'").first()
    assert {(r.x, r.y) for r in S.oversampled(one, "id", ["x", "y"], "label").collect()} == {(only.x, only.y)}
    assert S.oversampled(frame(spark, {"a": 6, "b": 6}), "id", ["x", "y"], "label").count() == 0
    assert S.oversampled(one.limit(0), "id", ["x", "y"], "label").count() == 0
    gone = one.withColumn("x", F.when(F.col("label") == "a", F.col("x"))).withColumn("label", F.when(F.col("id") != "a0", F.col("label")))
    assert S.oversampled(gone, "id", ["x", "y"], "label").count() == 0
