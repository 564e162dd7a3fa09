import numpy as np
import pytest

from vigil.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, n string, whitened string"


def brute(vectors, k=32):
    """Whitening as the plain formulas have it."""
    x = np.floor(64 * np.asarray(vectors, np.float32).astype(np.float64)) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x], c @ u / np.sqrt(e), e / np.trace(v)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(500, 40)) * np.linspace(0.2, 3, 40) + rng.normal(size=40)
    df = spark.createDataFrame([(i, [float(c) for c in r], "x", "y") for i, r in enumerate(data)], SCHEMA).repartition(7)
    got = W.whitened(df).toPandas()
    deviation, white, explained = brute(data)
    assert len(got) == 500 * 32 and (got.n == 500).all() and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    by = got.sort_values(["vec_id", "component"])
    w = by.whitened.to_numpy().reshape(500, 32)
    sign = np.sign((w * white).sum(axis=0))
    assert np.allclose(w * sign, white, atol=1e-9)
    assert by.deviation.tolist() == np.repeat(deviation, 32).tolist()
    assert np.allclose(by.explained.to_numpy().reshape(500, 32)[0], explained, rtol=1e-12)
    assert np.abs(w.T @ w / 500 - np.eye(32)).max() <= got.identity_error[0] + 1e-12


@pytest.mark.parametrize("values", [
    [5.0, 4.0, 3.0, 2.0, 1.0, 0.5], [3.0] * 6, [9.0, 9.0, 9.0, 1.0, 1.0, 0.0], [1e6, 1e6 * (1 - 1e-13), 1.0, 1.0, 1e-3, 1e-3], [2.0, 0, 0, 0, 0, 0]])
def test_slices_of_known_spectra(values):
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    a = (q * np.array(values)) @ q.T
    a = (a + a.T) / 2
    for shift in (-1.0, 0.3, 2.5, 7.0):
        assert W.count_above(a, shift) == sum(v > shift for v in values)
    slicer = W.Slicer(a)
    e, u = slicer.leading(6)
    assert np.allclose(e, sorted(values, reverse=True), atol=1e-12 * max(max(values), 1)) and np.allclose(u @ u.T, np.eye(6), atol=1e-12)
    assert np.abs(a @ u.T - u.T * e).max() <= slicer.tolerance


def test_counts_with_zero_pivots():
    a = np.array([[0.0, 1, 0], [1, 0, 0], [0, 0, 0]])
    assert [W.count_above(a, s) for s in (-2, -0.5, 0.5, 2)] == [3, 2, 1, 0]
    rng = np.random.default_rng(8)
    for _ in range(30):
        m = np.round(rng.normal(size=(9, 9)) * 2)
        m = m + m.T
        for shift in (-3.5, -0.25, 0.75, 4.5):
            assert W.count_above(m, shift) == int((np.linalg.eigvalsh(m) > shift).sum())


def test_exact_sums_of_large_numbers():
    y = np.array([[float(1 << 40), 3.0], [float(1 << 40) + 1, -5.0]])
    a, b = 1 << 40, (1 << 40) + 1
    assert W.exact_products(y).tolist() == [[a * a + b * b, 3 * a - 5 * b], [3 * a - 5 * b, 34]]
    assert W.exact_sums(y) == [a + b, -2]


def test_rows_that_take_no_part(spark):
    rows = [(1, [1.0, 2.0], "", ""), (2, None, "", ""), (3, [1.0, None], "", ""), (4, [float("nan"), 1.0], "", ""), (5, [float("inf"), 0.0], "", ""),
            (6, [], "", ""), (7, [1.0, 2.0, 3.0], "", ""), (8, [-1.0, 0.5], "", ""), (8, [0.25, 0.0], "", ""), (None, [3.0, 1.0], "", "")]
    got = W.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 2), (8, 1), (8, 1), (8, 2), (8, 2)]
    assert {r.n for r in got} == {4}
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for few in ([], rows[:1], rows[:1] * 3, rows[1:6]):
        none = W.whitened(spark.createDataFrame(few, SCHEMA))
        assert none.columns == columns and none.count() == 0
    flat = [(i, [float(i % 3), 2.0, float(i % 3)], "", "") for i in range(9)]  # rank one
    assert {r.component for r in W.whitened(spark.createDataFrame(flat, SCHEMA)).collect()} == {1}
    huge = W.whitened(spark.createDataFrame([(1, [1e30, 1.0], "", ""), (2, [0.0, 2.0], "", "")], SCHEMA)).collect()
    assert {r.deviation for r in huge} == {None} and {r.component for r in huge} == {1}
