"""Whitening of embeddings by spectrum slicing.

Entries become whole numbers x = floor(64 c) + 1,000,000.  Sums and centred products
of whole numbers are added up exactly, so the covariance is rounded once per entry
and does not depend on how rows are dealt.  Only figures of the size of the
covariance (square in the dimension, whatever the number of rows) reach the driver.

The number of eigenvalues above a shift is the number of positive pivots of the
shifted covariance's LDL^T factors (inertia).  Bisection by these counts isolates
each leading eigenvalue, Rayleigh quotient iteration inside its interval converges
cubically, and two more counts on both sides of the result certify its number.
Equal eigenvalues share an interval; each vector is kept orthogonal to those found.

Defined results: vectors that are null, empty or hold null or non-finite entries
are dropped, and so are vectors of another length than the commonest (the longest
of equally common ones); rows that share a vec_id, also a null one, are rows of
their own; other columns are not read.  Components whose eigenvalue is less than
``LEAST`` of the largest are left out (fewer than 32 then): doubles do not
determine them.  An empty table, a single vector or equal vectors give no rows.
Entries are limited to +-2^46 before rounding; a deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 64, 1_000_000
LIMIT = float(1 << 52)      # of the scaled entries; beyond, doubles hold no whole numbers
EXACT = float(1 << 53)
LEAST = 1e-10               # least eigenvalue to whiten by, as a share of the largest
ROWS = 2_048                # rows handled at once
EPS = np.finfo(np.float64).eps
LEAST_NORM = 1e-200
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double"


@dataclass
class Spectrum:
    """Exact sums of the fitted vectors and the leading components of their covariance."""

    n: int
    sums: list[int]
    centre: np.ndarray      # whole numbers next to the means
    values: np.ndarray      # eigenvalues, falling
    components: np.ndarray  # one unit eigenvector a row
    trace: float


def usable(df: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id, v`` of the rows whose vector takes part, and its length ``dim``."""
    v = F.col(column).cast("array<double>")
    fine = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dim"))


def whole(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The vectors of a batch as whole numbers x, a row each."""
    c = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.clip(np.floor(SCALE * c), -LIMIT, LIMIT) + OFFSET


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _total(df: DataFrame, run, kind: str) -> dict[tuple[int, int], object]:
    """Sums over all tasks of the entries ``i, j, v`` that ``run`` gives for a task's batches."""
    rows = df.mapInArrow(run, f"i int, j int, v {kind}").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    return {(r["i"], r["j"]): r["v"] for r in rows}


def _entries(values: dict[tuple[int, int], object], kind: pa.DataType) -> pa.RecordBatch:
    i, j = (pa.array([k[c] for k in values], pa.int32()) for c in (0, 1))
    return pa.record_batch([i, j, pa.array(list(values.values()), kind)], names=["i", "j", "v"])


WHOLE = pa.decimal128(38, 0)


def exact_sums(x: np.ndarray) -> list[int]:
    fits = np.abs(x).max(initial=0) * len(x) < EXACT
    return [int(s) for s in x.sum(axis=0)] if fits else [sum(int(e) for e in col) for col in x.T]


def exact_products(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` of whole numbers, exactly, as Python integers."""
    if np.abs(y).max(initial=0) ** 2 * max(len(y), 1) < EXACT:
        return (y.T @ y).astype(np.int64).astype(object)
    y = np.array([[int(e) for e in row] for row in y], dtype=object).reshape(y.shape)
    return y.T.dot(y)


def _summed(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dim
        for b in _pieces(batches):
            n += b.num_rows
            sums = [a + s for a, s in zip(sums, exact_sums(whole(b, dim)), strict=True)]
        yield _entries({(i, 0): s for i, s in enumerate(sums)} | {(-1, 0): n}, WHOLE)

    return run


def _multiplied(dim: int, centre: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim), dtype=object)
        for b in _pieces(batches):
            total = total + exact_products(whole(b, dim) - centre)
        yield _entries({(i, j): total[i, j] for i in range(dim) for j in range(i, dim)}, WHOLE)

    return run


def count_above(a: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of the symmetric ``a`` above ``shift``: positive
    pivots of the LDL^T factors of ``a - shift I``, pivoted by single entries or
    pairs; a pair always holds one positive and one negative eigenvalue."""
    m = a - shift * np.eye(len(a))
    bound = (1 + np.sqrt(17)) / 8
    nothing = max(EPS * EPS * np.abs(m).max(initial=0), LEAST_NORM)
    found, k, n = 0, 0, len(m)
    while k < n:
        below = np.abs(m[k + 1:, k])
        most = below.max(initial=0.0)
        here = abs(m[k, k])
        if max(here, most) <= nothing:
            k += 1
            continue
        size, swap = 1, k
        if here < bound * most:
            r = k + 1 + int(below.argmax())
            row = np.abs(m[r, k:])
            row[r - k] = 0
            across = row.max()
            if here * across < bound * most * most:
                size, swap = (1, r) if abs(m[r, r]) >= bound * across else (2, r)
        to = k + size - 1
        if swap != to and swap != k:
            m[[to, swap]] = m[[swap, to]]
            m[:, [to, swap]] = m[:, [swap, to]]
        side = m[k + size:, k:k + size]
        if size == 1:
            found += m[k, k] > 0
            m[k + 1:, k + 1:] -= np.outer(side[:, 0], side[:, 0]) / m[k, k]
        else:
            found += 1
            less = side @ np.linalg.solve(m[k:k + 2, k:k + 2], side.T)
            m[k + 2:, k + 2:] -= (less + less.T) / 2
        k += size
    return int(found)


class Slicer:
    """Leading eigenpairs of a symmetric matrix."""

    def __init__(self, a: np.ndarray):
        self.a = a
        self.norm = max(float(np.abs(a).sum(axis=1).max(initial=0)), LEAST_NORM)
        self.tolerance = 8 * len(a) * EPS * self.norm
        self.counts: dict[float, int] = {}
        self.values: list[float] = []
        self.vectors: list[np.ndarray] = []
        self.random = np.random.default_rng(1)

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = count_above(self.a, shift)
        return self.counts[shift]

    def interval(self, j: int) -> tuple[float, float]:
        """The narrowest known interval that holds eigenvalue number ``j`` (from 1)."""
        low = max((s for s, c in self.counts.items() if c >= j), default=-2 * self.norm)
        return low, min((s for s, c in self.counts.items() if c < j and s > low), default=2 * self.norm)

    def isolate(self, j: int) -> tuple[float, float]:
        """Bisect until the interval holds no other eigenvalue, or until rounding stops it."""
        low, high = self.interval(j)
        while high - low > self.tolerance and (self.above(low) > j or self.above(high) < j - 1):
            mid = (low + high) / 2
            low, high = (mid, high) if self.above(mid) >= j else (low, mid)
        return low, high

    def orthogonal(self, v: np.ndarray) -> np.ndarray:
        for _ in range(2 if self.vectors else 0):
            found = np.array(self.vectors)
            v = v - found.T @ (found @ v)
        return v / np.linalg.norm(v)

    def solved(self, shift: float, v: np.ndarray) -> np.ndarray:
        for nudge in (0.0, EPS * self.norm, 16 * EPS * self.norm):
            try:
                z = np.linalg.solve(self.a - (shift + nudge) * np.eye(len(v)), v)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(z).all():
                return z / np.abs(z).max()
        return v

    def iterate(self, low: float, high: float) -> tuple[float, np.ndarray, float]:
        """Two inverse iterations at the middle, then Rayleigh quotients as shifts until the residual stops falling."""
        v, last = self.orthogonal(self.random.normal(size=len(self.a))), np.inf
        for step in range(30):
            shift = (low + high) / 2 if step < 2 else float(v @ self.a @ v)
            new = self.orthogonal(self.solved(shift, v))
            value = float(new @ self.a @ new)
            residual = float(np.linalg.norm(self.a @ new - value * new))
            if step > 3 and residual >= last / 2:
                return (value, new, residual) if residual < last else (float(v @ self.a @ v), v, last)
            v, last = new, residual
        return float(v @ self.a @ v), v, last

    def certified(self, j: int, value: float, residual: float) -> bool:
        slack = self.tolerance + 2 * residual
        return residual <= self.tolerance and self.above(value - slack) >= j > self.above(value + slack)

    def leading(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        for j in range(1, min(k, len(self.a)) + 1):
            low, high = self.isolate(j)
            while True:
                value, v, residual = self.iterate(low, high)
                if self.certified(j, value, residual):
                    break
                if high - low <= self.tolerance:
                    raise ArithmeticError(f"eigenvalue {j} could not be certified")
                self.above((low + high) / 2)
                low, high = self.interval(j)
            self.values.append(value)
            self.vectors.append(v)
        order = np.argsort(-np.array(self.values), kind="stable")
        return np.array(self.values)[order], np.array(self.vectors).reshape(len(order), len(self.a))[order]


def fit(vectors: DataFrame, k: int = 32) -> tuple[DataFrame, Spectrum | None]:
    """The vectors of the commonest length (see ``usable``), and their leading
    components; None if there are no two different vectors."""
    common = vectors.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    dim = common[0]["dim"] if common else 0
    vectors = vectors.where(F.col("dim") == dim)
    if not dim:
        return vectors, None
    sums = {i: int(s) for (i, _), s in _total(vectors, _summed(dim), "decimal(38,0)").items()}
    n = sums.pop(-1)
    centre = [round(sums[i] / n) for i in range(dim)]
    products = _total(vectors, _multiplied(dim, np.array(centre, dtype=np.float64)), "decimal(38,0)")
    rest = [sums[i] - n * centre[i] for i in range(dim)]
    v = np.zeros((dim, dim))
    for (i, j), p in products.items():
        v[i, j] = v[j, i] = (n * int(p) - rest[i] * rest[j]) / (n * n)  # whole numbers, rounded once
    trace = sum(n * int(products[i, i]) - rest[i] ** 2 for i in range(dim)) / (n * n)
    if trace <= 0:
        return vectors, None
    values, components = Slicer(v).leading(k)
    some = values > LEAST * values[0]
    return vectors, Spectrum(n, [sums[i] for i in range(dim)], np.array(centre, dtype=np.float64), values[some], components[some], trace)


def projected(x: np.ndarray, s: Spectrum) -> np.ndarray:
    rest = np.array([(a - s.n * int(c)) / s.n for a, c in zip(s.sums, s.centre, strict=True)])
    return ((x - s.centre) - rest) @ (s.components / np.sqrt(s.values)[:, None]).T


def deviations(x: np.ndarray, s: Spectrum) -> pa.Array:
    """Sum over the dimensions of (n x - S)^2 of each row, exactly."""
    y = x - s.centre
    rest = [a - s.n * int(c) for a, c in zip(s.sums, s.centre, strict=True)]
    largest = s.n * int(np.abs(y).max(initial=0)) + max(map(abs, rest))
    if len(rest) * largest ** 2 < 1 << 63:
        return pa.array((((y.astype(np.int64) * s.n) - np.array(rest, dtype=np.int64)) ** 2).sum(axis=1))
    exact = [sum((s.n * int(e) - r) ** 2 for e, r in zip(row, rest, strict=True)) for row in y]
    return pa.array([d if d < 1 << 63 else None for d in exact], pa.int64())


def identity_error(vectors: DataFrame, s: Spectrum) -> float:
    """Largest entry, without sign, of the whitened vectors' covariance minus the identity, over all of them."""
    dim, k = len(s.centre), len(s.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros((k, k)), np.zeros(k)
        for b in _pieces(batches):
            w = projected(whole(b, dim), s)
            total += w.T @ w
            sums += w.sum(axis=0)
        yield _entries({(i, j): total[i, j] for i in range(k) for j in range(i, k)} | {(i, -1): sums[i] for i in range(k)}, pa.float64())

    got = _total(vectors, run, "double")
    mean = [got[i, -1] / s.n for i in range(k)]
    return max(abs(got[i, j] / s.n - mean[i] * mean[j] - (i == j)) for i in range(k) for j in range(i, k))


def whitened(df: DataFrame, k: int = 32, column: str = "embedding") -> DataFrame:
    """A row per vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    vectors, s = fit(usable(df, column), k)
    if s is None:
        return df.sparkSession.createDataFrame([], f"{SCHEMA}, identity_error double")
    dim, k, shares = len(s.centre), len(s.values), s.values / s.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            x, rows = whole(b, dim), np.repeat(np.arange(b.num_rows), k)
            yield pa.record_batch([
                b.column("vec_id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)),
                pa.array(np.full(len(rows), s.n, dtype=np.int64)), deviations(x, s).take(pa.array(rows)),
                pa.array(projected(x, s).reshape(-1)), pa.array(np.tile(shares, b.num_rows))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return vectors.mapInArrow(run, SCHEMA).withColumn("identity_error", F.lit(identity_error(vectors, s)))
