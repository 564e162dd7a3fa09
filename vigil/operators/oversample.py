"""Oversampling of small classes by interpolation between near neighbours.

Every class but the largest is filled up to its size.  A synthetic row lies
between a row of its class and one of that row's ``k`` nearest neighbours in the
class; which row, which neighbour and where between them come from hashes of the
draw's number.

The neighbours are exact.  Equal feature vectors are one *point* with a number of
rows, so copies never meet in a task.  A k-d tree over a bounded sample of points
cuts the space into cells of about ``CELL`` points.  A point first searches its own
cell, which bounds the distance of its k-th neighbour, and then only the cells whose
box lies within that distance.  No task sees all points, and nothing is paired with
everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.ordered import running_totals
from vigil.session import materialize

CELL = 2048
MAX_CELLS = 16_384          # beyond it, cells hold more points
SAMPLE = 200_000            # points that the tree is cut by, at most
VISITS = 8_192              # points that search a cell in one task
K = 5
SEED = 42

NEAR = "array<struct<d:double,v:array<double>,n:bigint>>"
NEAR_ARROW = pa.list_(pa.struct([("d", pa.float64()), ("v", pa.list_(pa.float64())), ("n", pa.int64())]))


@dataclass
class Cells:
    """A k-d tree: inner nodes in ``axis, at, left, right`` (children below 0 are
    cells -1 - c), and the box of the points of each cell."""

    axis: list[int]
    at: list[float]
    left: list[int]
    right: list[int]
    low: np.ndarray
    high: np.ndarray

    @property
    def n(self) -> int:
        return len(self.axis) + 1

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        stack = [(0 if self.axis else -1, np.arange(len(points)))]
        while stack:
            node, some = stack.pop()
            if node < 0:
                out[some] = -1 - node
            elif len(some):
                less = points[some, self.axis[node]] <= self.at[node]
                stack += [(self.left[node], some[less]), (self.right[node], some[~less])]
        return out

    def within(self, points: np.ndarray, d2: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Cells with the points whose squared distance to the cell's box is at most ``d2``."""
        for cell in range(self.n):
            gap = np.maximum(np.maximum(self.low[cell] - points, points - self.high[cell]), 0)
            some = np.flatnonzero((gap ** 2).sum(axis=1) <= d2 * (1 + 1e-9))
            if len(some):
                yield cell, some


def cells(sample: np.ndarray, n: int) -> Cells:
    """A tree of ``n`` cells at most that hold equal shares of ``sample``; the
    widest axis of a cell is cut at its median, between different values."""
    tree = Cells([], [], [], [], np.empty(0), np.empty(0))
    count = 0
    todo = [(np.arange(len(sample)), n, None, "")]
    while todo:
        some, parts, parent, side = todo.pop()
        values = sample[some]
        node = None
        if parts > 1 and len(some) > 1 and np.ptp(values, axis=0).max() > 0:
            axis = int(np.ptp(values, axis=0).argmax())
            order = np.sort(values[:, axis])
            at = order[(len(order) - 1) // 2]
            if at == order[-1]:
                at = order[np.searchsorted(order, at) - 1]
            node = len(tree.axis)
            for column, value in ((tree.axis, axis), (tree.at, float(at)), (tree.left, 0), (tree.right, 0)):
                column.append(value)
            less = values[:, axis] <= at
            todo += [(some[less], parts // 2, node, "left"), (some[~less], parts - parts // 2, node, "right")]
        else:
            node, count = -1 - count, count + 1
        if parent is not None:
            getattr(tree, side)[parent] = node
    return tree


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest(x: np.ndarray, own: np.ndarray | None, points: np.ndarray, rows: np.ndarray, k: int) -> list[list[tuple[float, list[float], int]]]:
    """For each of ``x`` the nearest of ``points`` by (distance, vector) that hold
    ``k`` rows together; ``own[i]`` is the place of x[i] among the points, one of
    whose rows is x[i] itself."""
    by = np.lexsort(points.T[::-1])
    points, rows = points[by], rows[by]
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    out = []
    step = max(1, (1 << 22) // max(1, points.size))
    for lo in range(0, len(x), step):
        d2 = ((x[lo:lo + step, None, :] - points[None, :, :]) ** 2).sum(axis=2)
        for i, d in enumerate(d2):
            n = rows
            if own is not None:
                n = rows.copy()
                n[place[own[lo + i]]] -= 1
            few = min(k, len(d) - 1)
            edge = np.partition(d, few)[few]  # one point may have no row left
            some = np.flatnonzero((d <= edge) & (n > 0))
            some = some[np.argsort(d[some], kind="stable")]  # equal distances stay in order of the vectors
            taken = np.searchsorted(np.cumsum(n[some]), k) + 1
            out.append([(float(d[j]), points[j].tolist(), int(n[j])) for j in some[:taken]])
    return out


def neighbours(points: DataFrame, k: int) -> DataFrame:
    """``v, n, near`` of ``points(v, n)``, different vectors and their rows: the
    nearest points by (distance, vector) of which the first ``k`` rows count."""
    points = materialize(points.select("v", F.col("n").cast("long").alias("n")))
    total, dim = points.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not total:
        return points.withColumn("near", F.array().cast(NEAR))
    n_cells = min(-(-total // CELL), MAX_CELLS)
    sample = points.orderBy(F.xxhash64("v")).limit(SAMPLE).select("v").toPandas()["v"] if n_cells > 1 else []
    tree = cells(np.array([list(v) for v in sample], dtype=np.float64).reshape(-1, dim), n_cells)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array(tree.of(_matrix(b.column("v"), dim))), b.column("v"), b.column("n")], names=["cell", "v", "n"])

    placed = materialize(points.mapInArrow(dealt, "cell long, v array<double>, n long"))
    edges = [f(F.get("v", F.lit(i))).alias(f"{name}{i}") for name, f in (("lo", F.min), ("hi", F.max)) for i in range(dim)]
    boxes = {r["cell"]: r for r in placed.groupBy("cell").agg(*edges).collect()}  # at most MAX_CELLS rows
    box = lambda name, empty: np.array([[boxes[c][f"{name}{i}"] if c in boxes else empty for i in range(dim)] for c in range(tree.n)])
    tree.low, tree.high = box("lo", np.inf), box("hi", -np.inf)

    def own_cell(cell: pa.Table) -> pa.Table:
        v, n = _matrix(cell.column("v"), dim), cell.column("n").to_numpy()
        near = nearest(v, np.arange(len(v)), v, n, k)
        return cell.append_column("near", pa.array([[dict(zip("dvn", e, strict=True)) for e in es] for es in near], NEAR_ARROW))

    first = materialize(placed.groupBy("cell").applyInArrow(own_cell, f"cell long, v array<double>, n long, near {NEAR}"))

    def open_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, cell, bound = _matrix(b.column("v"), dim), b.column("cell").to_numpy(), []
            for near in b.column("near").to_pylist():
                bound.append(near[-1]["d"] if sum(e["n"] for e in near) >= k else np.inf)
            for target, some in tree.within(v, np.array(bound)):
                some = some[cell[some] != target]
                yield pa.record_batch([pa.array(np.full(len(some), target)), b.column("v").take(pa.array(some))], names=["cell", "x"])

    visits = materialize(first.mapInArrow(open_cells, "cell long, x array<double>"))
    parts = materialize(visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / VISITS).cast("int").alias("parts")))
    asking = visits.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("x"), "parts").cast("int"))
    asked = (placed.join(parts, "cell").select(F.col("cell").alias("target"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("place"),
                                               F.col("v").alias("to"), F.col("n").alias("rows")))

    def visited(ask: pa.Table, cell: pa.Table) -> pa.Table:
        x = _matrix(ask.column("x"), dim)
        near = nearest(x, None, _matrix(cell.column("to"), dim), cell.column("rows").to_numpy(), k) if len(x) else []
        return pa.table([ask.column("x"), pa.array([[dict(zip("dvn", e, strict=True)) for e in es] for es in near], NEAR_ARROW)], names=["v", "near"])

    more = asking.groupBy("cell", "part").cogroup(asked.groupBy("target", "place")).applyInArrow(visited, f"v array<double>, near {NEAR}")
    merged = first.select("v", "n", "near").unionByName(more.select("v", F.lit(None).cast("long").alias("n"), "near"))
    return merged.groupBy("v").agg(F.max("n").alias("n"), F.sort_array(F.flatten(F.collect_list("near"))).alias("near"))


def uniform(draw: Column, label: str, what: str) -> Column:
    """A number from 0 to below 2^32 for a draw, from its md5."""
    name = F.concat(draw.cast("string"), F.lit(f"|{label}|{what}|{SEED}"))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("bigint")


def oversampled(train: DataFrame, key: str, features: list[str], label: str, k: int = K) -> DataFrame:
    """``label, draw, base, neighbour`` (its rank from 1) and the feature columns of
    the synthetic rows that fill every class up to the largest.

    ``k`` falls back to 1 if a class has no more than ``k`` rows; a class of one row
    is filled with copies.  Rows with a null feature or label take no part."""
    rows = materialize(train.select(F.col(key), F.col(label), F.array(*[F.col(c).cast("double") for c in features]).alias("v"))
                       .dropna(subset=[label]).where(F.forall("v", lambda x: x.isNotNull())))
    sizes = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # the label classes
    most = max(sizes.values(), default=0)
    if any(n <= k for n in sizes.values() if n < most):
        k = 1
    out = None
    for name, n in sorted(sizes.items()):
        if n == most:
            continue
        members = rows.where(F.col(label) == F.lit(name))
        near = neighbours(members.groupBy("v").agg(F.count(F.lit(1)).alias("n")), k)
        # one entry a row: a point that holds several rows is several neighbours
        listed = F.slice(F.flatten(F.transform("near", lambda e: F.array_repeat(e["v"], F.least(e["n"], F.lit(k)).cast("int")))), 1, k)
        near = near.select("v", listed.alias("near"))
        spots = train.sparkSession.range(most - n).select(F.col("id").alias("draw"))
        spots = spots.select("draw", F.pmod(uniform(F.col("draw"), str(name), "base"), F.lit(n)).alias("idx"),
                             F.pmod(uniform(F.col("draw"), str(name), "neighbour"), F.lit(k)).cast("int").alias("nth"),
                             (uniform(F.col("draw"), str(name), "gap") / F.lit(4294967296.0)).alias("gap"))
        bases = running_totals(members, key, []).select("idx", F.col(key).alias("base"), "v")
        drawn = spots.join(bases, "idx").join(near, "v", "left")
        to = F.coalesce(F.get("near", F.col("nth")), F.col("v"))
        made = drawn.select(F.lit(name).cast(dict(train.dtypes)[label]).alias(label), "draw", "base", (F.col("nth") + 1).alias("neighbour"),
                            *[(F.get("v", F.lit(i)) + F.col("gap") * (F.get(to, F.lit(i)) - F.get("v", F.lit(i)))).alias(c) for i, c in enumerate(features)])
        out = made if out is None else out.unionByName(made)
    if out is None:
        return train.select(label, F.lit(0).cast("long").alias("draw"), F.col(key).alias("base"), F.lit(1).alias("neighbour"),
                            *[F.col(c).cast("double").alias(c) for c in features]).limit(0)
    return out
