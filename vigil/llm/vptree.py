"""Approximate nearest neighbours by inner product: vantage-point trees per shard.

Vectors are dealt by hash into shards of about ``SHARD_ROWS``.  For the tree,
inner products become distances: x gains a component sqrt(M^2 - |x|^2), M the
shard's greatest norm, and a query gains 0, so that the squared distance is
|q|^2 + M^2 - 2<q, x>.  A node splits its vectors at the median distance from a
vantage point.  With d the query's distance from it, no vector within radius r
is nearer than d - r, none beyond radius R nearer than R - d.  A side is left out
when ``factor`` times that bound exceeds the k-th best distance so far; factor 1
is exact search, greater factors prune more.  All queries of a block walk the
tree together, so distances are matrix products.

Queries are dealt into blocks, and each shard meets each block once.  A shard's
best for a query are merged over shards by a window.

Equal vectors of a shard are one tree entry with its ids ascending; entries are
numbered by their smallest id.  A score is the sum of a pair's products in the
order of the components wherever it is met (matrix products only preselect), and
equal scores go to the entry with the smaller number, so ties go to the smaller
id however many vectors or ids share a score.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part; vectors of another length than the query are not its
candidates; with fewer than k candidates all are returned; rows equal in id and
vector are one; rows that share an id but not the vector are candidates of their
own and, as queries, have a ranking each under their common id, and a query skips
every row with its id; a null id takes no part; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import blocks_for

SHARD_ROWS = 16_384
BLOCK_QUERIES = 16_384
LEAF = 512
PIECE = 1 << 15        # pairs whose products are held at once
FACTOR = 1.5


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, the same to the last bit wherever a pair is met."""
    return (a * b).sum(axis=1)


class VPTree:
    """Nodes are stretches of one array: the vantage point first, then the
    nearer half, then the farther half; their radii are kept at its place."""

    def __init__(self, vectors: np.ndarray, seed: int = 5):
        self.norms2 = np.einsum("ij,ij->i", vectors, vectors)
        self.m2 = float(self.norms2.max())
        self.order = np.arange(len(vectors))
        self.inner = np.zeros(len(vectors))
        self.outer = np.zeros(len(vectors))
        lifted = np.concatenate([vectors, np.sqrt(np.maximum(self.m2 - self.norms2, 0))[:, None]], axis=1)
        rng = np.random.default_rng(seed)
        stack = [(0, len(vectors))]
        while stack:
            lo, hi = stack.pop()
            if hi - lo <= LEAF:
                continue
            part = self.order[lo:hi]
            pick = int(rng.integers(len(part)))
            part[[0, pick]] = part[[pick, 0]]
            rest = part[1:]
            d = np.sqrt(np.maximum(((lifted[rest] - lifted[part[0]]) ** 2).sum(axis=1), 0))
            half = len(rest) // 2
            by = np.argpartition(d, half)
            part[1:] = rest[by]
            mid = lo + 1 + half
            self.inner[lo], self.outer[lo] = d[by[:half]].max(initial=0.0), d[by[half:]].min()
            stack += [(lo + 1, mid), (mid, hi)]
        self.given, self.vectors = vectors, vectors[self.order]

    def search(self, queries: np.ndarray, k: int, factor: float = FACTOR, own: np.ndarray | None = None, sole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Scores and positions (in the given vectors) of each query's k best
        found, -1 where there are fewer, and the number of scores computed.
        Equal scores go to the smaller position.  A query passes over vectors
        whose ``sole`` is its ``own``."""
        n = len(queries)
        best, where = np.full((n, k), -np.inf), np.full((n, k), -1)
        q2 = np.einsum("ij,ij->i", queries, queries) + self.m2
        size = np.sqrt(np.einsum("ij,ij->i", queries, queries) * self.norms2.max())
        rounding = 1e-13 * max(64, queries.shape[1]) * size  # how far a matrix product may be from the sum by components
        counted = 0

        def offer(rows: np.ndarray, scores: np.ndarray, at: np.ndarray) -> None:
            """Merge the vectors at positions ``at`` into the lists of the queries ``rows``; ``scores`` are matrix products."""
            if sole is not None:
                scores[sole[at][None, :] == own[rows][:, None]] = -np.inf
            some = scores.max(axis=1) >= best[rows, -1] - rounding[rows]
            some &= scores.max(axis=1) > -np.inf
            rows, scores = rows[some], scores[some]
            if not len(rows):
                return
            reach = best[rows, -1]
            if len(at) > k:
                reach = np.maximum(reach, -np.partition(-scores, k - 1, axis=1)[:, k - 1])
            r, c = np.nonzero((scores >= (reach - 2 * rounding[rows])[:, None]) & (scores > -np.inf))
            exact = np.full(scores.shape, -np.inf)
            for lo in range(0, len(r), PIECE):
                some_r, some_c = r[lo:lo + PIECE], c[lo:lo + PIECE]
                exact[some_r, some_c] = products(queries[rows[some_r]], self.given[at[some_c]])
            both = np.concatenate([best[rows], exact], axis=1)
            ids = np.concatenate([where[rows], np.broadcast_to(at, scores.shape)], axis=1)
            top = np.argpartition(-both, k - 1, axis=1)[:, :k]
            last = np.take_along_axis(both, top, 1).min(axis=1)
            tied = np.flatnonzero((both >= last[:, None]).sum(axis=1) > k)  # which of the equal ones stay is a matter of position
            tied = tied[last[tied] > -np.inf]
            if len(tied):
                top[tied] = np.lexsort((ids[tied], -both[tied]), axis=1)[:, :k]
            both, ids = np.take_along_axis(both, top, 1), np.take_along_axis(ids, top, 1)
            by = np.lexsort((ids, -both), axis=1)
            both, ids = np.take_along_axis(both, by, 1), np.take_along_axis(ids, by, 1)
            best[rows], where[rows] = both, np.where(both > -np.inf, ids, -1)

        def worth(rows: np.ndarray, bound: np.ndarray) -> np.ndarray:
            """Which queries may still find something within a stretch."""
            reach2 = np.maximum(q2[rows] - 2 * best[rows, -1], 0)  # infinite until k are found
            slack = 1e-9 * q2[rows]  # rounding of a squared distance
            return (bound <= 0) | ((factor * bound) ** 2 <= reach2 + slack)

        # a stretch of the array, the queries that look there, and their distance bounds for it
        stack = [(0, len(self.order), np.arange(n), np.zeros(n))]
        while stack:
            lo, hi, rows, bound = stack.pop()
            keep = worth(rows, bound)
            if not keep.all():
                rows, bound = rows[keep], bound[keep]
            if lo >= hi or not len(rows):
                continue
            if hi - lo <= LEAF:
                counted += len(rows) * (hi - lo)
                offer(rows, queries[rows] @ self.vectors[lo:hi].T, self.order[lo:hi])
                continue
            counted += len(rows)
            score = queries[rows] @ self.vectors[lo]
            offer(rows, score[:, None], self.order[lo:lo + 1])
            d = np.sqrt(np.maximum(q2[rows] - 2 * score, 0))
            mid = lo + 1 + (hi - lo - 1) // 2
            near = np.maximum(bound, d - self.inner[lo])
            far = np.maximum(bound, self.outer[lo] - d)
            inside = near <= far  # the side to visit first
            # first sides end up on top of the stack, so that second sides meet a tighter reach
            stack.append((lo + 1, mid, rows[~inside], near[~inside]))
            stack.append((mid, hi, rows[inside], far[inside]))
            stack.append((lo + 1, mid, rows[inside], near[inside]))
            stack.append((mid, hi, rows[~inside], far[~inside]))
        return best, where, counted


def _searched(k: int, factor: float):
    empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "query_row": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    def run(shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(block):
            return empty
        every, ids = np.array(shard["v"].tolist(), dtype=np.float64), shard["vec_id"].to_numpy()
        by_id = np.argsort(ids, kind="stable")
        every, ids = np.ascontiguousarray(every[by_id]), ids[by_id]
        _, first, group = np.unique(every.view([("", every.dtype)] * every.shape[1]).reshape(-1), return_index=True, return_inverse=True)
        by_first = np.argsort(first)  # entries in the order of their smallest ids
        first, group = first[by_first], np.argsort(by_first)[group]
        members = np.argsort(group, kind="stable")  # ids ascending within a group
        starts = np.concatenate([[0], np.cumsum(np.bincount(group))])
        queries, q_ids, q_rows = np.array(block["v"].tolist(), dtype=np.float64), block["vec_id"].to_numpy(), block["row"].to_numpy()
        vectors = every[first]
        # an entry of one id only is none of that id's candidates; no id is the least number
        sole = np.where(np.diff(starts) == 1, ids[members[starts[:-1]]], np.iinfo(np.int64).min)
        _, where, _ = VPTree(vectors).search(queries, min(k + 1, len(vectors)), factor, q_ids, sole)
        out_q, out_v = [], []
        for q, found in enumerate(where):
            for g in found[found >= 0]:
                some = ids[members[starts[g]:starts[g + 1]][:k + 1]]
                some = some[some != q_ids[q]]
                out_q += [q] * len(some)
                out_v += zip([g] * len(some), some.tolist(), strict=True)
        if not out_q:
            return empty
        q, g = np.array(out_q), np.array([x[0] for x in out_v])
        got = pd.DataFrame({"q": q, "query_id": q_ids[q], "query_row": q_rows[q], "vec_id": [x[1] for x in out_v], "score": products(queries[q], vectors[g])})
        got = got.sort_values(["q", "score", "vec_id"], ascending=[True, False, True], kind="stable")
        return got.groupby("q", sort=False).head(k).drop(columns="q")

    return lambda shard, block: run(shard, block)


def nearest(base: DataFrame, queries: DataFrame, k: int, factor: float = FACTOR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``queries`` against ``base``, both ``vec_id, embedding``."""

    def valid(df: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        rows = df.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
        return rows.distinct().withColumn("dim", F.size("v")).withColumn("row", F.xxhash64("vec_id", "v"))

    base, queries = valid(base), valid(queries)
    n_shards = blocks_for(base.count(), shard_rows)
    n_blocks = blocks_for(queries.count(), BLOCK_QUERIES)
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    shards = base.withColumn("shard", deal(n_shards)).withColumn("block", every(n_blocks)).groupBy("dim", "shard", "block")
    blocks = queries.withColumn("block", deal(n_blocks)).withColumn("shard", every(n_shards)).groupBy("dim", "shard", "block")
    found = shards.cogroup(blocks).applyInPandas(_searched(k, factor), "query_id long, query_row long, vec_id long, score double")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
