"""Ranked lexical search over document FP-trees.

Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower
case.  Each text is tokenised once and restricted to the terms that some item of a
block holds: a *vector* of term numbers, in order of document frequency, with their
tf.  Vectors are written to the shared folder; N, L and df are counted there.

Each stretch of a partition (at most ``TREE_TERMS`` vector entries) becomes a tree:
sorted by their terms, vectors that begin alike share a path.  The rarest term comes
first, since then a subtree below a rare term holds none that is rarer still, and
the terms of large weight are settled next to the root.  Subtrees of at most ``LEAF``
documents stay leaves, and small neighbours share one.  A node holds the largest tf
of each term in its subtree and the least m: with them, the score formula bounds
every score below, since it rises with tf and falls with m.  An item descends depth
first into the child of the largest bound and leaves out subtrees whose bound is
below its tenth score so far.  The best of all trees are ranked by one window.

No step is a join of items with documents: items come in blocks of about
``BLOCK_TERMS`` terms, and each block makes one pass over the texts.

Defined results: a null or empty text holds no term; an item without terms, or whose
terms no document holds, has no rows; items that share an item_id (also a null one)
are one item with the terms of all; documents that share a doc_id are ranked each for
itself; a null doc_id comes last among equal scores; empty tables give no rows.  Other
columns than ``doc_id``, ``item_id`` and ``text`` are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import blocks_for, cut

LEAF = 128
TREE_TERMS = 1 << 20        # vector entries of a tree
BLOCK_TERMS = 1 << 17       # distinct terms of a block of items
LAST = (1 << 63) - 1        # stands for a null doc_id in the order
VECTORS = "doc_id long, n long, terms array<int>, tf array<long>"
FOUND = "item int, doc_id long, score long"


def _letters() -> bytes:
    """Each byte's place in a term: separators become blanks, A-Z lower case."""
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for b in range(128):
        if chr(b).isalnum():
            table[b] = ord(chr(b).lower())
    return bytes(table)


LETTERS = _letters()


def terms(text: str | None) -> list[bytes]:
    """All terms of a text, with repeats, in UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(LETTERS).split()


def _restricted(vocabulary: dict[bytes, int]):
    """``VECTORS`` of the documents that have terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lengths, numbers, tfs, ends, keep = b.column("doc_id"), [], [], [], [0], []
            for row, text in enumerate(b.column("text")):
                words = terms(text.as_py())
                if not words:
                    continue
                found = Counter(map(vocabulary.get, words))
                found.pop(None, None)
                keep.append(row)
                lengths.append(len(words))
                numbers += found.keys()
                tfs += found.values()
                ends.append(len(numbers))
            offsets = pa.array(ends, pa.int32())
            yield pa.record_batch([ids.take(pa.array(keep, pa.int32())), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(numbers, pa.int32())),
                                   pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))], names=["doc_id", "n", "terms", "tf"])

    return run


def _frequencies(size: int):
    """``term, df`` of the vectors of a task, and as term -1 their number, -2 their terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows, total = np.zeros(size, np.int64), 0, 0
        for b in batches:
            df += np.bincount(b.column("terms").flatten().to_numpy(), minlength=size)
            rows += b.num_rows
            total += int(b.column("n").to_numpy().sum())
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(some, [-1, -2]), pa.int32()), pa.array(np.append(df[some], [rows, total]), pa.int64())], names=["term", "df"])

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_part(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """m of documents of ``n`` terms."""
    if 90 * int(n.max(initial=0)) * n_docs < 1 << 63:
        return 10 + 90 * n * n_docs // total
    return np.array([10 + 90 * int(x) * n_docs // total for x in n], dtype=np.int64)


def factor(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Node:
    """A subtree: documents ``low`` to ``high``, terms that occur there (ascending)
    with the bound of what each adds to a score, and either children or postings."""

    __slots__ = ("low", "high", "terms", "bounds", "children", "starts", "docs", "adds")

    def __init__(self, low: int, high: int):
        self.low, self.high, self.children = low, high, []

    def bound(self, item: np.ndarray) -> int:
        at = np.searchsorted(self.terms, item)
        at[at == len(self.terms)] = 0
        return int(self.bounds[at[self.terms[at] == item]].sum()) if len(self.terms) else 0

    def scores(self, item: np.ndarray) -> np.ndarray:
        """Scores of a leaf's documents."""
        at = np.searchsorted(self.terms, item)
        out = np.zeros(self.high - self.low, np.int64)
        for i in at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == item)].tolist():
            lo, hi = self.starts[i], self.starts[i + 1]
            out[self.docs[lo:hi]] += self.adds[lo:hi]  # a document occurs once among a term's postings
        return out


class Tree:
    """Documents with vectors in order of term paths.  ``numbers`` and ``tf`` are
    the vectors' entries one after the other; term numbers rise with frequency."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, numbers: np.ndarray, tf: np.ndarray, sizes: np.ndarray, weights: np.ndarray):
        doc = np.repeat(np.arange(len(ids)), sizes)
        by = np.lexsort((numbers, doc))
        numbers, tf = numbers[by], tf[by]
        paths = [p.astype(">i4").tobytes() for p in np.split(numbers, np.cumsum(sizes)[:-1])]
        order = np.array(sorted(range(len(ids)), key=paths.__getitem__), dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        entries = np.concatenate([np.arange(starts[d], starts[d + 1]) for d in order]) if len(order) else np.empty(0, np.int64)
        self.ids, self.m, self.weights = ids[order], m[order], weights
        self.numbers, self.tf = numbers[entries], tf[entries]
        self.sizes = sizes[order]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.adds = weights[self.numbers] * factor(self.tf, np.repeat(self.m, self.sizes))
        self.root = self.grown()

    def grown(self) -> Node:
        root = Node(0, len(self.ids))
        stack = [(root, 0)]
        while stack:
            node, depth = stack.pop()
            children = self.parts(node.low, node.high, depth) if node.high - node.low > LEAF else []
            self.summarise(node, leaf=not children)
            for lo, hi, deeper in children:
                node.children.append(Node(lo, hi))
                stack.append((node.children[-1], deeper))
        return root

    def parts(self, low: int, high: int, depth: int) -> list[tuple[int, int, int]]:
        """Children of a node: runs of documents with the same term at ``depth``;
        neighbouring small runs go together.  None if all have the same path."""
        while True:
            longer = self.sizes[low:high] > depth
            at = np.where(longer, self.starts[low:high] + depth, 0)
            term = np.where(longer, self.numbers[at], -1)
            edges = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1], [True]]))
            if len(edges) > 2:
                break
            if term[0] < 0:
                return []
            depth += 1  # a single child shares the path
        out: list[tuple[int, int, int]] = []
        for lo, hi in zip((edges[:-1] + low).tolist(), (edges[1:] + low).tolist(), strict=True):
            if out and out[-1][2] == 0 and hi - out[-1][0] <= LEAF:
                out[-1] = (out[-1][0], hi, 0)
            else:
                out.append((lo, hi, 0 if hi - lo <= LEAF else depth + 1))
        return out

    def summarise(self, node: Node, leaf: bool) -> None:
        lo, hi = self.starts[node.low], self.starts[node.high]
        numbers = self.numbers[lo:hi]
        order = np.argsort(numbers, kind="stable")
        here = numbers[order]
        first = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]])) if len(here) else np.empty(0, np.int64)
        node.terms = here[first]
        if len(first):
            most = np.maximum.reduceat(self.tf[lo:hi][order], first)
            node.bounds = self.weights[node.terms] * factor(most, np.full(len(most), self.m[node.low:node.high].min()))
        else:
            node.bounds = np.empty(0, np.int64)
        if leaf:
            doc = np.repeat(np.arange(node.high - node.low), self.sizes[node.low:node.high])
            node.starts, node.docs, node.adds = np.append(first, len(here)).tolist(), doc[order], self.adds[lo:hi][order]

    def best(self, item: np.ndarray, k: int, least: int = 0) -> tuple[list[tuple[int, int]], int]:
        """The ``k`` highest (score, -doc_id) above 0 that reach ``least``, and the number of documents scored."""
        heap: list[tuple[int, int]] = []
        scored = 0
        stack = [(self.root.bound(item), self.root)]
        while stack:
            bound, node = stack.pop()
            if bound <= 0 or bound < least or (len(heap) == k and bound < heap[0][0]):
                continue
            if node.children:
                stack += sorted(((c.bound(item), c) for c in node.children), key=lambda c: c[0])
                continue
            scores = node.scores(item)
            scored += len(scores)
            floor = max(heap[0][0] if len(heap) == k else 1, least, 1)
            some = np.flatnonzero(scores >= floor)
            if len(some) > k:  # ties at the boundary go by doc_id
                some = some[np.lexsort((self.ids[node.low + some], -scores[some]))[:k]]
            for i in some.tolist():
                entry = (int(scores[i]), -int(self.ids[node.low + i]))
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
        return sorted(heap, reverse=True), scored


def _searched(items: list[np.ndarray], weights: np.ndarray, rank: np.ndarray, n_docs: int, total: int, k: int):
    """``FOUND``: the best documents of each tree, ``rank`` being the terms' numbers in order of frequency."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[Tree]:
        held, entries = [], 0

        def tree() -> Tree:
            ids, n, numbers, tf, sizes = (np.concatenate(c) for c in zip(*held, strict=True))
            return Tree(ids, length_part(n, n_docs, total), rank[numbers], tf, sizes, weights)

        for b in batches:
            sizes = b.column("terms").value_lengths().to_numpy().astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            numbers, tf = (b.column(c).flatten().to_numpy() for c in ("terms", "tf"))
            ids = b.column("doc_id").fill_null(LAST).to_numpy()
            at = 0
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + TREE_TERMS - entries, side="right")) - 1)
                held.append((ids[at:to], b.column("n").to_numpy()[at:to], numbers[ends[at]:ends[to]], tf[ends[at]:ends[to]], sizes[at:to]))
                entries += int(ends[to] - ends[at])
                at = to
                if at < len(ids) or entries >= TREE_TERMS:
                    yield tree()
                    held, entries = [], 0
        if held:
            yield tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        for tree in trees(batches):
            for i, item in enumerate(items):
                least = best[i][-1][0] if len(best[i]) == k else 0
                best[i] = sorted(best[i] + tree.best(item, k, least)[0], reverse=True)[:k]
        rows = [(i, -d, s) for i, found in enumerate(best) for s, d in found]
        item, doc, score = zip(*rows, strict=True) if rows else ((), (), ())
        ids = pa.array(doc, pa.int64())
        yield pa.record_batch([pa.array(item, pa.int32()), pa.array([None if d == LAST else d for d in doc], pa.int64()) if LAST in doc else ids, pa.array(score, pa.int64())],
                              names=["item", "doc_id", "score"])

    return run


def _block(docs: DataFrame, items: list[list[bytes]], k: int) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*items)))}
    vectors = cut(docs.mapInArrow(_restricted(vocabulary), VECTORS))
    counts = dict(vectors.mapInArrow(_frequencies(len(vocabulary)), "term int, df long").groupBy("term").agg(F.sum("df")).collect())  # at most a row per term of the block
    n_docs, total = counts.pop(-1, 0), counts.pop(-2, 0)
    df = np.array([counts.get(i, 0) for i in range(len(vocabulary))], dtype=np.int64)
    order = np.argsort(df, kind="stable")  # rarest first
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    weights = np.array([weight(n_docs, int(d)) for d in df[order]], dtype=np.int64)
    wanted = [np.sort(rank[[vocabulary[t] for t in ts]]) for ts in items]
    return vectors.mapInArrow(_searched(wanted, weights, rank, n_docs, max(total, 1), k), FOUND)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, t) for i, text in zip(b.column("item_id").to_pylist(), b.column("text"), strict=True) for t in set(terms(text.as_py()))]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["item_id", "term"])

    words = cut(items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(worded, "item_id long, term binary").distinct())
    n_blocks = blocks_for(words.count(), block_terms)
    out = None
    for block in range(n_blocks):
        some = words.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms")).collect()
        if not some:
            continue
        found = _block(docs, [[bytes(t) for t in r["terms"]] for r in some], k)
        names = docs.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(some)], "item int, item_id long")
        found = found.join(names, "item").select("item_id", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
