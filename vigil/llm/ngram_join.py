"""Exact Jaccard self-join of word n-gram sets by universe partitioning.

Sets r and s that reach the similarity differ in at most H elements, a bound
that follows from their sizes.  The universe of n-grams is partitioned by hash
into segments, more than H of them for each band of set sizes.  A set is indexed
under each of its segments, in a few segments also under every subset that lacks
one element.  A probing set spends H + 1 units on segments: one unit asks for an
equal segment, two for a segment that differs in one element at most.  By the
pigeonhole principle some segment it pays for matches.  The units go where
matches by chance are rarest (segments with many elements), as estimated by the
number of elements; bands have segments to spare, in proportion to H, so nearly
empty segments are left out: every set that lacks the segment would match there,
and such groups grow with the square of the input.  Candidates are verified on the n-gram sets themselves.

Equal sets form one class before anything is joined; a class leaves a task once.
Groups are not expanded into pairs.  The classes of a signature's bucket form
groups around hubs, the classes that share most signatures.  A group is compared
in blocks of bounded size, by matrix products inside a task that returns only
links which connect what is not connected yet; in large groups the classes
similar to the hub are set aside first.  This finds the components of the full
link graph, as each pair of candidates is either tested or already connected,
and no join ever holds a row for each pair of a group.

N-grams and sets are represented by 64-bit hashes, rows by one of doc_id and text.

Defined results: null and empty texts, and texts without words, have no n-grams
and link with nothing; a text of fewer words than n is one n-gram; equal sets
link; rows with a null doc_id link as others do, and a component of such rows
alone has a null component_id; rows that share a doc_id are judged by their own
texts; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import cut, free_name, in_bitmap, keyed, releasing, text_bytes, without_ids
from vigil.llm.components import connected

BAND_FACTOR = 1.5
SPARE_SEGMENTS = 2
SPARE_SHARE = 10         # and one more for so many
DELETION_SEGMENTS = 2
BLOCK_WEIGHT = 1 << 18   # n-grams in a block of a cluster, about; a small set counts as
LEAST_WEIGHT = 1 << 9    # so many, which bounds the sets of a block too
SLAB = 4096
SKETCH = 256             # counts of a set's elements by hash; they differ by no more than the sets do
SIGNED_ROWS = 1 << 18    # signatures collected before they become a batch
SIGNED = 1 << 63
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xC2B2AE3D27D4EB4F)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _C[1]
    h = (h ^ (h >> np.uint64(29))) * _C[2]
    return h ^ (h >> np.uint64(32))


def ngram_set(raw: bytes, n: int) -> np.ndarray:
    """Sorted hashes of the distinct word n-grams: A-Z lower-cased, words between ASCII white space."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(n, len(words))
    h = mixed(w[:len(w) - size + 1] + np.uint64(size))
    for i in range(1, size):
        h = mixed(h * _C[0] + w[i:len(w) - size + 1 + i])
    return np.unique(h)


def set_code(grams: np.ndarray) -> int:
    """A signed 64-bit code of a set."""
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - SIGNED if len(grams) else 0


def sketch(grams: np.ndarray) -> bytes:
    """How many elements fall into each of ``SKETCH`` parts of the hash range, 255 at most."""
    return np.minimum(np.bincount((grams >> np.uint64(56)).astype(np.int64), minlength=SKETCH), 255).astype(np.uint8).tobytes()


def sketches(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, SKETCH).astype(np.int16)


class Partitioning:
    """Bands of set sizes and the bounds that follow from the similarity ``num / den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def difference(self, a: int, b: int) -> int:
        """Most elements in which similar sets of these sizes differ."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def least(self, a: int) -> int:
        """Smallest size of a set similar to one of size ``a``."""
        return -(-a * self.num // self.den)

    @lru_cache(maxsize=None)  # noqa: B019 - a few dozen bands
    def top(self, band: int) -> int:
        return ceil(BAND_FACTOR ** (band + 1)) - 1

    @lru_cache(maxsize=None)  # noqa: B019 - sizes repeat
    def band(self, a: int) -> int:
        return next(b for b in range(200) if a <= self.top(b))

    def segments(self, band: int) -> int:
        top = self.top(band)
        most = self.difference(top, top * self.den // self.num)
        return most + 1 + SPARE_SEGMENTS + most // SPARE_SHARE

    def signatures(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the buckets that the set is indexed in or probes, and which of them it probes."""
        a = len(grams)
        if self.difference(a, a * self.den // self.num) == 0:
            return np.empty(0, np.uint64), np.empty(0, bool)  # similar sets are equal
        own = self.band(a)
        keys, probes = [], []
        element = mixed(grams * _C[3])
        for band in range(self.band(max(1, self.least(a))), own + 1):
            m = self.segments(band)
            place = (grams >> np.uint64(7)) % np.uint64(m)
            count = np.bincount(place.astype(np.int64), minlength=m)
            total = np.zeros(m, np.uint64)
            np.add.at(total, place, element)
            tag = np.arange(m, dtype=np.uint64) * _C[0] + np.uint64((band + 1) * int(_C[2]) % (1 << 64))
            units = self.difference(a, min(a, self.top(band))) + 1
            n_del = min(DELETION_SEGMENTS, m)
            first = 4.0 ** -count
            second = (count[:n_del] + 2) * 4.0 ** (1 - count[:n_del]) - first[:n_del]
            spend = np.argsort(np.concatenate([first, second]), kind="stable")[:units] if units <= m + n_del else np.arange(m + n_del)
            exact = np.zeros(m, bool)
            exact[spend[spend < m]] = True
            wide = spend[spend >= m] - m
            full = mixed(total * _C[1] + count.astype(np.uint64) + tag)
            lacking = np.uint64(0x5851F42D4C957F2D)  # marks subsets that lack an element
            if band == own:
                keys.append(full)
                probes.append(exact)
                some = place < np.uint64(n_del)
                at = place[some].astype(np.int64)
                keys.append(mixed((total[at] - element[some]) * _C[1] + (count[at] - 1).astype(np.uint64) + tag[at] + lacking))
                probes.append(np.zeros(len(at), bool))
            else:
                keys.append(full[exact])
                probes.append(np.ones(int(exact.sum()), bool))
            for i in wide.tolist():
                inside = element[place == np.uint64(i)]
                keys.append(mixed(total[i:i + 1] * _C[1] + np.uint64(count[i]) + tag[i] + lacking))
                keys.append(mixed((total[i] - inside) * _C[1] + np.uint64(max(0, int(count[i]) - 1)) + tag[i]))
                probes.append(np.ones(1 + len(inside), bool))
        return np.concatenate(keys), np.concatenate(probes)


def _indexed(n: int, num: int, den: int):
    """Rows ``key, cls, size, kind, id, sketch``: one of kind 0 per document, with
    its row key and sketch, and its class's signatures (kind 1 indexed, 2 probed
    too) once per task."""

    def signed(parts: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        sizes = [len(p[2]) for p in parts]
        each = lambda i, t: pa.array(np.repeat(np.array([p[i] for p in parts], dtype=t), sizes))
        kind = pa.array(np.concatenate([p[3] for p in parts]).astype(np.int32) + 1, pa.int32())
        return pa.record_batch([pa.array(np.concatenate([p[2] for p in parts]).view(np.int64)), each(0, np.int64), each(1, np.int32), kind,
                                pa.nulls(sum(sizes), pa.int64()), pa.nulls(sum(sizes), pa.binary())], names=names)

    names = ["key", "cls", "size", "kind", "id", "sketch"]  # what differs between signatures side by side: they compress better

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, seen = Partitioning(num, den), set()
        for b in batches:
            docs, parts, waiting = [], [], 0
            for raw in b.column("raw"):
                grams = ngram_set(raw.as_py(), n)
                code = set_code(grams)
                docs.append((code, len(grams), sketch(grams) if len(grams) else None))
                if code in seen or not len(grams):
                    continue
                seen.add(code)
                keys, probed = rule.signatures(grams)
                if len(keys):
                    parts.append((code, len(grams), keys, probed))
                    waiting += len(keys)
                if waiting >= SIGNED_ROWS:
                    yield signed(parts)
                    parts, waiting = [], 0
            yield pa.record_batch([b.column("row"), pa.array([d[0] for d in docs], pa.int64()), pa.array([d[1] for d in docs], pa.int32()),
                                   pa.array(np.zeros(len(docs), np.int32)), b.column("doc_id"), pa.array([d[2] for d in docs], pa.binary())], names=names)
            if parts:
                yield signed(parts)

    return run


def _similar(a: str, b: str, num: int, den: int):
    """Whether sets of these sizes can be similar."""
    low, high = F.least(a, b), F.greatest(a, b)
    return low * den >= high * num


def _first_texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``first_row, raw``: the text of each class's first row, once."""
    return (in_bitmap(docs, "row", classes.select("first_row"), "first_row")
            .groupBy(F.col("row").alias("first_row")).agg(F.first("raw").alias("raw")))


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs ``a, b`` of classes whose sets reach the similarity.  Only
    texts of classes in some pair take part in the shuffles."""
    pairs = cut(pairs)
    first = classes.select("cls", "first_row")
    members = cut(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct().join(first, "cls"))
    texts = _first_texts(docs, members).join(members, "first_row").select("cls", "raw")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, np.ndarray | None] = {}

        def grams(code: int, raw: bytes) -> np.ndarray | None:
            if code not in kept:
                if len(kept) >= 512:
                    kept.clear()
                got = ngram_set(raw, n)
                kept[code] = got if set_code(got) == code else None  # another text with the same row key
            return kept[code]

        for b in batches:
            ok = []
            for a_code, a_raw, b_code, b_raw in zip(b["a"].tolist(), b["a_raw"], b["b"].tolist(), b["b_raw"], strict=True):
                x, y = grams(a_code, a_raw), grams(b_code, b_raw)
                if x is None or y is None:
                    kept.pop(a_code if x is None else b_code, None)
                    ok.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield b.loc[ok, ["a", "b"]]

    return (pairs.join(texts.select(F.col("cls").alias("a"), F.col("raw").alias("a_raw")), "a")
            .join(texts.select(F.col("cls").alias("b"), F.col("raw").alias("b_raw")), "b")
            .select("a", "a_raw", "b", "b_raw").mapInPandas(releasing(check), "a long, b long").distinct())


def spanning_links(x: pd.DataFrame, y: pd.DataFrame | None, n: int, num: int, den: int) -> list[tuple[int, int]]:
    """Links among the rows ``cls, part, raw`` of two blocks (or within one) that
    connect parts; links within what is connected by then are left out.

    Sizes of all intersections come from products of 0/1 matrices, over slabs of
    the n-grams that occur more than once.  The links do not depend on the order
    of the rows, so a task that is run again finds the same."""
    def sets(block: pd.DataFrame) -> tuple[list[int], list[int], list[np.ndarray]]:
        out = ([], [], [])
        block = block.sort_values("cls")
        for cls, part, raw in zip(block["cls"].tolist(), block["part"].tolist(), block["raw"], strict=True):
            grams = ngram_set(raw, n)
            if set_code(grams) == cls:  # else another text with the same row key
                for column, value in zip(out, (cls, part, grams), strict=True):
                    column.append(value)
        return out

    codes, parts, grams = sets(x)
    split = len(codes)
    if y is not None:
        codes, parts, grams = (u + v for u, v in zip((codes, parts, grams), sets(y), strict=True))
    if not codes:
        return []
    size = np.array([len(g) for g in grams], dtype=np.int64)
    _, gram, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(grams)), size)
    again = times[gram] > 1
    row, gram = row[again], (np.cumsum(times > 1) - 1)[gram[again]]
    rows, columns = (slice(0, split), slice(split, None)) if y is not None else (slice(None), slice(None))
    both = np.zeros((len(grams[rows]), len(grams[columns])), np.float32)
    by = np.argsort(gram, kind="stable")
    row, gram = row[by], gram[by]
    for lo in range(0, int(gram[-1]) + 1 if len(gram) else 0, SLAB):
        some = slice(*np.searchsorted(gram, [lo, lo + SLAB]))
        has = np.zeros((len(grams), SLAB), np.float32)
        has[row[some], gram[some] - lo] = 1
        both += has[rows] @ has[columns].T
    union = size[rows][:, None] + size[columns][None, :] - both
    i, j = np.nonzero(den * both >= num * union)
    j += split if y is not None else 0
    root: dict[int, int] = {}

    def find(part: int) -> int:
        while root.get(part, part) != part:
            root[part] = part = root.get(root[part], root[part])
        return part

    out = []
    for u, v in zip(i.tolist(), j.tolist(), strict=True):
        p, q = find(parts[u]), find(parts[v])
        if p != q:
            root[p] = q
            out.append((codes[u], codes[v]))
    return out


def _allowed(num: int, den: int):
    """Pairs ``a, b`` of hubs and classes whose sketches allow the similarity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                apart = np.abs(sketches(b["sketch"]) - sketches(b["hub_sketch"])).sum(axis=1)
                b = b[apart <= (b["size"].to_numpy(np.int64) + b["hub_size"].to_numpy(np.int64)) * (den - num) // (den + num)]
            yield pd.DataFrame({"a": b["hub"], "b": b["cls"]})

    return run


def _with_partners(num: int, den: int):
    """Of two blocks (or one) the classes ``hub, cls`` whose sketch allows the
    similarity with some class of another part."""

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        y = y if len(y) else x
        kept_x, kept_y = np.zeros(len(x), bool), np.zeros(len(y), bool)
        sx, sy = sketches(x["sketch"]), sketches(y["sketch"])
        size, other = x["size"].to_numpy(np.int64), y["size"].to_numpy(np.int64)
        part, others = x["part"].to_numpy(), y["part"].to_numpy()
        step = max(1, (1 << 22) // max(1, sy.size))
        for lo in range(0, len(x), step):
            apart = np.abs(sx[lo:lo + step, None, :] - sy[None, :, :]).sum(axis=2, dtype=np.int32)
            near = (apart <= (size[lo:lo + step, None] + other[None, :]) * (den - num) // (den + num)) & (part[lo:lo + step, None] != others[None, :])
            kept_x[lo:lo + step] |= near.any(axis=1)
            kept_y |= near.any(axis=0)
        found = pd.concat([x.loc[kept_x, ["hub", "cls"]], y.loc[kept_y, ["hub", "cls"]]])
        return found.drop_duplicates()

    return lambda x, y: run(x, y)


def _block_pairs(members: DataFrame, num: int, den: int) -> DataFrame:
    """``hub, i, j``: blocks of a group that may hold similar classes of different parts."""
    blocks = members.groupBy("hub", "block").agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.min("part").alias("first"), F.max("part").alias("last"))
    x, y = blocks.alias("x"), blocks.alias("y")
    return cut(x.join(y, F.col("x.hub") == F.col("y.hub"))
               .where((F.col("x.block") <= F.col("y.block")) & (F.least("x.first", "y.first") < F.greatest("x.last", "y.last"))
                      & (F.col("x.lo") * num <= F.col("y.hi") * den) & (F.col("y.lo") * num <= F.col("x.hi") * den))
               .select(F.col("x.hub").alias("hub"), F.col("x.block").alias("i"), F.col("y.block").alias("j")))


def _group_links(ranked: DataFrame, classes: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links ``a, b`` that connect all similar classes which share a bucket.

    A bucket's classes belong to the group of its hub, the class with most
    signatures shared.  A group is cut into blocks of bounded size and pairs of
    blocks are compared in one task each.  In groups of several blocks, the
    classes similar to the hub are found first and put next to each other, so
    that blocks of such classes alone need no comparison.

    Most classes meet by chance.  Blocks are therefore compared by sketches first:
    sets differ in at least as many elements as their sketches, so only a class
    with some partner that its sketch allows takes its text to the group."""
    hubs = ranked.groupBy("key").agg(F.max(F.struct("degree", "size", "cls")).alias("hub")).select("key", F.col("hub.cls").alias("hub"), F.col("hub.size").alias("hub_size"))
    groups = cut(ranked.join(hubs, "key").groupBy("hub", "cls").agg(F.max("size").alias("size"), F.max("hub_size").alias("hub_size"))
                 .join(classes, "cls"))
    weight = F.greatest("size", F.lit(LEAST_WEIGHT))
    large = groups.groupBy("hub").agg(F.sum(weight).alias("w")).where(F.col("w") > BLOCK_WEIGHT).select("hub")
    stars = groups.join(large, "hub").where("cls <> hub").where(_similar("size", "hub_size", num, den))
    other = classes.select(F.col("cls").alias("hub"), F.col("sketch").alias("hub_sketch"))
    stars = stars.select("hub", "cls", "size", "hub_size", "sketch").join(other, "hub").mapInPandas(releasing(_allowed(num, den)), "a long, b long")
    links = cut(_verified(stars, classes, docs, n, num, den))
    before = Window.partitionBy("hub").orderBy("part", "size", "cls").rowsBetween(Window.unboundedPreceding, -1)
    members = cut(groups.join(links.select(F.col("a").alias("hub"), F.col("b").alias("cls"), F.col("a").alias("part")), ["hub", "cls"], "left")
                  .withColumn("part", F.coalesce("part", "cls"))
                  .withColumn("block", F.floor(F.coalesce(F.sum(weight).over(before), F.lit(0)) / BLOCK_WEIGHT)))
    pairs = _block_pairs(members, num, den)
    left = members.join(pairs.select("hub", F.col("i").alias("block"), "i", "j"), ["hub", "block"]).select("hub", "i", "j", "cls", "part", "size", "sketch")
    right = members.join(pairs.where("i < j").select("hub", F.col("j").alias("block"), "i", "j"), ["hub", "block"])
    right = right.select(*[F.col(c).alias(c) for c in ("hub", "i", "j", "cls", "part", "size", "sketch")])
    keys = ["hub", "i", "j"]
    some = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_with_partners(num, den), "hub long, cls long").distinct()
    members = cut(members.drop("sketch").join(some, ["hub", "cls"]))
    pairs = _block_pairs(members, num, den)
    texts = _first_texts(docs, members).join(members.select("cls", "part", "hub", "block", "first_row"), "first_row")
    left = texts.join(pairs.select("hub", F.col("i").alias("block"), "i", "j"), ["hub", "block"]).select("hub", "i", "j", "cls", "part", "raw")
    right = texts.join(pairs.where("i < j").select("hub", F.col("j").alias("block"), "i", "j"), ["hub", "block"])
    right = right.select(*[F.col(c).alias(c) for c in ("hub", "i", "j", "cls", "part", "raw")])  # columns apart from the left side's

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(spanning_links(x, y if len(y) else None, n, num, den), columns=["a", "b"], dtype="int64")

    return links.union(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "a long, b long"))


def _components(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents ``doc_id, n_shingles, cls, row``, classes ``cls, first_doc,
    first_row`` (their least doc_id, null last) and ``cls, root, root_rank`` of
    the classes that may link with others; the root has the least first_doc."""
    texts = keyed(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes("text").alias("raw"), "row")
    rows = texts.mapInArrow(releasing(_indexed(n, num, den)), "key long, cls long, size int, kind int, id long, sketch binary")
    bucket = Window.partitionBy("key")
    found = cut(rows.withColumn("lo", F.min("cls").over(bucket)).withColumn("hi", F.max("cls").over(bucket)).withColumn("top", F.max("kind").over(bucket))
                .where("kind = 0 or (lo < hi and top = 2)").drop("lo", "hi", "top"))
    members = found.where("kind = 0").select(F.col("id").alias("doc_id"), F.col("size").cast("long").alias("n_shingles"), "cls", F.col("key").alias("row"), "sketch")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    classes = members.where("n_shingles > 0").groupBy("cls").agg(first, F.first("sketch").alias("sketch")).select(
        "cls", F.col("first.doc_id").alias("first_doc"), F.col("first.row").alias("first_row"), "sketch")
    shared = found.where("kind > 0").groupBy("key", "cls").agg(F.max("size").alias("size"))
    degree = shared.groupBy("cls").agg(F.count(F.lit(1)).alias("degree"))
    ranked = cut(shared.join(degree, "cls"))
    nodes = ranked.select("cls").distinct().join(classes, "cls").select(F.col("cls").alias("node"), F.col("first_doc").alias("rank"))
    parts = connected(nodes, _group_links(ranked, classes, texts, n, num, den))
    return members.drop("sketch"), classes.drop("sketch"), parts.select(F.col("node").alias("cls"), "root", "root_rank")


def jaccard_components(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each document; documents link when
    ``den * |intersection| >= num * |union|`` of their word n-gram sets."""
    members, classes, parts = _components(docs, n, num, den)
    return (members.join(classes, "cls", "left").join(parts.drop("root"), "cls", "left")
            .select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id"))
                    .otherwise(F.coalesce("root_rank", "first_doc")).alias("component_id")))


def one_of_each(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """``docs`` with all columns: of linked rows the one with the least doc_id
    stays (null last; then the least key of doc_id and text); of rows equal in
    both, the least by the other columns.  Rows without n-grams all stay."""
    names, row = docs.columns, free_name(docs, "_row")
    rows, columns = keyed(docs, row), [F.col(f"`{c}`") for c in names]
    members, classes, parts = _components(docs, n, num, den)
    judged = cut(members.where("n_shingles > 0").groupBy("cls", "row").agg(F.count(F.lit(1)).alias("copies"))
                 .join(classes, "cls").join(parts, "cls", "left")
                 .select("row", "copies", ((F.col("row") == F.col("first_row")) & (F.coalesce("root", "cls") == F.col("cls"))).alias("stays")))
    several = judged.where("stays and copies > 1").select(F.col("row").alias(row))
    rest = without_ids(rows, row, judged.where("not stays or copies > 1"), "row").select(*columns)
    # no semi-join: the optimizer would put it below the bitmap, and all rows into its shuffle
    least = (in_bitmap(rows, row, several, row).join(several.distinct(), row)
             .groupBy(row).agg(F.min(F.struct(*columns)).alias("least")))
    return rest.unionByName(least.select(*[F.col("least").getField(c).alias(c) for c in names]))
