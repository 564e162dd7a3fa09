"""Quality filter by importance resampling.

Texts are bags of hashed n-grams: n-grams of character classes (letters, case,
digits, each punctuation mark; repeats in a row count once), words, and pairs of
neighbouring words, where a pair of equal words is an n-gram of its own.  Two
generative models over the hash buckets, of target texts (labelled good) and of
raw texts (all documents), give a text's log importance weight per n-gram.

Documents are drawn without replacement by Gumbel top-k: the largest sums of log
weight and Gumbel noise, the noise being a hash of the document.  An acceptance
threshold is fitted on labelled rows.  Weights of accepted texts are their log
ratios; those below the threshold lie lower by more than the noise can make up
and fall steeply, so that they are drawn only after all accepted ones.  How many
are drawn is a share of the accepted documents: with 1 (the default) all of them,
so that a filter loses no clean text, with less a sample that follows the weights.

Labels: at most ``MAX_LABELLED`` labelled documents, a hash sample, give the
target counts and the threshold (of rows that share these ids, the first
4 x ``MAX_LABELLED`` by hash).  Raw counts run over all documents, scores over
every text in full.

Defined results: null and empty texts have no n-grams and weight 0 per n-gram,
which is that of a raw text, and are judged by it; without labels of both
classes everything is accepted; rows that share doc_id and text are drawn alike, other
rows (those without an id too) by noise of their own,
ties in the key go by doc_id and are all drawn at the boundary; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import cut, free_name, keyed, releasing, without_ids

BUCKETS = 1 << 16
CLASS_GRAMS = 4
SMOOTHING = 2.0
SHRINK = 8             # n-grams of weight 0 added to every text, so that short texts are not judged on a few
SHARPNESS = 400.0      # how fast the log weight falls below the threshold
STEP = 64.0            # by which it lies lower there at least; the noise ranges over less than 41
MAX_LABELLED = 20_000
BINS = 1024
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _classes() -> np.ndarray:
    """Class of each byte: lower-case letter or part of a longer character 1,
    capital 2, digit 3, blank 4, line end 5, other white space 4, every mark its own."""
    table = np.arange(256, dtype=np.uint64) + np.uint64(8)
    for lo, hi, cls in ((97, 122, 1), (128, 255, 1), (65, 90, 2), (48, 57, 3), (9, 32, 4)):
        table[lo:hi + 1] = cls
    table[10] = 5
    return table


CLASSES = _classes()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _C[1]
    return h ^ (h >> np.uint64(29))


def buckets(raw: bytes | pa.Buffer) -> np.ndarray:
    """Hash bucket of every n-gram of a text."""
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.empty(0, np.int64)
    cls = CLASSES[data]
    runs = cls[np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))]
    out = []
    if len(runs) >= CLASS_GRAMS:
        h = runs[:len(runs) - CLASS_GRAMS + 1].copy()
        for i in range(1, CLASS_GRAMS):
            h = mixed(h * _C[0] + runs[i:len(runs) - CLASS_GRAMS + 1 + i])
        out.append(mixed(h + np.uint64(1)))
    letter = (cls <= np.uint64(3)) | (cls > np.uint64(5))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if len(start):
        low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint64) + np.uint64(1)
        place = np.arange(len(data)) - np.repeat(start, np.diff(np.append(start, len(data)))) if start[0] == 0 else \
            np.concatenate([np.zeros(start[0], np.int64), np.arange(start[0], len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))])
        spread = mixed(low * _C[0] + place.astype(np.uint64) * _C[2])
        total = np.concatenate([[np.uint64(0)], np.cumsum(np.where(letter, spread, np.uint64(0)))])
        word = mixed(total[end] - total[start])
        out.append(mixed(word + np.uint64(2)))
        if len(word) > 1:
            pair = mixed(word[:-1] * _C[0] + word[1:])
            out.append(mixed(np.where(word[:-1] == word[1:], np.uint64(3), pair + np.uint64(4))))
    return (np.concatenate(out) % np.uint64(BUCKETS)).astype(np.int64) if out else np.empty(0, np.int64)


def _counted(good: np.ndarray):
    """Counts per bucket over all texts and over those of the ids in ``good`` (sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw_n, good_n = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            at = np.minimum(np.searchsorted(good, ids), max(len(good) - 1, 0))
            target = good[at] == ids if len(good) else np.zeros(len(ids), bool)
            for text, is_good in zip(b.column("raw"), target, strict=True):
                n = np.bincount(buckets(text.as_buffer()), minlength=BUCKETS)
                raw_n += n
                if is_good:
                    good_n += n
        some = np.flatnonzero(raw_n)
        yield pa.record_batch([pa.array(some), pa.array(raw_n[some]), pa.array(good_n[some])], names=["bucket", "raw", "target"])

    return run


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of the smoothed target probability over the raw one, per bucket."""
    p = (target + SMOOTHING) / (target.sum() + SMOOTHING * len(target))
    q = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * len(raw))
    return np.log(p) - np.log(q)


def _weighed(ratio: np.ndarray):
    """Weighs text by text: only the sum and the number of its n-grams are kept."""

    def weight(text: pa.BinaryScalar) -> tuple[float, int]:
        at = buckets(text.as_buffer())
        return ratio[at].sum() / (len(at) + SHRINK), len(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [weight(text) for text in b.column("raw")]
            yield pa.record_batch([b.column("row"), b.column("doc_id"), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64())],
                                  names=["row", "doc_id", "log_weight", "n_grams"])

    return run


def best_threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The weight that separates the labelled texts with fewest errors, in the
    middle of its gap; an error on a good text counts ten times."""
    if not len(good) or not len(bad):
        return -np.inf
    values = np.concatenate([good, bad])
    cost = np.concatenate([np.full(len(good), 10.0), np.full(len(bad), -1.0)])
    order = np.argsort(values, kind="stable")
    values, error = values[order], np.cumsum(cost[order])  # rejecting all up to here, but for a constant
    error = np.concatenate([[0.0], error])
    cutable = np.concatenate([[True], values[1:] != values[:-1], [True]])
    at = int(np.argmin(np.where(cutable, error, np.inf)))
    if at == 0:
        return float(values[0]) - 1e-9
    return float(values[-1]) + 1e-9 if at == len(values) else float((values[at - 1] + values[at]) / 2)


def weighed(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> tuple[DataFrame, float]:
    """``row, doc_id, log_weight, n_grams`` of every document (``row`` is its key
    of doc_id and text), and the fitted threshold."""
    texts = keyed(docs).select("row", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()  # bounded by ``limit``
    good = np.array(sorted(r["doc_id"] for r in known if r["quality"] > 0), dtype=np.int64)
    named = texts.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    counts = named.mapInArrow(releasing(_counted(good)), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, r, t in counts:
        raw[bucket], target[bucket] = r, t
    scored = cut(texts.mapInArrow(releasing(_weighed(log_ratio(raw, target))), "row long, doc_id long, log_weight double, n_grams long"))
    sample = docs.sparkSession.createDataFrame([(r["doc_id"], int(r["quality"])) for r in known], "doc_id long, quality int")
    by_hash = scored.join(sample, "doc_id").orderBy(F.xxhash64("row"), "row")  # rows that share an id may be more than the labels
    fitted = by_hash.select("log_weight", "quality").limit(4 * limit).toPandas() if known else pd.DataFrame({"log_weight": [], "quality": []})
    return scored, best_threshold(fitted.log_weight[fitted.quality > 0].to_numpy(), fitted.log_weight[fitted.quality == 0].to_numpy())


def gumbel_key(log_weight, *keys: str, seed: int = 20):
    """Log weight plus Gumbel noise that is a hash of ``keys``."""
    u = (F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return log_weight - F.log(-F.log(u))


def top_k_bound(df: DataFrame, key: str, k: int) -> float:
    """The k-th largest value of ``key``: the range that holds it is cut into
    ``BINS`` and counted again until it holds one value (or can't be cut)."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None or k <= 0:
        return np.inf
    above, low, high = 0, float(low), float(high)
    while low < high:
        width = (high - low) / BINS
        mid = low + width * (BINS // 2)
        if width <= 0 or mid <= low or mid >= high:
            break
        place = F.least(F.floor((F.col(key) - low) / width), F.lit(BINS - 1))
        rows = (df.where((F.col(key) >= low) & (F.col(key) <= high)).groupBy(place.alias("bin"))
                .agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect())
        for r in sorted(rows, key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                low, high = r["lo"], r["hi"]
                break
            above += r["n"]
        else:
            return low
    return low


def drawn(rows: DataFrame, share: float, out: str) -> DataFrame:
    """``out``: whether a row is among the ``share`` (of the accepted rows' number, rounded up) with the largest keys."""
    k = math.ceil(share * rows.where("accepted").count())
    return rows.withColumn(out, F.col("gumbel_key") >= top_k_bound(rows, "gumbel_key", k))


def resampled(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, sharpness: float = SHARPNESS, share: float = 1.0, seed: int = 20) -> DataFrame:
    """``row, doc_id, log_weight, n_grams, accepted, gumbel_key, kept`` of every document; ``kept`` are those drawn."""
    scored, threshold = weighed(docs, labels, limit)
    weight, passes = F.col("log_weight"), F.lit(True)
    if np.isfinite(threshold):
        over = weight - F.lit(threshold)
        weight, passes = F.when(over < 0, over * sharpness - STEP).otherwise(over), over >= 0
    rows = scored.withColumn("accepted", passes).withColumn("gumbel_key", gumbel_key(weight, "row", seed=seed))
    return drawn(cut(rows), share, "kept")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are drawn, all columns; rows that share a doc_id, or have none, are judged by their own texts."""
    row = free_name(docs, "_row")
    return without_ids(keyed(docs, row), row, resampled(docs, labels).where("not kept"), "row").select(*[F.col(f"`{c}`") for c in docs.columns])
