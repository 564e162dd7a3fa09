"""Language identification by mixtures of n-gram models.

A text is read as UTF-8 bytes, letters in lower case and every run of other ASCII
bytes one blank.  Its n-grams of one to ``LONGEST`` bytes and its words, hashed into
``BUCKETS``, are the draws of a mixture of the languages' n-gram distributions.
Expectation maximisation estimates the proportions of the languages in each text.
The set of languages is the one of best penalised likelihood among the leading ones
by proportion; ``lang_pred`` is the language of largest proportion in it.

A text whose likelihood cannot gain the penalty is settled at once: the gain of any
mixture over one language is at most the steepest slope of the likelihood there,
since it is concave.

Models are counts over all documents that may be learned from, smoothed by the
counts of all languages together.  They have ``BUCKETS`` entries a language,
whatever the corpus; only they reach the driver.

Defined results: a text that is null or has no letter is ``und`` with score 0 and no
languages, and so is every text if nothing can be learned; a null doc_id counts as an
empty text for the fold; rows that share a doc_id are judged by their own texts;
equal proportions go to the language first in order; an empty table gives no rows.
Other columns than ``doc_id``, ``text`` and ``lang`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
LONGEST = 4
VIEWS = LONGEST + 1         # each stretch of text is drawn once by every n-gram length, and by its word
BACKGROUND = 200.0          # draws by which a language's counts are pulled to those of all languages
PENALTY = 3.0               # of each further language, in units of the log of the text's length
ROUNDS = 60
ENOUGH = 1e-4               # change of a proportion that ends the rounds
UNDETERMINED = "und"
SCHEMA = "doc_id long, lang_pred string, score double, languages array<string>, proportions array<double>"
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _classes() -> np.ndarray:
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


PLAIN = _classes()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _C[1]
    return h ^ (h >> np.uint64(29))


def draws(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams, ascending, and how often each occurs."""
    data = PLAIN[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    blank = data == 32
    data = data[np.concatenate([[True], ~(blank[1:] & blank[:-1])])]
    blank = data == 32
    if len(data) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = data.astype(np.uint64)
    parts = [mixed(h[~blank] + np.uint64(1))]
    for size in range(2, LONGEST + 1):
        h = h[:-1] * np.uint64(256) + data[size - 1:]
        if not len(h):
            break
        parts.append(mixed(h * _C[0] + np.uint64(size)))
    edge = np.flatnonzero(blank)
    spread = mixed(data * _C[0] + (np.arange(len(data), dtype=np.uint64) - np.repeat(edge, np.diff(np.append(edge, len(data)))).astype(np.uint64)) * _C[2])
    total = np.cumsum(np.where(blank, np.uint64(0), spread))
    parts.append(mixed(total[edge[1:]] - total[edge[:-1]] + np.uint64(7)))
    return np.unique((np.concatenate(parts) % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def held_out(doc_id: str | Column) -> Column:
    """The fold that nothing is learned from."""
    name = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.pmod(F.crc32(F.coalesce(name, F.lit("")).cast("binary")), F.lit(3)) == 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column("lang"), b.column("text"), strict=True):
            at, n = draws(text.as_py())
            counts.setdefault(lang.as_py(), np.zeros(BUCKETS, np.int64))[at] += n
    for lang, n in counts.items():
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(n[some])], names=["lang", "bucket", "n"])


class Models:
    """N-gram distributions of the learned languages, in order of their names."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        every = counts.sum(axis=0, dtype=np.float64) + 0.5
        every /= every.sum()
        self.p = (counts + BACKGROUND * every) / (counts.sum(axis=1, keepdims=True) + BACKGROUND)
        self.share = counts.sum(axis=1) / max(counts.sum(), 1)


def learn(docs: DataFrame) -> Models:
    """Models from ``text`` and ``lang`` of the documents outside the held-out fold."""
    known = docs.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    rows = known.mapInArrow(_counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS), np.int64)
    counts[np.searchsorted(np.array(langs, dtype=object), rows["lang"].to_numpy(dtype=object)) if langs else [], rows["bucket"].to_numpy(dtype=np.int64)] = rows["n"]
    return Models(langs, counts)


def mixture(p: np.ndarray, n: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Proportions by expectation maximisation: ``p[i]`` holds the probabilities
    under language i of the draws that occur ``n`` times."""
    share, total = start, n.sum()
    for _ in range(ROUNDS):
        new = share * (p @ (n / (share @ p))) / total
        if np.abs(new - share).max() < ENOUGH:
            return new
        share = new
    return share


def likelihood(p: np.ndarray, n: np.ndarray, share: np.ndarray) -> float:
    return float(n @ np.log(share @ p)) / VIEWS


def inferred(models: Models, at: np.ndarray, n: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The selected languages of a text, largest proportion first, and their proportions."""
    p, total = models.p[:, at], int(n.sum())
    single = np.log(p) @ n / VIEWS + np.log(np.maximum(models.share, 1e-12))
    best = int(single.argmax())
    penalty = PENALTY * np.log(2 + total / VIEWS)
    if (float(((p / p[best]) @ n).max()) - total) / VIEWS <= penalty:
        return [best], np.ones(1)
    share = mixture(p, n, np.full(len(p), 1 / len(p)))
    order = np.argsort(-share, kind="stable")
    chosen, shares = [best], np.ones(1)
    value = likelihood(p[[best]], n, shares)
    for size in range(2, len(order) + 1):
        some = order[:size]
        if share[some[-1]] * total < 1:
            break
        mix = mixture(p[some], n, share[some] / share[some].sum())
        gained = likelihood(p[some], n, mix) - penalty * (size - 1)
        if gained > value:
            value, chosen, shares = gained, [int(i) for i in some], mix
    order = np.argsort(-shares, kind="stable")
    return [chosen[i] for i in order], shares[order]


def certainty(models: Models, at: np.ndarray, n: np.ndarray, lang: int) -> float:
    """How probable the language is if the text is in one language, with a grain of doubt that shrinks with its length."""
    single = np.log(models.p[:, at]) @ n / VIEWS + np.log(np.maximum(models.share, 1e-12))
    return float(1 / np.exp(single - single[lang]).sum()) if np.ptp(single) < 700 else float(single[lang] >= single.max())


def identified(docs: DataFrame, models: Models) -> DataFrame:
    """``doc_id, lang_pred, score, languages, proportions`` of every text.  The score
    is the proportion of ``lang_pred``; in a text of one language, its probability among all."""

    def judged(text: str | None) -> tuple[str, float, list[str], list[float]]:
        if text is None or not models.langs or not has_letter(text):
            return UNDETERMINED, 0.0, [], []
        at, n = draws(text)
        if not len(at):
            return UNDETERMINED, 0.0, [], []
        chosen, shares = inferred(models, at, n)
        score = float(shares[0]) if len(chosen) > 1 else certainty(models, at, n, chosen[0])
        return models.langs[chosen[0]], min(max(score, 0.0), 1.0), [models.langs[i] for i in chosen], shares.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [judged(t.as_py()) for t in b.column("text")]
            kinds = (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()))
            yield pa.record_batch([b.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))],
                                  names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def languages(docs: DataFrame) -> DataFrame:
    """Learns from ``docs`` outside the held-out fold and judges all of them."""
    return identified(docs, learn(docs)).withColumn("held_out", held_out("doc_id")).select("doc_id", "held_out", "lang_pred", "score", "languages", "proportions")
