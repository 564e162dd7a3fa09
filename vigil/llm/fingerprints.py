"""Document fingerprints: bottom-k sketches of word-shingle hashes, by expressions only.

A sketch is the ``K`` least distinct 64-bit hashes of a text's word shingles,
ascending.  Sketches of parts merge to the sketch of the whole.  Two sketches
estimate resemblance (share of common shingles in the union), containment and
the number of distinct shingles; below ``K`` shingles the figures are exact.

Defined results: null and empty texts, and texts without words, have the empty
sketch; a text of fewer words than a shingle is one shingle; two empty sketches
have resemblance 1, an empty and another one 0; an empty sketch is contained in
any; equal texts have equal sketches; rows that share a doc_id follow each other
in order of their texts, a null doc_id comes first, and each row is fingerprinted;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import shuffle_partitions

K = 128
SHINGLE = 5
SALTS = 64
MAX_BUCKETS = 1 << 16
NO_ID = -(1 << 63)


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words between ASCII white space."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(words: str, n: int = SHINGLE) -> Column:
    """Hashes of runs of ``n`` word hashes in column ``words``; fewer are one run."""
    w = F.col(words)
    several = F.transform(F.slice(w, 1, F.greatest(F.size(w) - (n - 1), F.lit(0))),
                          lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, n)]))
    short = F.array(F.xxhash64(w))
    return F.when(F.size(w) >= n, several).when(F.size(w) > 0, short).otherwise(F.array().cast("array<bigint>"))


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, n: int = SHINGLE) -> DataFrame:
    """``df`` with the sketch of column ``text``.  Word hashes are a column of
    their own, so that the shingles index an array that is there."""
    return (df.withColumn(f"_{out}_w", word_hashes(F.col(text)))
            .withColumn(out, bottom(shingle_hashes(f"_{out}_w", n), k)).drop(f"_{out}_w"))


def merge(a: Column, b: Column, k: int = K) -> Column:
    return bottom(F.concat(a, b), k)


def merged(df: DataFrame, by: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch per group of ``by``.  Groups are first merged in ``SALTS``
    shares; a hash enters only if its sketch could put it among the least k, so
    what meets in a task is at most k hashes from each sketch of its share."""
    salt = F.pmod(F.xxhash64(sketch), F.lit(SALTS))
    one = df.select(*by, salt.alias("_salt"), F.explode(sketch).alias("_h")).distinct()
    order = Window.partitionBy(*by, "_salt").orderBy("_h")
    least = one.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= k)
    return least.groupBy(*by).agg(F.slice(F.sort_array(F.collect_set("_h")), 1, k).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both.cast("double") / F.size(union))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Exact below k, else from the k-th least hash's place among all hashes."""
    place = (F.element_at(sketch, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has."""
    union = distinct_shingles(merge(a, b, k), k)
    share = resemblance(a, b, k) * union / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share))


def as_text(sketch: Column) -> Column:
    return F.array_join(sketch.cast("array<string>"), " ")


def _bounds(docs: DataFrame, n: int) -> tuple[int | None, list[int]]:
    """The least id, and ids that cut all ids into about ``n`` equal ranges."""
    low, cuts = docs.agg(F.min("id"), F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 10_000)).first()
    return low, sorted({c for c in cuts or [] if c > low}) if n > 1 else []


def next_in_order(docs: DataFrame, buckets: int | None = None) -> tuple[DataFrame, Window]:
    """``id, text`` rows dealt to ranges of ids, and the window that orders a
    range.  A range's first rows are also guests at the end of the range before
    it, and the very first at the end of the last, so that every row meets its
    successor without one global sort; column ``guest`` marks them."""
    n = min(buckets or 4 * shuffle_partitions(docs.sparkSession), MAX_BUCKETS)
    low, cuts = _bounds(docs, n)
    if low is None:
        low = NO_ID
    array = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>") if cuts else F.array().cast("array<bigint>")
    steps = [1 << b for b in range(len(cuts).bit_length() - 1, -1, -1)]
    search = F.aggregate(F.array(*map(F.lit, steps)) if steps else F.array().cast("array<int>"), F.lit(0),
                         lambda at, step: F.when((at + step <= len(cuts)) & (F.get(array, at + step - 1) <= F.col("id")), at + step).otherwise(at))
    place = lambda bucket, guest: F.struct(bucket.cast("int").alias("bucket"), F.lit(guest).alias("guest"))
    first_of_range = (F.col("_own") > 0) & (F.get(array, F.col("_own") - 1) == F.col("id"))
    places = F.concat(F.array(place(F.col("_own"), 0)),
                      F.when(first_of_range, F.array(place(F.col("_own") - 1, 1))).otherwise(F.array().cast("array<struct<bucket:int,guest:int>>")),
                      F.when(F.col("id") == low, F.array(place(F.lit(len(cuts)), 2))).otherwise(F.array().cast("array<struct<bucket:int,guest:int>>")))
    rows = docs.withColumn("_own", search).withColumn("_at", F.explode(places)).select("*", "_at.bucket", "_at.guest").drop("_own", "_at")
    return rows, Window.partitionBy("bucket").orderBy("guest", "id", "text")


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Per document: sketches of its text and its edited text (the last quarter
    replaced by the beginning of the next document), and the resemblance of its
    sketch to the edited text's and to the next document's."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows, order = next_in_order(rows)
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    following = F.lead("text").over(order)
    rows = rows.withColumn("_next", following).withColumn("_q", quarter)
    rows = rows.withColumn("edited", F.concat(F.expr("left(text, int(n_chars) - _q)"), F.expr("left(coalesce(_next, ''), _q)")))
    rows = with_sketch(with_sketch(rows.drop("_next", "_q"), "text", "sketch", k), "edited", "edited_sketch", k)
    after = Window.partitionBy("bucket").orderBy("guest", "id", "text")
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("edited")
    rows = rows.withColumn("next_sketch", F.lead("sketch").over(after)).where("guest = 0")
    return rows.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_chars", "edited_sha256",
                       "sketch", "edited_sketch", "next_sketch")
