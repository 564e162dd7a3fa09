import hashlib
import random
import re
import struct

import xxhash
from pyspark.sql import functions as F

from vigil.llm import fingerprints as P

SCHEMA = "doc_id long, text string, bucket string, guest string, id string"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def shingles(text):
    words = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in re.split(r"[\x20\x09-\x0d]+", text.lower()) if w]

    def chained(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=seed)
        return signed(seed)

    if not words:
        return set()
    return {chained(words[i:i + P.SHINGLE]) for i in range(max(1, len(words) - P.SHINGLE + 1))}


def resemblance(a, b, k):
    union = sorted(set(a) | set(b))[:k]
    return sum(x in a and x in b for x in union) / len(union) if union else 1.0


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["é", "漢字", "Ärger"]
    rows = [(3 * i + 1, " ".join(rng.choices(words, k=rng.choice([1, 3, 10, 60, 400])))) for i in range(120)]
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, rows[0][1]), (1004, "x " * 30_000), (1004, "another text with this id here"), (None, "a b c d e f")]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "b", "g", "i") for r in rows], SCHEMA)
    for buckets in (1, 7):
        ordered = sorted(((d if d is not None else P.NO_ID, t or "") for d, t in rows))
        raw, window = P.next_in_order(df.select(F.coalesce("doc_id", F.lit(P.NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text")), buckets)
        after = {(r.id, r.text): r.nxt for r in raw.withColumn("nxt", F.lead("text").over(window)).where("guest = 0").collect()}
        assert len(after) == len(rows)
        for i, key in enumerate(ordered):
            assert after[key] == ordered[(i + 1) % len(ordered)][1]
    got = P.fingerprints(df, 16).collect()
    assert len(got) == len(rows)
    by_sha = {(r.doc_id, r.edited_sha256): r for r in got}
    for i, (d, t) in enumerate(ordered):
        nxt = ordered[(i + 1) % len(ordered)][1]
        q = len(t) // 4
        edited = t[:len(t) - q] + nxt[:q]
        r = by_sha[d if d != P.NO_ID else None, hashlib.sha256(edited.encode()).hexdigest()]
        assert r.n_chars == len(t)
        assert r.sketch == sorted(shingles(t))[:16] and r.edited_sketch == sorted(shingles(edited))[:16]
        assert r.next_sketch == sorted(shingles(nxt))[:16]


def test_estimates_and_merging(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    a, b = rng.choices(words, k=2000), rng.choices(words, k=1500)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (1, None), (2, " ".join(a[:3])), (3, None)]
    df = P.with_sketch(spark.createDataFrame(rows, "part long, text string"), "text", "s")
    merged = {r.part: r for r in P.merged(df, ["part"], "s").withColumn("n", P.distinct_shingles(F.col("s"))).collect()}
    both = shingles(rows[0][1]) | shingles(rows[1][1])
    assert merged[1].s == sorted(both)[:P.K] and abs(merged[1].n / len(both) - 1) < 0.3
    assert merged[2].n == 1 and 3 not in merged  # nothing to merge
    pair = spark.createDataFrame([(" ".join(a), " ".join(a[:1000] + b))], "x string, y string")
    pair = P.with_sketch(P.with_sketch(pair, "x", "p"), "y", "q")
    r = pair.select(P.resemblance(F.col("p"), F.col("q")).alias("r"), P.containment(F.col("p"), F.col("q")).alias("c")).first()
    x, y = shingles(" ".join(a)), shingles(" ".join(a[:1000] + b))
    assert abs(r.r - len(x & y) / len(x | y)) < 0.15 and abs(r.c - len(x & y) / len(x)) < 0.25


def test_empty_and_single(spark):
    assert P.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    r = P.fingerprints(spark.createDataFrame([(5, "abcdefgh", "", "", "")], SCHEMA)).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    empty = spark.createDataFrame([([], [], [1])], "a array<bigint>, b array<bigint>, c array<bigint>")
    r = empty.select(P.resemblance(F.col("a"), F.col("b")).alias("x"), P.resemblance(F.col("a"), F.col("c")).alias("y"), P.containment(F.col("a"), F.col("c")).alias("z")).first()
    assert (r.x, r.y, r.z) == (1.0, 0.0, 1.0)
