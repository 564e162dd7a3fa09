import math
import random
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vigil.llm import quality as Q

SCHEMA = "doc_id long, text string, kept string"


def corpus(n=400):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("a", "en", "ort", "ing", "ul")]
    rows = []
    for i in range(n):
        some = rng.choices(words, k=rng.randint(30, 200))
        text = " ".join(some).capitalize() + "."
        if i % 5 == 0:
            text = [" ".join(w.upper() + "!!" for w in some), " ".join([some[0]] * 80), "*** ".join(some)][i // 5 % 3]
        rows.append((i, text))
    return rows


def test_held_out_documents(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i, _ in rows[:200]], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in Q.resampled(docs, labels).collect()}
    held = [i for i, _ in rows[200:]]
    assert all(got[i] for i in held if i % 5) and sum(got[i] for i in held if i % 5 == 0) <= 2
    kept = Q.accepted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}


def test_buckets_are_those_of_a_plain_count():
    assert Q.buckets(b"").tolist() == [] and len(Q.buckets(b"a")) == 1
    both = Q.buckets("two words. Two words!".encode())
    assert len(both) == len(Q.buckets(b"x words. Two words!"))
    again = np.bincount(Q.buckets(b"ha " * 50), minlength=Q.BUCKETS)
    assert again.max() >= 49  # pairs of equal words share a bucket
    assert len(Q.buckets(b"  lead")) == len(Q.buckets(b"lead")) + 0


def test_threshold():
    assert Q.best_threshold(np.array([]), np.array([1.0])) == -np.inf
    assert 0.2 < Q.best_threshold(np.array([0.3, 0.5]), np.array([-1.0, 0.2])) < 0.3
    assert Q.best_threshold(np.array([0.0, 1.0]), np.array([0.5])) <= 0.0


@pytest.mark.parametrize("k", [0, 1, 7, 500, 999, 1000])
def test_top_k_bound(spark, k):
    rng = random.Random(2)
    values = [rng.gauss(0, 1) * 10 ** rng.randint(-6, 6) for _ in range(900)] + [3.25] * 100
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert Q.top_k_bound(df, "x", k) == (sorted(values, reverse=True)[k - 1] if k else np.inf)


def test_gumbel_draw_follows_the_weights(spark):
    df = spark.range(20_000).withColumn("w", F.when(F.col("id") % 2 == 0, F.lit(0.0)).otherwise(F.lit(-1.0)))
    keyed = df.withColumn("key", Q.gumbel_key(F.col("w"), "id"))
    drawn = keyed.where(F.col("key") >= Q.top_k_bound(keyed, "key", 1000))
    heavy = drawn.where("w = 0").count()
    assert drawn.count() == 1000 and abs(heavy / 1000 - 1 / (1 + np.exp(-1))) < 0.06


def test_nulls_empty_texts_and_tables(spark):
    rows = [(1, None, ""), (2, "", ""), (None, "some text", ""), (3, "word " * 50_000, ""), (3, "word " * 50_000, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = Q.resampled(docs, none).collect()
    assert len(got) == 5 and all(r.kept for r in got)
    assert [r.log_weight for r in got if r.doc_id in (1, 2)] == [0.0, 0.0]
    assert Q.accepted(docs, none).count() == 5
    assert Q.resampled(docs.limit(0), none).count() == 0
    odd = spark.createDataFrame([(None, 1, 0), (3, None, None), (77, 0, 0)], "doc_id long, quality int, toxic int")
    assert Q.accepted(docs, odd).count() == 5


def test_noise_does_not_cross_the_threshold(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i, _ in rows[:200]], "doc_id long, quality int, toxic int")
    _, threshold = Q.weighed(docs, labels)
    got = Q.resampled(docs, labels, sharpness=0.01).collect()  # all weights below lie near the threshold
    assert {r.doc_id for r in got if r.kept} == {r.doc_id for r in got if r.log_weight >= threshold} and any(not r.kept for r in got)


def hashed(*values):
    """The 64-bit hash of a row of values, nulls left out."""
    seed = 42
    for v in values:
        raw = v if isinstance(v, bytes) else struct.pack(*v)
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed


def brute(rows, labels, share):
    """Counts, ratios, weights, threshold, keys and draw by plain loops: ``{doc_id: (weight, key, kept)}``."""
    raw, target = [0] * Q.BUCKETS, [0] * Q.BUCKETS
    for i, text in rows:
        for b in Q.buckets(text.encode()):
            raw[b] += 1
            target[b] += labels.get(i, 0)
    n_raw, n_target = sum(raw) + Q.SMOOTHING * Q.BUCKETS, sum(target) + Q.SMOOTHING * Q.BUCKETS
    ratio = [math.log((t + Q.SMOOTHING) / n_target) - math.log((r + Q.SMOOTHING) / n_raw) for r, t in zip(raw, target, strict=True)]
    weight = {}
    for i, text in rows:
        at = Q.buckets(text.encode())
        weight[i] = sum(ratio[b] for b in at) / (len(at) + Q.SHRINK)
    known = sorted((weight[i], q) for i, q in labels.items())
    errors = [(sum(10 for _, q in known[:c] if q) + sum(1 for _, q in known[c:] if not q), c) for c in range(len(known) + 1)]
    c = min(errors)[1]
    threshold = (known[c - 1][0] + known[c][0]) / 2
    keys = {}
    for i, text in rows:
        row = hashed(("<q", i), text.encode())
        u = (hashed(("<Q", row), ("<i", 20)) % (1 << 52) + 0.5) / (1 << 52)
        over = weight[i] - threshold
        keys[i] = (over if over >= 0 else over * Q.SHARPNESS - Q.STEP) - math.log(-math.log(u))
    k = math.ceil(share * sum(w >= threshold for w in weight.values()))
    last = sorted(keys.values(), reverse=True)[k - 1]
    return {i: (weight[i], keys[i], keys[i] >= last) for i, _ in rows}


@pytest.mark.parametrize("share", [1.0, 0.3])
def test_against_brute_force(spark, share):
    rows = corpus(150)
    labels = {i: int(i % 5 != 0) for i, _ in rows[:80]}
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    known = spark.createDataFrame([(i, q, 0) for i, q in labels.items()], "doc_id long, quality int, toxic int")
    want = brute(rows, labels, share)
    got = Q.resampled(docs, known, share=share).collect()
    assert len(got) == len(rows)
    for r in got:
        weight, key, kept = want[r.doc_id]
        assert math.isclose(r.log_weight, weight, abs_tol=1e-9) and math.isclose(r.gumbel_key, key, abs_tol=1e-6) and r.kept == kept


def test_a_smaller_draw_follows_the_weights(spark):
    docs = spark.createDataFrame([(i, "good plain words here" if i % 2 else "other words stand there", "x") for i in range(6000)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 6000, 2)], "doc_id long, quality int, toxic int")
    rows = Q.resampled(docs, labels, share=0.1).collect()
    kept = [r for r in rows if r.kept]
    heavy, light = (next(r.log_weight for r in rows if r.doc_id % 2 == odd) for odd in (1, 0))
    assert all(r.accepted for r in rows) and len(kept) == 600 and heavy - light > 0.5
    assert abs(sum(r.doc_id % 2 for r in kept) / 600 - 1 / (1 + math.exp(light - heavy))) < 0.08
    other = {r.doc_id for r in Q.resampled(docs, labels, share=0.1, seed=21).collect() if r.kept}
    assert other != {r.doc_id for r in kept}


def test_rows_without_an_id_are_drawn_one_by_one(spark):
    docs = spark.createDataFrame([(None, f"words of text {i}", "x") for i in range(200)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = Q.resampled(docs, none, share=0.5).collect()
    assert sum(r.kept for r in rows) == 100 and len({r.gumbel_key for r in rows}) == 200
