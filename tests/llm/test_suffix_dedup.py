import hashlib
import random

import numpy as np
import pytest

from vigil.llm import suffix_dedup as D


def brute(rows):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        raw = (t or "").encode()
        gone = bytearray(len(raw) + 1)
        for p in range(len(raw) - D.WINDOW + 1):
            w = raw[p:p + D.WINDOW]
            if w in seen:
                gone[p:p + D.WINDOW] = b"\1" * D.WINDOW
            seen.add(w)
        n_spans = sum(gone[i] == 1 and (i == 0 or gone[i - 1] == 0) for i in range(len(raw)))
        kept = bytes(x for x, g in zip(raw, gone, strict=False) if not g)
        out.append((d, len(raw), sum(gone), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    passages = [text(rng.choice([60, 98, 99, 100, 101, 130, 400, 2000])) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [text(rng.choice([0, 5, 50, 300])), rng.choice(passages), text(rng.choice([0, 1, 80])), rng.choice(passages)[rng.randrange(60):], text(rng.choice([0, 200]))]
        rows.append((rng.randrange(10_000), "".join(parts[:rng.randint(1, 5)])))
    rows += [(20_000 + i, passages[-1] + passages[3]) for i in range(30)]  # copies
    rows += [(30_000, "ab" * 400), (30_001, "ab" * 300), (30_002, "x" * 99), (30_003, "x" * 100), (30_004, "x" * 1000), (30_005, None), (30_006, ""), (30_007, "\0" * 300), (30_008, "\0" * 250 + "a")]
    rows += [(40_000, passages[0] * 3), (40_000, passages[0] * 3), (40_000, "b" + passages[5]), (None, passages[7]), (None, None)]
    return rows


@pytest.mark.parametrize(("seed", "block"), [(1, 16 << 20), (2, 4000)])
def test_against_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, block string, raw int").repartition(4)
    got = sorted((tuple(r) for r in D.repeat_digests(df).collect()), key=repr)
    assert got == brute(rows)
    texts = {}
    for r in D.without_repeats(df).collect():
        texts.setdefault(r.doc_id, []).append(hashlib.sha256(bytes(r.kept)).hexdigest())
    assert sorted((d, h) for d, hs in texts.items() for h in hs if d is not None) == sorted((g[0], g[4]) for g in got if g[0] is not None)


def test_cleaned_keeps_columns_and_clean_documents(spark):
    passage = "a passage of some words that is told twice in this small corpus, word by word, until it is long enough to count"
    rows = [(1, f"Ä first. {passage} end", "en", None), (2, f"Second é {passage} öther end", "de", 7), (3, "clean and short", None, 3), (4, None, "fr", 0), (5, passage, "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, n_chars long")
    got = {r.doc_id: tuple(r) for r in D.cleaned(df).collect()}
    assert D.cleaned(df).columns == df.columns
    assert got[1] == rows[0] and got[3] == rows[2] and got[4] == rows[3] and 5 not in got
    assert got[2] == (2, "Second éöther end", "de", 17)  # the blanks around the passage repeat too


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, block string")
    assert D.repeat_digests(empty).count() == 0 and D.cleaned(empty).count() == 0


def test_multikey_quicksort():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, size=(3000, 6)).astype(np.uint64)
    order = D.multikey_quicksort(words, small=8)
    assert words[order].tolist() == sorted(words.tolist())


def test_every_window_contains_an_anchor_chosen_by_its_bytes():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 101, size=3000).astype(np.uint8)
    at, _ = D.anchors(data)
    for p in range(0, len(data) - D.WINDOW + 1, 7):
        inside = [a - p for a in at if p <= a <= p + D.SIDE]
        own, _ = D.anchors(data[p:p + D.WINDOW])
        assert set(own.tolist()) <= set(inside) and len(own)


@pytest.mark.parametrize("settle", [1 << 20, 50])
def test_hot_keys_against_brute_force(spark, monkeypatch, settle):
    monkeypatch.setattr(D, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(D, "HOT_ROWS", 3, raising=False)
    monkeypatch.setattr(D, "SETTLED_WINDOWS", settle, raising=False)
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((tuple(r) for r in D.repeat_digests(df).collect()), key=repr) == brute(rows)


def test_a_line_in_every_document_is_dealt_out(spark, monkeypatch):
    """A line shorter than a window, between other neighbours each time, and a passage."""
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    line, passage = noise(60), noise(300)
    rows = [(i, noise(90) + line + noise(90) + passage + noise(90)) for i in range(1200)]
    monkeypatch.setattr(D, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(D, "HOT_ROWS", 100, raising=False)
    resolve = D._resolve

    def guarded(bucket):
        keys = [r[D.SIDE:D.SIDE + D.KEY] for r in bucket["around"].to_pylist() if r is not None]
        assert max((keys.count(k) for k in set(keys)), default=0) <= 100, "a key's rows are in one bucket"
        return resolve(bucket)

    monkeypatch.setattr(D, "_resolve", guarded)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((tuple(r) for r in D.repeat_digests(df).collect()), key=repr) == brute(rows)
