import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vigil.llm import packing as K

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_word_ids_equal_the_library():
    from tests.llm.test_bpe import texts
    own, ref = K.WordIds(PATH), Tokenizer.from_file(PATH)
    some = [*texts(), "İ. ÀÉ, µm; ª! ﬁ. Straße? it's  'tis <|endoftext|>.", "naïve café, Ωmega."]
    for t, packed in zip(some, own.packed(some), strict=True):
        assert np.frombuffer(packed, own.dtype).tolist() == ref.encode(t, add_special_tokens=False).ids, repr(t)


def test_table_of_words_emptied(monkeypatch):
    monkeypatch.setattr(K, "KEPT_WORDS", 2)
    own, ref = K.WordIds(PATH), Tokenizer.from_file(PATH)
    some = [f"many words number {i}, again." for i in range(100)]
    assert [np.frombuffer(p, own.dtype).tolist() for p in own.packed(some)] == [ref.encode(t, add_special_tokens=False).ids for t in some]


@pytest.mark.parametrize("lengths", [[], [1], [4096], [5000, 4095, 3, 1, 1], [30_000] + [700] * 40 + [2] * 99])
def test_assignment_fills_every_place(lengths):
    pieces = list(K.assign(lengths))
    by_seq, by_doc = {}, {}
    for doc, start, length, seq, offset in pieces:
        by_seq.setdefault(seq, []).append((offset, length))
        by_doc.setdefault(doc, []).append((start, length))
    sizes = K.capacities(sum(lengths))
    assert sum(sizes) == sum(lengths) and all(s == 4096 or s & (s - 1) == 0 for s in sizes)
    for seq, parts in by_seq.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == sizes[seq]
    for doc, parts in by_doc.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == lengths[doc]


def test_costs_are_balanced():
    rng = np.random.default_rng(1)
    lengths = sorted(rng.integers(50, 2000, size=2000).tolist(), reverse=True)
    pieces = list(K.assign(lengths))
    cost = {}
    for _, _, length, seq, _ in pieces:
        cost[seq] = cost.get(seq, 0) + K.LINEAR * length + K.QUADRATIC * length * length
    full = [cost[i] for i, s in enumerate(K.capacities(sum(lengths))) if s == 4096]
    assert np.std(full) / np.mean(full) < 0.1
    assert len(pieces) < 1.5 * len(lengths)


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(K, "GROUP_BYTES", 100_000)
    ref = Tokenizer.from_file(PATH)
    rows = [(i, f"Document {i}, with words. " * (1 + i % 60)) for i in range(150)] + [(200, None), (201, ""), (202, "very long " * 20_000), (203, "same"), (203, "same"), (None, "no id")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, grp string")
    got = K.packed_documents(df, PATH).collect()
    want = {}
    for d, t in rows:
        want.setdefault(d, []).append([*ref.encode(t or "", add_special_tokens=False).ids, K.END_TOKEN])
    pieces, places = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append((r.start, list(np.frombuffer(bytes(r.ids), "<u4"))))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.length == len(r.ids) // 4 and r.doc_tokens == len(want[r.doc_id][0])
        assert zlib.crc32(bytes(r.ids)) == zlib.crc32(np.array(want[r.doc_id][0][r.start:r.start + r.length], "<u4").tobytes())
    for d, docs in want.items():
        assert sum(len(p) for _, p in pieces[d]) == sum(map(len, docs))
        if len(docs) == 1:
            assert [i for _, p in sorted(pieces[d]) for i in p] == docs[0]
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)
    assert K.packed_documents(df.limit(0), PATH).count() == 0
