import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vigil.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return bpe.tokenizer(PATH), Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(1)
    alphabet = "aabcdehinorst  '\n\t.,!-_0123ÉéñßÄ漢字🙂\u0301 \xa0\x1c\x85\u200dΣςd'll<|>endoftx"
    yield from ("", " ", "  ", "\n\n a", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "it's we'll", "aaaab" * 400, "x" * 3000, "\0\x01")
    for i in range(2000):
        if i % 5:
            yield "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        else:
            yield "".join(chr(rng.choice([rng.randrange(32, 0x300), rng.randrange(0x300, 0xD7FF)])) for _ in range(20))


def test_same_ids_and_texts_as_the_library(both):
    own, ref = both
    for t in texts():
        want = ref.encode(t, add_special_tokens=False).ids
        packed, listed = own.encode_with_list(t)
        assert own.encode(t).tolist() == want, repr(t)
        assert listed == ",".join(map(str, want))
        assert own.decode(own.encode(t)) == ref.decode(want, skip_special_tokens=False) == t


def test_tables_emptied_half_way(both, monkeypatch):
    own, ref = bpe.Tokenizer(PATH), both[1]
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 2)
    t = "many different words that do not fit<|endoftext|> into the small table of words"
    assert own.encode(t).tolist() == ref.encode(t, add_special_tokens=False).ids


def test_data_frames(spark, both):
    rows = [(1, "hello wörld", "k"), (2, None, None), (None, "", "k"), (2, "hello wörld", "k"), (3, "long " * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    enc = bpe.encode(df, PATH)
    back = bpe.decode(enc.drop("text"), PATH)
    assert sorted(map(repr, [(r.doc_id, r.text) for r in back.collect()])) == sorted(repr((d, t or "")) for d, t, _ in rows)
    for r in bpe.round_trip_digests(df, PATH).collect():
        t = max((x[1] or "" for x in rows if x[0] == r.doc_id), key=len)
        ids = both[1].encode(t, add_special_tokens=False).ids if r.doc_id != 2 or r.n_tokens else []
        t = t if ids else ""
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.round_trip_digests(df.limit(0), PATH).count() == 0
