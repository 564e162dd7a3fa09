import random
import zlib

import numpy as np
import pytest

from vigil.llm import language_id as L

SCHEMA = "doc_id long, text string, lang string, lang_pred string"
SYLLABLES = {"aa": ["th", "in", "er", "on", "ing", "ed"], "bb": ["eau", "oi", "é", "ou", "re", "ai"], "cc": ["sch", "ber", "ein", "ä", "und", "ge"], "dd": ["ция", "на", "ов", "при", "ст", "ра"]}


def prose(rng, lang, words):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(words))


def corpus(n=600):
    rng = random.Random(4)
    langs = rng.choices(list(SYLLABLES), [6, 2, 1, 1], k=n)
    return [(i, prose(rng, lang, rng.choice([3, 20, 200])), lang, "x") for i, lang in enumerate(langs)]


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_held_out_documents(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, None if is_held_out(i) else lang, p) for i, t, lang, p in rows], SCHEMA)  # the fold's languages are not even there
    got = {r.doc_id: r for r in L.languages(df).collect()}
    assert len(got) == len(rows) and all(got[i].held_out == is_held_out(i) for i, *_ in rows)
    held = [r for r in rows if is_held_out(r[0])]
    assert len(held) > 100 and sum(got[i].lang_pred == lang for i, _, lang, _ in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 and abs(sum(r.proportions) - 1) < 1e-9 and r.languages[0] == r.lang_pred for r in got.values())


def test_only_the_text_decides(spark):
    rows = corpus(200)
    docs = spark.createDataFrame(rows, SCHEMA)
    models = L.learn(docs)
    plain = {r.doc_id: tuple(r)[1:] for r in L.identified(docs, models).collect()}
    moved = spark.createDataFrame([(1000 + i, t, "zz", "y") for i, t, _, _ in rows], SCHEMA).repartition(5)
    assert {r.doc_id - 1000: tuple(r)[1:] for r in L.identified(moved, models).collect()} == plain
    again = L.learn(docs.repartition(7))
    assert again.langs == models.langs == sorted(SYLLABLES) and (again.p == models.p).all()


def test_mixtures(spark):
    rng = random.Random(9)
    models = L.learn(spark.createDataFrame(corpus(), SCHEMA))
    texts = [prose(rng, "aa", 120) + ". " + prose(rng, "dd", 60), prose(rng, "bb", 200), prose(rng, "cc", 80) + prose(rng, "aa", 1),
             " ".join(prose(rng, x, 60) for x in ("aa", "bb", "cc", "dd"))]
    one, two, three, four = L.identified(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA), models).orderBy("doc_id").collect()
    size = [len(prose(rng, x, 3000).encode()) for x in ("aa", "dd")]
    share = 120 * size[0] / (120 * size[0] + 60 * size[1])
    assert set(one.languages) == {"aa", "dd"} and abs(dict(zip(one.languages, one.proportions, strict=True))["aa"] - share) < 0.06
    assert two.languages == ["bb"] and three.languages == ["cc"] and two.score > 0.999
    assert set(four.languages) == set(SYLLABLES)


def test_proportions_maximise_the_likelihood():
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.full(50, 0.3), size=3)
    n = rng.multinomial(4000, np.array([0.6, 0.3, 0.1]) @ p)
    some = n > 0
    p, n = p[:, some], n[some]
    share = L.mixture(p, n, np.full(3, 1 / 3))
    grid = [(a, b, 1 - a - b) for a in np.linspace(0.001, 0.998, 120) for b in np.linspace(0.001, 0.998, 120) if a + b < 0.9995]
    assert max(L.likelihood(p, n, np.array(g)) for g in grid) <= L.likelihood(p, n, share) + 1e-3
    slope = float(((p / p[0]) @ n).max()) - n.sum()  # bounds what a mixture gains over the first language
    assert L.likelihood(p, n, share) - L.likelihood(p[:1], n, np.ones(1)) <= slope / L.VIEWS


def plain_draws(text):
    text = "".join(c if c.isalpha() or ord(c) > 127 else " " for c in f" {text.lower()} ")
    data = (" " + " ".join(text.split()) + " ").encode()
    return sum(len(data) - k + 1 for k in range(2, L.LONGEST + 1) if len(data) >= k) + sum(b != 32 for b in data) + len(data.split())


@pytest.mark.parametrize("text", ["a", "Word", "two  words,\n1 2 3 MORE", "é ü", "x" * 50_000 + " y", "日本 語"])
def test_draws_are_those_of_a_plain_count(text):
    at, n = L.draws(text)
    assert int(n.sum()) == plain_draws(text) and (np.diff(at) > 0).all()


def test_defined_results(spark):
    rows = [(1, "thin eron thing", "aa", ""), (2, None, "aa", ""), (3, "", "aa", ""), (4, "12 -- 3!", "aa", ""), (None, "oieau ouré", "bb", ""), (5, "oieau réai", None, ""),
            (5, "ering thon", None, ""), (6, "thin " * 100_000, None, "")]
    got = L.languages(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "languages", "proportions"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert [by[i][0].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and by[2][0].score == 0 and by[None][0].held_out is False
    assert sorted(r.lang_pred for r in by[5]) == ["aa", "bb"] and by[6][0].lang_pred == "aa"
    assert {r.lang_pred for r in L.languages(spark.createDataFrame([(i, t, None, "") for i, t, *_ in rows], SCHEMA)).collect()} == {"und"}
    assert L.languages(spark.createDataFrame([], SCHEMA)).count() == 0
