import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tests.llm.test_ngram_join import brute as jaccard_brute
from tests.llm.test_packing import PATH
from tests.llm.test_suffix_dedup import brute as repeats_brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, f) in enumerate(C.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        f(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(stages):
    assert [n for n, _ in C.STAGES] == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "packing"]
    for df in stages[:-1]:
        assert set(df.columns) == set(C.COLUMNS)


def test_quality_keeps_the_good(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in stages[1].select("doc_id").collect()}
    judged = {r.doc_id: r.quality for r in labels.collect()}
    assert all(d in kept for d, q in judged.items() if q == 1)
    assert sum(d in kept for d, q in judged.items() if q == 0) <= 1


def test_one_document_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    want = {d for d, _, root in jaccard_brute(rows, 5, 80, 100) if d == root}
    assert {r.doc_id for r in stages[2].collect()} == want
    texts = dict(rows)
    assert all(r.text == texts[r.doc_id] for r in stages[2].collect())


def test_repeated_passages_go(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    want = {d: (n, gone, h) for d, n, gone, _, h in repeats_brute(rows)}
    got = {r.doc_id: r.text for r in stages[3].collect()}
    assert set(got) == {d for d, (n, gone, _) in want.items() if not n or gone < n}
    before = dict(rows)
    for d, t in got.items():
        n, gone, sha = want[d]
        if not gone:
            assert t == before[d]
        elif len(t.encode()) == n - gone:
            assert hashlib.sha256(t.encode()).hexdigest() == sha
        else:  # a cut inside a character takes its other bytes along
            assert n - gone - 6 * 20 < len(t.encode()) < n - gone


def test_packing_holds_every_document(stages):
    from tokenizers import Tokenizer
    ref = Tokenizer.from_file(PATH)
    want = {r.doc_id: len(ref.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in stages[3].collect()}
    got = {r.doc_id: r.n for r in stages[4].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == want


def test_repeated_and_null_ids(spark):
    """Decisions hold for rows, not for every row with the same doc_id."""
    import random
    from tests.llm.test_quality import corpus
    from vigil.llm import quality

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(10_000)}" for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, a), (1, a), (2, a), (2, b), (None, a), (None, c), (None, c), (3, c + " end"), (None, d), (None, d), (None, d + " end"), (4, None), (4, None), (None, "")]
    docs = spark.createDataFrame([(*r, "en", "x", 1) for r in rows], schema).repartition(3)
    kept = C.near_duplicate_stage(spark, docs, SF)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    left = [x for x in got if x not in [(None, d), (None, d + " end")]]
    assert sorted(left, key=repr) == sorted([(1, a), (2, b), (3, c + " end"), (4, None), (4, None), (None, "")], key=repr)
    assert len(got) == len(left) + 1

    texts = corpus()
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i, _ in texts[:200]], "doc_id long, quality int, toxic int")
    good, bad = texts[201][1], texts[200][1]
    rows = [*texts[:200], (1000, good), (1000, bad), (None, good), (None, bad)]
    docs = spark.createDataFrame([(*r, "en", "x", 1) for r in rows], schema)
    got = [(r.doc_id, r.text) for r in quality.accepted(docs, labels).collect() if r.doc_id is None or r.doc_id == 1000]
    assert sorted(got, key=repr) == sorted([(1000, good), (None, good)], key=repr)


@pytest.mark.parametrize("names", [["_row", "_h", "_w", "_bits"], ["row", "least", "p", "a.b"]])
def test_columns_with_clashing_names_travel_through(spark, names):
    """Texts of the given table, some twice, some without words, with columns named like the stages' own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = [F.concat(F.lit(f"{n} of "), F.col("doc_id")).alias(n) for n in names]
    wide = docs.union(docs.where("doc_id < 20")).select("*", *more)
    for _, stage in C.STAGES[:3]:
        plain = {r.doc_id: r.text for r in stage(spark, docs, SF).collect()}
        got = stage(spark, wide, SF)
        assert got.columns == wide.columns
        for r in got.collect():
            assert [r[n] for n in names] == [f"{n} of {r.doc_id}" for n in names] and r.doc_id in plain


def test_an_empty_table_gives_no_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, docs, SF).count() == 0
