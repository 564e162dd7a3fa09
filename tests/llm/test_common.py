import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import ngram_join as J
from vigil.llm.common import cut, in_bitmap, keyed, without_ids


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_cut_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    sums = lambda: spark.range(20_000).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("s"))
    held = sums().join(sums().withColumnRenamed("s", "t"), "k")  # its plan lives on
    out = cut(held)
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert out.where("s = t").count() == held.where("s = t").count() == len(held.collect()) == 100


def joins(df):
    """Indentation and kind of each join in the optimized plan, in order."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    return [(len(m[1]), m[2], "_w" in line) for line in lines if (m := re.match(r"([\s:+-]*)Join (\w+)", line))]


def test_rows_pass_the_bitmap_before_they_are_joined(spark):
    """The join with the ids stands above the one with the bitmap, so that only marked rows are shuffled for it."""
    docs = keyed(spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string"))
    ids = cut(docs.where("doc_id % 7 = 0").select("row"))
    found = joins(without_ids(docs, "row", ids, "row"))
    assert [by_word for *_, by_word in found] == [True, False, True]  # unmarked rows; the others and their bitmap
    assert found[1][0] < found[2][0] and found[1][1] != "LeftAnti"


@pytest.mark.parametrize("names", [["_gone"], ["_gone", "_gone_", "_w", "a.b"]])
def test_rows_without_ids(spark, names):
    """Repeated rows, repeated and null ids, a null key, columns named like the helper's own."""
    rows = [(k, *[f"{n}{i}" for n in names]) for i, k in enumerate([*range(300), 5, 5, 6, None, None])]
    df = spark.createDataFrame(rows, ", ".join(["key long", *(f"`{n}` string" for n in names)])).repartition(3)
    ids = spark.createDataFrame([(k,) for k in (5, 5, 7, 299, 4000, None)], "id long")
    got = without_ids(df, "key", ids, "id")
    assert got.columns == df.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(r) for r in rows if r[0] not in (5, 7, 299))
    marked = {r.key for r in in_bitmap(df, "key", ids, "id").collect()}
    assert {5, 7, 299} <= marked and None not in marked


def test_unrelated_sets_share_no_probed_key():
    """Sets of which no two have an element in common: a probe of segments that are empty would meet many of them."""
    rng, rule = np.random.default_rng(3), J.Partitioning(80, 100)
    indexed, probed = [], []
    for low, high in ((430, 540), (1_400, 1_800), (4_900, 6_200)):
        for i in range(60):
            keys, probes = rule.signatures(np.unique(rng.integers(0, 1 << 63, size=(low, high)[i % 2], dtype=np.uint64)))
            indexed.append(np.unique(keys))
            probed.append(np.unique(keys[probes]))
    keys, times = np.unique(np.concatenate(indexed), return_counts=True)
    met = sum(int((times[np.searchsorted(keys, p)] > 1).sum()) for p in probed)
    assert met < 20
