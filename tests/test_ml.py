import pytest
from pyspark.sql import functions as F

from vigil.operators import ml as ML


def test_exact_median(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("a", 4), ("b", 5), ("b", 1), ("b", 3)], "g string, v int")
    got = {r.g: r.median for r in ML.exact_median(df, "v", ["g"]).collect()}
    assert got == {"a": 3.0, "b": 3.0}


def test_population_scaling(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (4.0,)], "x double")
    p = ML.fit_standardizer(df, ["x"])
    assert p["x"][1] == pytest.approx(1.299038, rel=1e-5)
    const = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert ML.fit_standardizer(const, ["x"])["x"][1] == 1.0


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "y int, p int")
    got = {r["class"]: r for r in ML.classification_metrics(df, "y", "p").collect()}
    assert got["1"].precision == 1.0 and got["1"].recall == 0.5
    assert got["accuracy"].precision == 0.75


def test_split_is_deterministic(spark):
    df = spark.range(1000).withColumn("s", ML.split_column(F.col("id")))
    a = {r.id: r.s for r in df.collect()}
    b = {r.id: r.s for r in df.collect()}
    assert a == b
    share = sum(1 for v in a.values() if v == "train") / 1000
    assert 0.6 < share < 0.8


def test_model_selection_rule(spark):
    m = spark.createDataFrame([("a", 0.9, 0.6), ("b", 0.86, 0.8), ("c", 0.5, 0.99)], "model string, macro_f1 double, recall_1 double")
    sel = [r.model for r in ML.select_model(m).where("selected").collect()]
    assert sel == ["b"]


def test_median_impute(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (4.0,), (4.0,)], "x double")
    med = ML.fit_medians(df, ["x"])
    assert med == {"x": 3.0}
    assert [r.x for r in ML.impute_medians(df, med).collect()] == [1.0, 2.0, 3.0, 4.0, 4.0]


def test_category_codes_distributed(spark):
    vals = [f"v{i:04d}" for i in range(500)]
    df = spark.createDataFrame([(v,) for v in vals * 2], "c string")
    got = {r.value: r.code for r in ML.category_codes(df, "c", partitions=7).collect()}
    assert got == {v: i for i, v in enumerate(sorted(vals))}


def test_exact_median_matches_pandas(spark):
    import random
    import pandas as pd
    random.seed(3)
    rows = [("hot", random.randint(0, 400)) for _ in range(3000)] + [("cold", random.randint(0, 50)) for _ in range(101)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = {r.g: r.median for r in ML.exact_median(df, "v", ["g"], partitions=5).collect()}
    exp = pd.DataFrame(rows, columns=["g", "v"]).groupby("g")["v"].median().to_dict()
    assert got == exp


def test_running_totals(spark):
    from vigil.functions.ordered import running_totals
    df = spark.createDataFrame([(i, i % 3) for i in range(200)], "k int, v int")
    got = {r.k: (r.idx, r.cum_v) for r in running_totals(df, "k", ["v"], partitions=6).collect()}
    acc = 0
    for k in range(200):
        acc += k % 3
        assert got[k] == (k, acc)


def test_single_class_augment(spark):
    df = spark.createDataFrame([(i, float(i), 0) for i in range(300)], "k int, x double, y int")
    out = ML.single_class_augment(df, "k", ["x"], "y")
    rows = out.collect()
    syn = [r for r in rows if r.y == 1]
    assert len(rows) == 300 + 15 and len(syn) == 15
    assert all(abs(r.x - r.k) < 1.0 for r in syn)          # noise is N(0, 0.1) around the drawn row
    again = sorted((r.k, r.x) for r in ML.single_class_augment(df.repartition(5), "k", ["x"], "y").collect() if r.y == 1)
    assert again == sorted((r.k, r.x) for r in syn)         # independent of partitioning
    small = spark.createDataFrame([(i, 1.0, 0) for i in range(20)], "k int, x double, y int")
    assert ML.single_class_augment(small, "k", ["x"], "y").where("y = 1").count() == 10


def test_stratified_split_exact(spark):
    rows = [(i, 1 if i % 10 < 3 else 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, y int")
    got = {(r.split, r.y): r.n for r in ML.stratified_split(df, "k", "y").groupBy("split", "y").count()
           .withColumnRenamed("count", "n").collect()}
    # class 0: 700 rows → 210 held out → 105 test / 105 validation; class 1: 300 → 90 → 45 / 45
    assert got == {("train", 0): 490, ("validation", 0): 105, ("test", 0): 105,
                   ("train", 1): 210, ("validation", 1): 45, ("test", 1): 45}


def test_saved_pipeline_takes_nulls_unseen_values_and_many_categories(spark, tmp_path):
    from pyspark.ml import PipelineModel
    rows = [(i, None if i % 9 == 0 else float(i % 2) * 3 + i % 5 * 0.1, f"c{i % 50}", i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, x double, c string, y int")
    fitted, scored, _ = ML.train_candidates(df.where("k < 200"), df.where("k >= 200"), ["x"], ["c"], "y", key_col="k")
    assert set(scored) == {"random_forest", "gradient_boosting", "logistic_regression"}
    path = str(tmp_path / "model")
    fitted["gradient_boosting"].write().save(path)
    new = spark.createDataFrame([(1, None, "never seen"), (2, 3.0, None), (3, 0.1, "c1")], "k int, x double, c string")
    got = {r.k: r.prediction for r in PipelineModel.load(path).transform(new).collect()}
    assert set(got) == {1, 2, 3} and got[2] == 1.0
