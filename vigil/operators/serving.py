"""Training jobs by dataset tag, a versioned model store, and scoring with it.

``train`` runs the whole path for a dataset of ``dims.FEATURE_CONFIGS``: split, medians,
codes and scaling fitted on the training rows, oversampling of these, three candidates,
selection on the validation rows, test figures; the winner is stored as a new version.
``score`` builds the feature row of any alert table, batch or streaming: a missing
number is 0, a missing category ``unknown``, a value that training never saw has code 0.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.folders import versions
from vigil.operators import ml as ML
from vigil.operators import oversample as OV
from vigil.operators import triage as TR
from vigil.session import materialize
from vigil.sources import dims

LEAST_RECALL = 0.70


@dataclass
class Served:
    """A stored version: the fitted model, the codes table and its description."""

    model: PipelineModel
    codes: DataFrame
    about: dict


def save(spark: SparkSession, folder: str, dataset: str, model: PipelineModel, codes: DataFrame, about: dict) -> int:
    """Stores a new version; its description is written last and makes it count."""
    version = max(versions(spark, f"{folder}/{dataset}", "version", "about/_SUCCESS"), default=0) + 1
    path = f"{folder}/{dataset}/version={version}"
    model.write().overwrite().save(f"{path}/model")
    codes.write.mode("overwrite").parquet(f"{path}/codes")
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    return version


def load(spark: SparkSession, folder: str, dataset: str, version: int | None = None) -> Served:
    """The given or the newest version of a dataset's model."""
    known = versions(spark, f"{folder}/{dataset}", "version", "about/_SUCCESS")
    if not known:
        raise LookupError(f"no model is stored for {dataset}")
    path = f"{folder}/{dataset}/version={version or known[-1]}"
    return Served(PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/codes"), json.loads(spark.read.text(f"{path}/about").first()["value"]))


def _named(df: DataFrame, column: str, default: Column) -> Column:
    return F.coalesce(F.col(f"`{column}`"), default) if column in df.columns else default


def encoded(df: DataFrame, codes: DataFrame, about: dict, fill: dict[str, float] | None = None) -> DataFrame:
    """``df`` with a scaled column ``<name>_z`` per number and ``<name>_code`` per
    category, from what training fitted.  ``fill`` replaces missing numbers (0 otherwise)."""
    out = df
    for c in about["categorical"]:
        value, code = f"_{c}_value", f"{c}_code"
        table = codes.where(F.col("feature") == c).select(F.col("value").alias(value), F.col("code").cast("double").alias(code))
        text = _named(df, c, F.lit("unknown")).cast("string")
        out = out.withColumn(value, text).join(table, value, "left").withColumn(code, F.coalesce(code, F.lit(0.0))).drop(value)
    for c in about["numeric"]:
        mean, deviation = about["scaler"][c]
        number = (F.col(f"`{c}`").try_cast("double") if c in df.columns else F.lit(None).cast("double"))
        number = F.when(~F.isnan(number), number)
        out = out.withColumn(f"{c}_z", (F.coalesce(number, F.lit(float((fill or {}).get(c) or 0.0))) - F.lit(float(mean))) / F.lit(float(deviation)))
    return out


def score(df: DataFrame, served: Served) -> DataFrame:
    """``df`` with ``p_model`` (the last class), severity, confidence and ``top_features``;
    an event type with a fixed probability keeps it."""
    rows = served.model.transform(encoded(df, served.codes, served.about))
    p = vector_to_array("probability")
    rows = rows.withColumn("p_model", F.element_at(p, -1)).drop("features", "rawPrediction", "probability", "prediction", *served.about["features"])
    judged = TR.classify(rows, F.col("p_model"))
    return judged.withColumn("top_features", F.array(*[F.lit(t) for t in served.about["importance"][:3]]).cast("array<string>"))


def train(spark: SparkSession, dataset: str, df: DataFrame, folder: str, key: str = "alert_id", names: list[str] | None = None) -> dict:
    """Trains and stores a model for ``dataset``; returns its description, which
    holds the version, figures on the test rows and a warning of poor recall."""
    numeric, categorical, label = dims.FEATURE_CONFIGS[dataset]
    kept = [key, label, *numeric, *categorical]
    rows = df.select(*[F.col(f"`{c}`") for c in kept]).where(F.col(label).isNotNull())
    rows = materialize(rows.select(key, label, *[F.col(c).try_cast("double").alias(c) for c in numeric],
                                   *[F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in categorical]))
    split = materialize(ML.stratified_split(rows, key, label))
    part = {x: split.where(F.col("split") == x).drop("split") for x in ("train", "validation", "test")}
    medians = ML.fit_medians(part["train"], numeric)
    codes = None
    for c in categorical:
        codes = ML.category_codes(rows, c) if codes is None else codes.unionByName(ML.category_codes(rows, c))
    codes = materialize(codes)
    about = {"dataset": dataset, "numeric": numeric, "categorical": categorical, "features": [*(f"{c}_z" for c in numeric), *(f"{c}_code" for c in categorical)],
             "scaler": {c: list(p) for c, p in ML.fit_standardizer(ML.impute_medians(part["train"], medians), numeric).items()}}
    part = {x: materialize(encoded(d, codes, about, medians).select(key, F.col(label).cast("int").alias("label"), *about["features"])) for x, d in part.items()}
    fitted = part["train"]
    if fitted.select("label").distinct().limit(2).count() < 2:
        fitted = ML.single_class_augment(fitted, key, about["features"][:len(numeric)], "label")
    else:
        more = OV.oversampled(fitted, key, about["features"], "label")
        fitted = fitted.select("label", *about["features"]).unionByName(more.select("label", *about["features"]))
    fitted = materialize(fitted.select("label", *about["features"]))
    bins = max([32, *(r["n"] for r in codes.groupBy("feature").agg((F.max("code") + 1).cast("int").alias("n")).collect())])
    estimators = {"random_forest": RandomForestClassifier(numTrees=100, seed=ML.SPLIT_SEED, maxBins=bins),
                  "gradient_boosting": GBTClassifier(maxIter=30, maxDepth=4, seed=ML.SPLIT_SEED, maxBins=bins),
                  "logistic_regression": LogisticRegression(maxIter=3000)}
    assembler = VectorAssembler(inputCols=about["features"], outputCol="features")
    ready = {x: assembler.transform(d) for x, d in {**part, "fitted": fitted}.items()}

    def figures(model, x: str) -> dict:
        got = model.transform(ready[x]).select(F.col("label").cast("string").alias("y"), F.col("prediction").cast("int").cast("string").alias("p"))
        m = {r["class"]: r for r in ML.classification_metrics(got, "y", "p").collect()}  # a row per class and three sums
        return {"macro_f1": m["macro avg"]["f1"], "recall_1": m["1"]["recall"] if "1" in m else 0.0}

    models = {n: e.fit(ready["fitted"]) for n, e in estimators.items() if names is None or n in names}
    judged = spark.createDataFrame([(n, *figures(m, "validation").values()) for n, m in models.items()], "model string, macro_f1 double, recall_1 double")
    best = ML.select_model(judged).where("selected").first()["model"]
    test = figures(models[best], "test")
    weights = models[best].featureImportances.toArray() if hasattr(models[best], "featureImportances") else abs(models[best].coefficients.toArray())
    ranked = sorted(zip([*numeric, *categorical], weights.tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    about |= {"model": best, "importance": [n for n, _ in ranked], "importances": dict(ranked), "test": test, "poor_recall": test["recall_1"] <= LEAST_RECALL}
    about["version"] = save(spark, folder, dataset, PipelineModel([assembler, models[best]]), codes, about)
    return about
