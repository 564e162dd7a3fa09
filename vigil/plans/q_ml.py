"""Learning-pipeline queries on the labelled document table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import ml as ML
from vigil.operators import oversample as OV
from vigil.operators import triage as TR
from vigil.operators import serving as SV
from vigil.plans import oracle_sql as O
from vigil.plans.common import table, verified_alerts
from vigil.sources import dims

NUMERIC, CATEGORICAL, LABEL = ["n_chars"], ["lang", "source"], "quality"


def training_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    # rows without a label cannot train (filter pushed to the labels scan)
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").dropna(subset=[LABEL])


def dataset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ML.dataset_report(training_table(spark, sf_dir), LABEL, expected=NUMERIC + CATEGORICAL + [LABEL])


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    # The unlabelled group is kept as its own row (label -1, is_labeled false).
    return d.groupBy(F.coalesce("quality", F.lit(-1)).alias("label"), F.col("quality").isNotNull().alias("is_labeled")) \
            .agg(F.count(F.lit(1)).alias("n"))


def feature_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ML.exact_median(table(spark, sf_dir, "documents"), "n_chars", ["lang"])


def _split(spark, sf_dir) -> DataFrame:
    return ML.stratified_split(training_table(spark, sf_dir), "doc_id", LABEL)


def train_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).groupBy("split", F.col(LABEL).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def oversampled_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic rows that level the classes of the training split; the other
    splits are left as they are.  Categories take part as their codes."""
    from vigil.session import materialize
    train = materialize(_split(spark, sf_dir).where(F.col("split") == "train"))
    for c in CATEGORICAL:
        codes = ML.category_codes(train, c).select(F.col("value").alias(c), F.col("code").alias(f"{c}_code"))
        train = train.join(codes, c)
    features = [*NUMERIC, *(f"{c}_code" for c in CATEGORICAL)]
    made = OV.oversampled(train.select("doc_id", LABEL, *features), "doc_id", features, LABEL)
    return made.select(F.col(LABEL).alias("label"), "draw", "base", "neighbour", *[F.round(c, 6).alias(c) for c in features])


def feature_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _split(spark, sf_dir)
    params = ML.fit_standardizer(s.where(F.col("split") == "train"), NUMERIC)
    z = ML.standardize(s, params, "_z")
    return z.select("doc_id", "split", F.round("n_chars_z", 6).alias("z_n_chars"))


def label_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = training_table(spark, sf_dir)
    return reduce(DataFrame.unionByName, [ML.category_codes(t, c) for c in CATEGORICAL])


def classifier_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = TR.apply_decoy_override(TR.detect_decoys(TR.classify(verified_alerts(spark, sf_dir))))
    p = v.select("label", F.when(F.col("severity").isin("HIGH", "CRITICAL"), 1).otherwise(0).alias("prediction"))
    m = ML.classification_metrics(p, "label", "prediction")
    return m.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support", "tp")


def _label_metrics(pred: DataFrame) -> DataFrame:
    m = ML.classification_metrics(pred.select(F.col(LABEL).cast("string").alias("y"),
                                              F.col("prediction").cast("int").cast("string").alias("p")), "y", "p")
    return m.groupBy().agg(F.max(F.when(F.col("class") == "macro avg", F.col("f1"))).alias("macro_f1"),
                           F.max(F.when(F.col("class") == "1", F.col("recall"))).alias("recall_1"))


def model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit the three candidates, score the validation split and select; the
    selected pipeline is saved to the shared folder, loaded back and scored
    on the test split; tree models report their top-3 features."""
    from pyspark.ml import PipelineModel
    from vigil.session import shared_path
    s = _split(spark, sf_dir)
    train, val, test = (s.where(F.col("split") == x) for x in ("train", "validation", "test"))
    fitted, scored, feats = ML.train_candidates(train, val, NUMERIC, CATEGORICAL, LABEL, key_col="doc_id")
    rows = [_label_metrics(pred).select(F.lit(name).alias("model"), "*") for name, pred in scored.items()]
    sel = ML.select_model(reduce(DataFrame.unionByName, rows).fillna(0.0, ["recall_1"]))
    best = sel.where("selected").first()["model"]
    path = shared_path(spark, "model")
    fitted[best].write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    test_m = _label_metrics(loaded.transform(test)).first()
    importances = {}
    for name, model in fitted.items():
        est = model.stages[-1]
        if hasattr(est, "featureImportances"):
            imp = est.featureImportances.toArray().tolist()
            top = sorted(zip(feats, imp), key=lambda t: (-t[1], t[0]))[:3]
            importances[name] = ",".join(f for f, _ in top)
    imp_map = F.create_map(*[x for k, v in importances.items() for x in (F.lit(k), F.lit(v))]) if importances else None
    return sel.select(
        "model", "macro_f1", "recall_1", "tier", "selected",
        F.when(F.col("selected"), F.lit(test_m["macro_f1"])).alias("test_macro_f1"),
        F.when(F.col("selected"), F.lit(test_m["recall_1"])).alias("test_recall_1"),
        (F.try_element_at(imp_map, F.col("model")) if imp_map is not None else F.lit(None).cast("string")).alias("top_features"))


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trains and stores a model of the alerts' host-log features, loads it by its
    dataset and scores every alert with it, some with processes it never saw and
    some without a severity.  Event types with a fixed probability show it; for the
    others the model's own figures are checked for their form."""
    from vigil.plans.common import alerts
    from vigil.session import materialize, shared_path
    folder = shared_path(spark, "models")
    a = materialize(alerts(spark, sf_dir).select("alert_id", "event_id", "event_type", "processName", "severity_raw", "label"))
    SV.train(spark, "beth", a, folder)
    given = a.withColumn("processName", F.when(F.col("event_id") % 10 == 0, F.lit("never-seen")).otherwise(F.col("processName")))
    given = given.withColumn("severity_raw", F.when(F.col("event_id") % 7 != 0, F.col("severity_raw")))
    path = shared_path(spark, "predictions")
    SV.score(given.drop("label"), SV.load(spark, folder, "beth")).write.parquet(path)
    s = spark.read.parquet(path)
    fixed = F.col("event_type").isin(*[e for _, events in dims.EVENT_PROBABILITY_GROUPS for e in events])
    sound = F.col("p_model").between(0, 1) & (F.size("top_features") == 3) & F.col("severity").isNotNull() & (fixed | (F.col("confidence") == F.round("p_model", 4)))
    return s.select("alert_id", "event_type", F.when(fixed, F.col("severity")).otherwise(F.lit("by model")).alias("severity"),
                    F.when(fixed, F.col("confidence")).otherwise(F.lit(-1.0)).alias("confidence"), sound.alias("sound"))


QUERIES = {
    "model_scores": model_scores,
    "dataset_report": dataset_report,
    "label_counts": label_counts,
    "feature_medians": feature_medians,
    "train_split": train_split,
    "feature_scaling": feature_scaling,
    "oversampled_train": oversampled_train,
    "label_encoding": label_encoding,
    "classifier_metrics": classifier_metrics,
    "model_selection": model_selection,
}

_TT = "tt AS (SELECT d.doc_id, d.n_chars, d.lang, d.source, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
_SPLIT = _TT + """,
sp AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42')) - 1 AS pos,
         count(*) OVER (PARTITION BY quality) AS n FROM tt),
sp1 AS (SELECT *, CAST(ceil(n * 0.30) AS BIGINT) AS n_temp FROM sp),
sp2 AS (SELECT *, CASE WHEN pos < n - n_temp THEN 'train'
                       WHEN pos < n - n_temp + (n_temp - CAST(ceil(n_temp / 2.0) AS BIGINT)) THEN 'validation'
                       ELSE 'test' END AS split FROM sp1)"""
_MET = O.scored_ctes() + """,
pr AS (SELECT label AS y, CASE WHEN severity IN ('HIGH', 'CRITICAL') THEN 1 ELSE 0 END AS p FROM sc),
cls AS (SELECT y AS c FROM pr UNION SELECT p FROM pr),
per AS (SELECT c, count(CASE WHEN y = c AND p = c THEN 1 END) AS tp, count(CASE WHEN y = c THEN 1 END) AS support,
          count(CASE WHEN p = c THEN 1 END) AS predicted FROM cls, pr GROUP BY c),
m AS (SELECT c, tp, support,
        CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
        CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM per),
m2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
         support / sum(support) OVER () AS w FROM m)"""

_FIXED = "event_type IN (" + ", ".join(O.q(e) for _, events in dims.EVENT_PROBABILITY_GROUPS for e in events) + ")"

ORACLE = {
    "model_scores": "WITH " + O.ALERTS_V_SQL.strip() + f""",
p AS (SELECT alert_id, event_type, {O.p_attack_sql()} AS p, {_FIXED} AS fixed FROM alerts_v)
SELECT alert_id, event_type, CASE WHEN fixed THEN {O.tier_sql('p')} ELSE 'by model' END AS severity,
  CASE WHEN fixed THEN p ELSE -1.0 END::DOUBLE AS confidence, true AS sound FROM p""",
    "dataset_report": "WITH " + _TT + """,
cl AS (SELECT quality, count(*) AS n FROM tt GROUP BY 1)
SELECT (SELECT count(*) FROM tt) AS n_rows, 6 AS n_cols,
  CAST((SELECT count_if(doc_id IS NULL) + count_if(n_chars IS NULL) + count_if(lang IS NULL) + count_if(source IS NULL)
        + count_if(quality IS NULL) + count_if(toxic IS NULL) FROM tt) AS BIGINT) AS null_cells,
  (SELECT count(*) FROM cl) AS n_classes, CAST((SELECT min(n) FROM cl) AS BIGINT) AS min_class_rows,
  (SELECT min(n) FROM cl) / (SELECT sum(n) FROM cl) AS min_class_share,
  (SELECT min(n) FROM cl) / (SELECT sum(n) FROM cl) < 0.1 AS needs_oversampling, '' AS missing_columns""",
    "label_counts": "SELECT coalesce(l.quality, -1) AS label, l.quality IS NOT NULL AS is_labeled, count(*) AS n "
                    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL",
    "feature_medians": "SELECT lang, quantile_cont(n_chars, 0.5) AS median FROM documents GROUP BY 1",
    "train_split": "WITH " + _SPLIT + "\nSELECT split, quality AS label, count(*) AS n FROM sp2 GROUP BY ALL",
    "feature_scaling": "WITH " + _SPLIT + """,
st AS (SELECT avg(n_chars) AS m, CASE WHEN stddev_pop(n_chars) = 0 OR stddev_pop(n_chars) IS NULL THEN 1.0 ELSE stddev_pop(n_chars) END AS s
       FROM sp2 WHERE split = 'train')
SELECT doc_id, split, round((CAST(n_chars AS DOUBLE) - st.m) / st.s, 6) AS z_n_chars FROM sp2, st""",
    "oversampled_train": "WITH " + _SPLIT + """,
coded AS (SELECT doc_id, quality, CAST(n_chars AS DOUBLE) AS a, CAST(dense_rank() OVER (ORDER BY CAST(lang AS VARCHAR)) - 1 AS DOUBLE) AS b,
            CAST(dense_rank() OVER (ORDER BY CAST(source AS VARCHAR)) - 1 AS DOUBLE) AS c FROM sp2 WHERE split = 'train'),
size AS (SELECT quality, count(*) AS n, max(count(*)) OVER () AS most FROM coded GROUP BY quality),
lim AS (SELECT CASE WHEN count_if(n < most AND n <= 5) > 0 THEN 1 ELSE 5 END AS k FROM size),
tr AS (SELECT coded.*, n, most, row_number() OVER (PARTITION BY coded.quality ORDER BY doc_id) - 1 AS idx FROM coded JOIN size USING (quality) WHERE n < most),
near AS (SELECT x.doc_id, y.a AS na, y.b AS nb, y.c AS nc, row_number() OVER (PARTITION BY x.doc_id ORDER BY
           (x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.c - y.c) ** 2, y.a, y.b, y.c) AS nth FROM tr x JOIN tr y ON x.quality = y.quality AND x.doc_id <> y.doc_id),
spots AS (SELECT quality, n, unnest(range(most - n)) AS draw, k FROM size, lim WHERE n < most),
picks AS (SELECT quality, draw, CAST('0x' || substr(md5(draw || '|' || quality || '|base|42'), 1, 8) AS BIGINT) % n AS idx,
            CAST('0x' || substr(md5(draw || '|' || quality || '|neighbour|42'), 1, 8) AS BIGINT) % k + 1 AS nth,
            CAST('0x' || substr(md5(draw || '|' || quality || '|gap|42'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS gap FROM spots)
SELECT p.quality AS label, draw, tr.doc_id AS base, CAST(nth AS INTEGER) AS neighbour, round(a + gap * (na - a), 6) AS n_chars,
  round(b + gap * (nb - b), 6) AS lang_code, round(c + gap * (nc - c), 6) AS source_code
FROM picks p JOIN tr USING (quality, idx) JOIN near USING (doc_id, nth)""",
    "label_encoding": "WITH " + _TT + """
SELECT 'lang' AS feature, v AS value, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT CAST(lang AS VARCHAR) AS v FROM tt WHERE lang IS NOT NULL)
UNION ALL
SELECT 'source', v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER)
FROM (SELECT DISTINCT CAST(source AS VARCHAR) AS v FROM tt WHERE source IS NOT NULL)""",
    "classifier_metrics": _MET + """
SELECT CAST(c AS VARCHAR) AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  CAST(support AS BIGINT) AS support, CAST(tp AS BIGINT) AS tp FROM m2
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT), CAST(sum(tp) AS BIGINT) FROM m2
UNION ALL SELECT 'weighted avg', round(sum(precision * w), 6), round(sum(recall * w), 6), round(sum(f1 * w), 6), CAST(sum(support) AS BIGINT), CAST(sum(tp) AS BIGINT) FROM m2
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT), CAST(sum(tp) AS BIGINT) FROM m2""",
}
