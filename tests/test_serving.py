import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import serving as SV

COLUMNS = "alert_id string, severity_raw double, event_type string, processName string, label int"


def frame(spark, n=240):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        rows.append((f"a{i}", rng.random() / 2 + bad / 2, rng.choice(["X_UP", "X_DOWN"] if bad else ["Y", "X_UP"]), rng.choice(["nc", "sh"] if bad else ["ls", "sh", None]), int(bad)))
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("models"))
    about = [SV.train(spark, "beth", frame(spark), folder, names=["logistic_regression"]) for _ in range(2)]
    return folder, about


def test_versions(spark, stored):
    folder, about = stored
    assert [a["version"] for a in about] == [1, 2] and about[0]["test"] == about[1]["test"]
    served = SV.load(spark, folder, "beth")
    assert served.about["model"] == "logistic_regression" and set(served.about["importance"]) == {"severity_raw", "event_type", "processName"}
    assert about[0]["test"]["macro_f1"] > 0.8 and about[0]["poor_recall"] == (about[0]["test"]["recall_1"] <= 0.7)
    assert SV.load(spark, folder, "beth", 1).about == {k: v for k, v in about[0].items() if k != "version"}
    with pytest.raises(LookupError):
        SV.load(spark, folder, "unsw")


def test_defaults_and_unseen_values(spark, stored):
    served = SV.load(spark, stored[0], "beth")
    rows = spark.createDataFrame([("1", 0.5, "Y", "never", 0), ("2", None, "Y", None, 0), ("3", float("nan"), "HTTP_REQUEST", "ls", 0)], COLUMNS)
    codes = {(r.feature, r.value): r.code for r in served.codes.collect()}
    assert codes["processName", "ls"] == 0 and codes["processName", "nan"] == 1  # in order of the values, null as text
    e = {r.alert_id: r for r in SV.encoded(rows, served.codes, served.about).collect()}
    mean, deviation = served.about["scaler"]["severity_raw"]
    assert (e["1"].processName_code, e["2"].processName_code, e["3"].processName_code) == (0, 0, 0)
    assert e["2"].severity_raw_z == e["3"].severity_raw_z == pytest.approx(-mean / deviation)
    bare = SV.encoded(rows.select("alert_id"), served.codes, served.about).first()
    assert (bare.severity_raw_z, bare.event_type_code) == (pytest.approx(-mean / deviation), 0)
    s = {r.alert_id: r for r in SV.score(rows, served).collect()}
    assert s["3"].severity == "BENIGN" and s["3"].confidence == pytest.approx(0.1)  # a fixed event type
    assert s["1"].confidence == pytest.approx(s["1"].p_model, abs=5e-5) and s["1"].top_features == served.about["importance"][:3]
    assert set(rows.columns) < set(s["1"].asDict()) and "features" not in s["1"].asDict()


def test_streamed_alerts_are_scored_alike(spark, stored, tmp_path):
    served = SV.load(spark, stored[0], "beth")
    frame(spark, 50).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = (SV.score(stream, served).select("alert_id", "severity", "confidence").writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    batch = SV.score(spark.read.parquet(str(tmp_path / "in")), served).select("alert_id", "severity", "confidence")
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(batch.collect()) and batch.count() == 50


def test_one_class_only(spark, tmp_path):
    about = SV.train(spark, "beth", frame(spark, 80).withColumn("label", F.lit(0)), str(tmp_path), names=["logistic_regression"])
    assert about["poor_recall"] and SV.score(frame(spark, 5), SV.load(spark, str(tmp_path), "beth")).count() == 5
