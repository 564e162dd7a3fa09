"""Ordered listings, the bucketed vault, the store of seen ids, quarantine, request alerts, medians at once."""
import random
import statistics

from pyspark.sql import functions as F

from vigil.operators import listing as LS
from vigil.operators import ml as ML
from vigil.operators import vault_store as VS
from vigil.sources import dims
from vigil.sources import logs as L
from vigil.streaming import alerts_stream as S


def test_pages_are_read_from_one_file(spark, tmp_path):
    rows = [(f"a{i}", None if i % 50 == 0 else f"2024-01-{i % 28 + 1:02d} 00:00:00") for i in range(500)]
    df = spark.createDataFrame(rows, "id string, at string").withColumn("at", F.col("at").cast("timestamp")).repartition(7)
    numbered = LS.ordered(df, LS.newest_first("at", "id"))
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, [-ord(c) for c in r[1] or ""], r[0]))]
    assert [r.id for r in numbered.orderBy("nth").collect()] == want
    LS.write_pages(numbered, str(tmp_path), 40)
    page = LS.read_page(spark, str(tmp_path), 3)
    assert [r.id for r in page.collect()] == want[120:160]
    assert len({r.f for r in page.select(F.input_file_name().alias("f")).collect()}) == 1
    assert "Exchange rangepartitioning" not in spark.read.parquet(f"{tmp_path}/pages").where("page = 3")._jdf.queryExecution().toString()
    assert [r.id for r in LS.read_rows(spark, str(tmp_path), 75, 83).collect()] == want[74:83]
    assert spark.read.parquet(f"{tmp_path}/index").count() == 13 and LS.read_rows(spark, str(tmp_path), 501, 600).count() == 0


def test_vault_lookup_reads_one_bucket(spark):
    rows = [(f"EV-{i % 90}", f"s{i}", "x" * (i % 5), None) for i in range(100)]
    df = spark.createDataFrame(rows, "alert_id string, snapshot_id string, payload string, sha256 string")
    name = VS.write_store(df.withColumn("sha256", F.when(F.col("snapshot_id") == "s3", F.lit("0")).otherwise(F.sha2("payload", 256))), 16)
    one = VS.lookup(spark, name, ["EV-5"])
    assert {r.snapshot_id for r in one.collect()} == {"s5", "s95"}
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # the plan names buckets only then
    try:
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        plan = VS.lookup(spark, name, ["EV-5"])._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 16" in plan
    got = VS.lookup_all(spark.createDataFrame([("EV-5",), ("EV-3",), ("EV-3",), ("EV-77",), ("gone",)], "alert_id string"), name)
    assert sorted((r.alert_id, r.snapshot_id, r.status) for r in got.collect() if r.snapshot_id) == [
        ("EV-3", "s3", "COMPROMISED"), ("EV-3", "s93", "SECURE"), ("EV-5", "s5", "SECURE"), ("EV-5", "s95", "SECURE"), ("EV-77", "s77", "SECURE")]
    assert [r.status for r in got.collect() if r.alert_id == "gone"] == ["NOT_FOUND"]


def test_seen_ids_survive_replays_and_compaction(spark, tmp_path):
    sink, out = S.unique_sink("id", ["id", "v"], compact_every=3), str(tmp_path / "out")
    batch = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "id string, v string")
    batches = [["a", "b", "a"], ["b", "c"], [], ["c", "d", "d"], ["a", "e"], ["e", "f"], ["f", "g"], ["a", "g", "h"]]
    for k, ids in enumerate(batches):
        for attempt in ("first", "again"):  # every batch is replayed, also the compacting ones
            sink(batch(ids, f"{k} {attempt}"), k, out)
    got = [(r.id, r.v) for r in spark.read.parquet(out).collect()]
    assert sorted(i for i, _ in got) == list("abcdefgh") and all(v.endswith("again") for _, v in got)
    store = S.SeenStore(spark, f"{out}-seen", "id")
    assert store.versions("base") == [5] and store.versions("batch_id") == [6, 7]
    assert sorted(r.id for r in store.before(8).collect()) == list("abcdefgh")
    assert sorted(r.id for r in S.drop_known(batch(["a", "z", "z"], ""), store.before(8), "id").collect()) == ["z"]


def test_sources_in_a_window_of_one_hot_network():
    rng = random.Random(3)
    times = sorted(rng.randrange(2_000) for _ in range(3_000))
    sources = [f"10.0.0.{rng.randrange(40)}" for _ in times]
    want = [len({s for s, u in zip(sources, times, strict=True) if t - 50 <= u <= t}) for t in times[:300]]
    assert S.sources_in_window(times, sources, 50)[:300].tolist() == want
    many = S.sources_in_window(list(range(200_000)), [i % 1000 for i in range(200_000)], 100_000)  # would not end if windows were counted anew
    assert many[-1] == 1000


def test_quarantine(spark, tmp_path):
    lines = ['{"name": "x", "n": 1}', "{broken", '{"name": null, "n": 2}', "", '{"n": 3}', '{"name": "y", "n": "no number"}', '{"name": "z"}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(str(tmp_path / "in"))
    kept = L.read_or_quarantine(spark, str(tmp_path / "in"), "name string, n int", F.col("name").isNotNull(), str(tmp_path / "aside"))
    assert kept.columns == ["name", "n"] and sorted(r.name for r in kept.collect()) == ["x", "z"]
    away = sorted((r.line, r.reason) for r in spark.read.parquet(str(tmp_path / "aside")).collect())
    assert [a for a in away if a[1] == "unparsable"] == [('{"name": "y", "n": "no number"}', "unparsable"), ("{broken", "unparsable")]
    assert len(away) == 5


def test_requests_become_alerts(spark):
    rows = [("log", "1.2.3.4", "10.0.0.1", 22, "2024-01-30T10:00:00Z", None, "/etc", None), ("log", "1.2.3.4", "10.0.0.1", 22, "soon", "X", None, "tcp")]
    req = spark.createDataFrame(rows, "raw_log string, source_ip string, dest_ip string, port int, timestamp string, event_type string, accessed_path string, protocol string")
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    first, second = L.alerts_of_requests(req, now).orderBy("timestamp").collect()
    assert str(first.timestamp) == "2024-01-30 10:00:00" and str(second.timestamp) == "2024-01-30 12:00:00"
    assert first.alert_id.startswith("REQ-") and first.alert_id != second.alert_id and first.accessed_path == "/etc"
    full = L.conform(req.select("raw_log", F.lit("9").alias("port")), dims.ALERT_SCHEMA, {"iocs": F.create_map().cast("map<string,array<string>>")})
    assert full.columns == dims.ALERT_SCHEMA.fieldNames() and full.first().port == 9 and full.first().iocs == {}


def test_medians_of_many_columns(spark):
    rng = random.Random(6)
    columns = [f"c{i}" for i in range(12)] + ["none", "odd.name"]
    rows = [[rng.choice([None, rng.randint(0, 50), rng.random()]) if i < 12 else None if i == 12 else float(rng.randint(0, 9)) for i in range(14)] for _ in range(301)]
    df = spark.createDataFrame([tuple(None if v is None else float(v) for v in r) for r in rows], ", ".join(f"`{c}` double" for c in columns))
    got = ML.fit_medians(df, columns)
    for i, c in enumerate(columns):
        values = [r[i] for r in rows if r[i] is not None]
        assert got[c] == (statistics.median(values) if values else None)
    assert ML.fit_medians(df.limit(0), columns[:2]) == {"c0": None, "c1": None} and ML.fit_medians(df, []) == {}
