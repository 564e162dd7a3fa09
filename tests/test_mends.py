"""Cases that were once cut short: late bytes, broken files, large feeds, gaps, replays, restarts."""
import gzip

import pytest
from pyspark.sql import functions as F

from vigil.functions.text import strip
from vigil.operators import report as R
from vigil.operators.verify import verify
from vigil.sources import logs as L
from vigil.streaming import alerts_stream as S

ALERT = ("alert_id string, timestamp timestamp, source_ip string, dest_ip string, port int, protocol string, event_type string, "
         "raw_log string, iocs map<string, array<string>>")


def test_late_byte_decides_the_encoding(spark, tmp_path):
    path = tmp_path / "late.csv"
    path.write_bytes(b"name,v\n" + b"plain,1\n" * 12_000 + "caf\xe9,2\n".encode("latin-1"))
    assert L.detect_encoding(spark, str(path)) == "ISO-8859-1"
    assert L.read_csv_logs(spark, [str(path)]).where("v = 2").first().name == "café"


def test_missing_paths_are_listed_and_broken_files_raise(spark, tmp_path):
    good, broken = tmp_path / "good.csv", tmp_path / "broken"
    good.write_text("a,b\n1,2\n")
    broken.mkdir()
    (broken / "x.csv.gz").write_bytes(gzip.compress(b"a,b\n" + b"1,2\n" * 50_000)[:-200])
    skipped = []
    assert L.read_csv_logs(spark, [str(good), str(tmp_path / "none.csv")], skipped=skipped).count() == 1
    assert skipped == [str(tmp_path / "none.csv")]
    with pytest.raises(Exception):
        L.read_csv_logs(spark, [str(good), str(broken)]).count()
    with pytest.raises(FileNotFoundError):
        L.read_csv_logs(spark, [str(tmp_path / "none.csv")])


def test_row_text_holds_every_column(spark):
    df = spark.createDataFrame([("1.5", None, "x -c 'y'")], "timestamp string, args string, processName string")
    assert df.select(L.row_text(df).alias("t")).first().t == "{'timestamp': 1.5, 'args': nan, 'processName': 'x -c 'y''}"


def test_strip_takes_any_white_space(spark):
    df = spark.createDataFrame([("\tmimikatz\n  ",), (" a b ",), (None,)], "p string")
    assert [r.p for r in df.select(strip(F.col("p")).alias("p")).collect()] == ["mimikatz", "a b", None]


def test_feed_of_any_size_is_scored_like_a_list(spark):
    rows = [(f"A{i}", f"10.{i % 5}.0.{i % 250}" if i % 3 else f"203.0.{i % 200}.7", {"ipv4": [f"198.51.{i % 100}.9"], "cve": ["cve-2021-1"] if i % 7 == 0 else ["CVE-9-9"], "process": ["Tool"] if i % 11 == 0 else []}) for i in range(60)]
    df = spark.createDataFrame([(a, None, ip, "10.0.0.1", 22, "tcp", "AUTH_FAIL", "x", iocs) for a, ip, iocs in rows], ALERT)
    ranges = [f"198.51.{i}.0/24" for i in range(0, 100, 3)] + ["203.0.0.0/9", "10.1.0.0/16"]
    cves, procs = ["CVE-2021-1"], ["TOOL"]
    table = lambda values, c: spark.createDataFrame(list(enumerate(values)), f"ord int, {c} string")
    inline = verify(df, "2024-01-30 12:00:00", ti_ranges=ranges, bad_cves=cves, bad_processes=procs)
    many = ranges + [f"172.{16 + i // 256 % 16}.{i % 256}.0/24" for i in range(3000)]
    joined = verify(df, "2024-01-30 12:00:00", feed={"ti_cidr": table(many, "cidr"), "ti_cve": table(cves, "cve"), "ti_process": table(procs, "process")})
    pick = lambda v: {r.alert_id: (r.c1, r.c2, r.c3, r.confidence_score, r.evidence_trail) for r in v.collect()}
    a, b = pick(inline), pick(joined)
    assert a == b and len(b) == 60 and any(v[2] > 30 for v in b.values())


def test_last_ticks_lie_on_the_time_axis(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00", "LOW"), ("2024-01-01 00:16:40", "HIGH"), ("2024-01-01 00:18:00", "HIGH")], "t string, severity string")
    got = {r.tick: r.n_last60 for r in R.severity_ticks(df.withColumn("timestamp", F.col("t").cast("timestamp"))).collect()}
    assert got == {"2024-01-01 00:00:00": 1, "2024-01-01 00:16:40": 1, "2024-01-01 00:18:00": 2}


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_replayed_batches_are_written_once(spark, tmp_path):
    batch = spark.createDataFrame([(f"A{i}", f"2024-01-01 00:00:{i:02d}", "LOW", "VERIFIED") for i in range(10)],
                                  "alert_id string, timestamp string, severity string, verification_status string")
    out = str(tmp_path / "log")
    for _ in range(2):
        S.batch_sink(batch, 0, out)
    assert spark.read.parquet(out).count() == 10
    buffer, sink = str(tmp_path / "buffer"), S.recent_buffer_sink(12)
    for i, b in ((0, batch), (0, batch), (1, batch.withColumn("alert_id", F.concat("alert_id", F.lit("x")))), (1, batch)):
        sink(b, i, buffer)
    assert S.newest_buffer(spark, buffer).count() == 10  # batch 1 was replayed with rows that version 0 holds
    with pytest.raises(Exception):
        sink(batch, 7, buffer)  # no version 6


def test_job_resumes_after_a_stop_between_files(spark, tmp_path):
    src, job = tmp_path / "src", str(tmp_path / "job")
    make = lambda ids: spark.createDataFrame([(i, "HIGH" if i % 2 else "LOW") for i in ids], "alert_id long, severity string")
    make(range(10)).coalesce(1).write.mode("append").parquet(str(src))

    def run():
        stream = spark.readStream.schema("alert_id long, severity string").option("maxFilesPerTrigger", 1).parquet(str(src))
        return S.run_available_now(S.severity_counters(stream), "sev", "update", S.batch_sink, job=job)

    out = run()
    make(range(10, 25)).repartition(3).write.mode("append").parquet(str(src))
    assert run() == out
    assert rows_of(S.latest_per_key(spark, out, ["severity"]).select("severity", "n_alerts")) == [("HIGH", 12), ("LOW", 13)]
    S.compact_log(spark, out, ["severity"], str(tmp_path / "compact"))
    assert rows_of(S.latest_per_key(spark, str(tmp_path / "compact"), ["severity"]).select("severity", "n_alerts")) == [("HIGH", 12), ("LOW", 13)]
