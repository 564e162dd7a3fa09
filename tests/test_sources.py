import json
import os
import tempfile

from pyspark.sql import functions as F

from vigil.sources import logs as L


def test_flow_normalise(spark):
    df = spark.createDataFrame([("1.1.1.1", "2.2.2.2", "-", "tcp", "", "1"), ("1.1.1.1", "2.2.2.2", " 80", "udp", "Exploits", "0"),
                                ("1.1.1.1", "2.2.2.2", "0x1", "udp", None, "0")],
                               "srcip string, dstip string, dsport string, proto string, attack_cat string, Label string")
    rows = L.normalise_flow_log(df, F.current_timestamp()).collect()
    assert [r.port for r in rows] == [None, 80, None]
    assert [r.event_type for r in rows] == ["normal", "Exploits", "normal"]


def test_requests_reject_split(spark):
    d = tempfile.mkdtemp(prefix="vigil-req-")
    lines = [json.dumps({"raw_log": "x", "source_ip": "1.2.3.4", "dest_ip": "10.0.0.1", "port": 80}),
             json.dumps({"raw_log": "x", "source_ip": "not_an_ip", "dest_ip": "10.0.0.1", "port": 80}),
             json.dumps({"raw_log": "x", "source_ip": "999.1.1.1", "dest_ip": "10.0.0.1", "port": 70000}),
             "{broken"]
    with open(os.path.join(d, "r.json"), "w") as f:
        f.write("\n".join(lines))
    ok, bad = L.read_requests(spark, d)
    assert ok.count() == 1
    assert sorted(r.reject_reason for r in bad.collect()) == ["invalid IPv4 address", "port out of range", "unparsable"]


def test_ti_feed(spark):
    d = tempfile.mkdtemp(prefix="vigil-ti-")
    with open(os.path.join(d, "kb.json"), "w") as f:
        json.dump({"bad_ips": ["1.2.3.0/24"], "bad_cves": ["CVE-1"], "bad_processes": ["x"]}, f, indent=2)
    feed = L.read_ti_feed(spark, d)
    assert [r.cidr for r in feed["ti_cidr"].collect()] == ["1.2.3.0/24"]


def test_range_hits_levels(spark):
    from vigil.operators.iprange import range_hits
    ranges = spark.createDataFrame([(0, "10.0.0.0/8"), (1, "10.1.0.0/16"), (2, "10.1.2.0/24"), (3, "0.0.0.0/1")],
                                   "ord int, cidr string")
    addrs = spark.createDataFrame([(1, "10.1.2.3"), (2, "10.9.9.9"), (3, "11.0.0.1"), (4, "200.0.0.1"), (5, "bad")],
                                  "id int, ip string")
    got = {r.id: r.cidr for r in range_hits(addrs, ranges, "ip", keys=["id"]).collect()}
    assert got == {1: "10.0.0.0/8", 2: "10.0.0.0/8", 3: "0.0.0.0/1"}


def test_encoding_detection_and_labels(spark):
    d = tempfile.mkdtemp(prefix="vigil-enc-")
    with open(os.path.join(d, "a.csv"), "wb") as f:
        f.write("name,evil\ncaf\xe9,1\n".encode("latin-1"))
    assert L.detect_encoding(spark, d) == "ISO-8859-1"
    d2 = tempfile.mkdtemp(prefix="vigil-enc-")
    with open(os.path.join(d2, "a.csv"), "wb") as f:
        f.write("name,sus\ncafé,0\n".encode("utf-8"))
    assert L.detect_encoding(spark, d2) == "UTF-8"
    df = L.read_csv_logs(spark, [d], encoding="ISO-8859-1")
    assert [r.name for r in df.collect()] == ["café"]
    assert [r.label for r in L.derive_label(df).collect()] == [1]
    assert [r.label for r in L.derive_label(L.read_csv_logs(spark, [d2])).collect()] == [0]


def test_file_report(spark):
    d = tempfile.mkdtemp(prefix="vigil-files-")
    spark.range(10).write.parquet(d + "/t")
    rep = L.file_report(spark.read.parquet(d + "/t")).collect()
    assert sum(r.n_rows for r in rep) == 10 and all(r.file_size > 0 for r in rep)
