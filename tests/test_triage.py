from pyspark.sql import functions as F

from vigil.functions.net import slash16
from vigil.operators import triage as TR


def test_tiers(spark):
    df = spark.createDataFrame([(p,) for p in [0.0, 0.1999, 0.2, 0.4, 0.6, 0.8, 1.0, -0.1, 1.1]], "p double")
    got = [r.t for r in df.select(TR.severity_tier(F.col("p")).alias("t")).collect()]
    assert got == ["BENIGN", "BENIGN", "LOW", "MEDIUM", "HIGH", "CRITICAL", "CRITICAL", None, None]


def test_event_probability(spark):
    df = spark.createDataFrame([("HTTP_REQUEST",), ("DATA_EXFIL",), ("SSH_FAIL",), ("ICMP_FLOOD",)], "e string")
    got = [r.p for r in df.select(TR.attack_probability(F.col("e")).alias("p")).collect()]
    assert got == [0.1, 0.95, 0.3, 0.3]


def test_decoys(spark):
    rows = [("a", "", "/etc/db_credentials_prod.conf", "FILE_READ", "", None),
            ("b", "", "/admin/login", "HTTP_REQUEST", "", None),
            ("c", "", "/admin/login", "FILE_READ", "", None),
            ("d", "", "", "X", "TCP", 2222),
            ("e", "", "", "X", "tcp", 2222),
            ("f", "", "", "X", "TCP", 22),
            ("g", "got cloud_config.json", "", "X", "", None),
            ("h", "salary_2024_Q3 db_credentials_prod", "", "X", "", None)]
    df = spark.createDataFrame(rows, "id string, raw_log string, path string, ev string, proto string, port int")
    got = {r.id: r.a for r in df.select("id", TR.decoy_asset(F.col("raw_log"), F.col("path"), F.col("ev"),
                                                              F.col("proto"), F.col("port")).alias("a")).collect()}
    assert got == {"a": "HP_DB_CRED", "b": "HP_ADMIN_LOGIN", "c": None, "d": "HP_SSH_2222", "e": None, "f": None,
                   "g": "HP_CLOUD_CONFIG", "h": "HP_SALARY_FILE"}
    # without a port column the port rule cannot fire (scoring-service behaviour)
    g2 = df.select(TR.decoy_asset(F.col("raw_log"), F.col("path"), F.col("ev"), F.col("proto")).alias("a")).collect()
    assert all(r.a != "HP_SSH_2222" for r in g2)


def _log(spark, rows, fn):
    df = spark.createDataFrame(rows, "sev string, ip string, blast double, attempts int")
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return [r.l for r in df.select(fn(df, ts).alias("l")).collect()]


def test_response_machine(spark):
    rows = [("HIGH", "10.0.0.1", 50.0, 3), ("HIGH", "10.50.0.9", 75.0, 0), ("CRITICAL", "192.168.1.100", 85.0, 0),
            ("MEDIUM", "1.2.3.4", 61.0, 0), ("MEDIUM", "1.2.3.4", 60.0, 0)]
    logs = _log(spark, rows, lambda d, ts: TR.response_playbook(F.col("sev"), F.col("ip"), F.col("blast"),
                                                                F.col("attempts"), ts))
    finals = [l[-1].to_state for l in logs]
    assert finals == ["FAILED_DEFENCE", "RESOLVED", "RESOLVED", "ESCALATED_TO_L2", "RESOLVED"]
    assert [len(l) for l in logs] == [5, 4, 5, 3, 3]
    assert logs[2][3].asn_block == "192.168.0.0/16"


def test_service_machine(spark):
    rows = [("CRITICAL", "1.2.3.4", 0.0, 0), ("MEDIUM", "1.2.3.4", 5.1, 0), ("MEDIUM", "1.2.3.4", 5.0, 0)]
    logs = _log(spark, rows, lambda d, ts: TR.service_playbook(F.col("sev"), F.col("ip"), F.col("blast"), ts))
    assert [(l[-1].to_state, len(l)) for l in logs] == [("IP_BLOCKED", 2), ("ESCALATED_TO_L2", 2), ("INITIAL_TRIAGE", 1)]


def test_slash16(spark):
    df = spark.createDataFrame([("192.168.1.100",), ("x",)], "ip string")
    assert [r.b for r in df.select(slash16(F.col("ip")).alias("b")).collect()] == ["192.168.0.0/16", "0.0.0.0/16"]


def test_cacao_workflow(spark):
    df = spark.createDataFrame([("HIGH", "1.2.3.4", 0.0, 0)], "sev string, ip string, blast double, attempts int")
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp")
    wf = df.select(TR.cacao_workflow(TR.service_playbook(F.col("sev"), F.col("ip"), F.col("blast"), ts)).alias("w")).first().w
    assert [s.step_id for s in wf] == ["start--1", "action--1", "action--2", "end--2"]
    assert wf[2].on_completion == "end--2"


def test_summary_template_rounds_half_even(spark):
    df = spark.createDataFrame([(0.125,)], "c double")
    s = df.select(TR.summary_template(F.lit("HIGH"), F.lit("X"), F.lit("1.2.3.4"), F.lit(0.865), F.lit("f")).alias("s")).first().s
    assert "86%" in s or "87%" in s
    assert s.startswith("SUMMARY: A HIGH-severity X alert was triggered\nfrom 1.2.3.4")
