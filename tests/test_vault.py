import os
import tempfile

from pyspark.sql import functions as F

from vigil.operators import vault as VT


def test_seal_and_verify(spark):
    df = spark.createDataFrame([("A1", "HIGH"), ("A1", "LOW"), ("A2", "LOW")], "alert_id string, severity string")
    s = VT.seal(df, VT.canonical_json(df), captured_at=F.lit("2024-01-01 00:00:00").cast("timestamp"))
    rows = s.collect()
    assert all(len(r.sha256) == 64 for r in rows)
    # two snapshots of one alert id have different payloads and hashes
    assert len({r.sha256 for r in rows if r.alert_id == "A1"}) == 2
    snaps = s.select("snapshot_id", "payload", "severity")
    tampered = snaps.withColumn("payload", F.when(F.col("severity") == "LOW", F.concat("payload", F.lit(" "))).otherwise(F.col("payload")))
    got = {r.status for r in VT.verify_seals(snaps, s).collect()}
    assert got == {"VERIFIED"}
    got2 = [r.status for r in VT.verify_seals(tampered, s).collect()]
    assert sorted(got2).count("TAMPERED") >= 1


def test_scan_snapshot_files(spark):
    import hashlib
    d = tempfile.mkdtemp(prefix="vigil-vault-")
    def put(name, data):
        with open(os.path.join(d, name), "wb") as f:
            f.write(data)
    body = b'{"alert_id": "X1", "severity": "HIGH"}'
    put("vault_X1_2024.json", body)
    put("vault_X1_2024.sha256", hashlib.sha256(body).hexdigest().encode())
    put("vault_X2_2024.json", body + b" ")
    put("vault_X2_2024.sha256", hashlib.sha256(body).hexdigest().encode())
    put("vault_X3_2024.sha256", b"00")
    got = {r.snapshot_id: r for r in VT.scan_snapshot_dir(spark, d).collect()}
    assert got["X1_2024"].intact and got["X1_2024"].list_status == "SECURE"
    assert not got["X2_2024"].intact
    assert got["X3_2024"].list_status == "COMPROMISED" and not got["X3_2024"].intact
