"""Alert views derived from the driver's test tables.

The test tables hold no security logs, so ``alerts_view`` maps each ``events``
row to one alert with a deterministic rule (attribute values are picked from
fixed lists by the row's keys; no rows are dropped).  The same mapping is
written in DuckDB SQL in :data:`ALERTS_V_SQL` so the oracle sees identical
alerts.  The view is a pure projection of a parquet scan: it adds no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.sources.dims import EVENT_TYPES

SRC_PREFIXES = ["185.220.101.", "194.165.16.", "10.0.0.", "203.0.113.", "8.8.8.",
                "94.102.7.", "172.16.5.", "192.168.1."]
DST_PREFIXES = ["192.168.1.", "10.0.0.", "8.8.4.", "198.51.100."]
PORTS = [22, 80, 443, 445, 3389, 2222, 9999, 53, 0]
PROTOCOLS = ["tcp", "udp", "TCP", "http", "https", "smb", "rdp", "SSH", "icmp", "KERBEROS", None]
ALERT_EVENT_TYPES = [e[0] for e in EVENT_TYPES] + ["SSH_FAIL", "RDP_CONNECT"]
PROCESSES = ["mimikatz", "psexec", " bash ", "svchost.exe", "", "Netcat", "nan", "powershell",
             "PsExec", "cobalt_strike", "sshd", "meterpreter", None]
PATHS = ["/srv/hr/salary_2024_Q3_final.xlsx", "/etc/db_credentials_prod.conf", "/admin/login",
         "/backup/cloud_config.json", "/var/www/html/index.php"]

# Scoring reference time used by the registered queries.
AS_OF = "2024-01-30 12:00:00"


def _pick(values: list, idx: Column, typ: str = "string") -> Column:
    arr = F.array(*[F.lit(v).cast(typ) for v in values])
    return F.element_at(arr, (idx + F.lit(1)).cast("int"))


def _s(c: Column) -> Column:
    return c.cast("string")


def alerts_view(events: DataFrame) -> DataFrame:
    eid, uid = F.col("event_id"), F.col("user_id")
    src = (F.when(eid % 97 == 0, F.lit(None).cast("string"))
           .when(eid % 89 == 0, F.lit(""))
           .when(eid % 83 == 0, F.concat(F.lit("host-"), _s(uid)))
           .otherwise(F.concat(_pick(SRC_PREFIXES, eid % 8), _s(uid % 250 + 1))))
    dst = F.concat(_pick(DST_PREFIXES, eid % 4), _s(uid % 50 + 1))
    port = _pick(PORTS, eid % 9, "int")
    proto = _pick(PROTOCOLS, eid % 11)
    etype = _pick(ALERT_EVENT_TYPES, (eid + uid) % 20)
    path = F.when((eid % 50) < 5, _pick(PATHS, eid % 50))
    proc = _pick(PROCESSES, eid % 13)
    eid_s = _s(eid)

    def opt(mod: int, text: Column) -> Column:
        return F.when(eid % mod == 0, text)

    raw_log = F.concat_ws(
        " ",
        F.concat(F.lit("src="), F.coalesce(F.col("source_ip"), F.lit("-"))),
        F.concat(F.lit("dst="), F.col("dest_ip"), F.lit(":"), _s(F.col("port"))),
        F.concat(F.lit("proto="), F.coalesce(F.col("protocol"), F.lit("-"))),
        F.concat(F.lit("evt="), F.col("event_type")),
        F.concat(F.lit("props="), F.col("props")),
        opt(40, F.concat(F.lit("sha="), F.sha2(F.concat(F.lit("EV"), eid_s), 256))),
        opt(25, F.concat(F.lit("md5="), F.md5(F.concat(F.lit("EV"), eid_s)))),
        opt(30, F.lit("exploit CVE-2021-44228")),
        opt(45, F.lit("CVE-2019-0708")),
        opt(37, F.lit("CVE-2020-1472")),
        opt(53, F.lit("cve-2017-0144")),
        opt(7, F.concat(F.lit("callback=http://c2-"), _s(uid), F.lit(".example.ru/beacon?id="), eid_s)),
        opt(11, F.concat(F.lit("resolve=cdn"), _s(uid % 9), F.lit(".evil.xyz"))),
        opt(13, F.concat(F.lit("peer=10.1."), _s(uid % 200), F.lit("."), _s(eid % 250))),
        opt(17, F.concat(F.lit("relay=45.33.32."), _s(uid % 200))),
        opt(19, F.lit("v6=2001:db8:85a3:0:0:8a2e:370:7334")),
        opt(23, F.concat(F.lit("port="), _s(eid % 5000 + 1000))),
        opt(50, F.lit("file=salary_2024_Q3_final.xlsx")),
        opt(61, F.lit("fetched /backup/cloud_config.json")),
        opt(67, F.concat(F.lit("src2=194.165.16."), _s(uid % 100))),
        opt(29, F.concat(F.lit("via=185.221."), _s(uid % 200), F.lit(".7"))),
        opt(31, F.concat(F.lit("dup="), F.col("source_ip"))),
    )
    base = events.select(
        F.concat(F.lit("EV-"), eid_s).alias("alert_id"),
        eid.alias("event_id"),
        uid.alias("user_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        src.alias("source_ip"),
        dst.alias("dest_ip"),
        port.alias("port"),
        proto.alias("protocol"),
        etype.alias("event_type"),
        path.alias("accessed_path"),
        proc.alias("processName"),
        (F.col("value") / F.lit(500.0)).alias("severity_raw"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"),
        F.col("props"),
    )
    return base.withColumn("raw_log", raw_log).drop("props")


def load_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigil.sources.tables import read_table
    return alerts_view(read_table(spark, sf_dir, "events", parallel=True))


def _sql_list(values: list) -> str:
    out = []
    for v in values:
        if v is None:
            out.append("NULL")
        elif isinstance(v, str):
            out.append("'" + v.replace("'", "''") + "'")
        else:
            out.append(str(v))
    return "[" + ", ".join(out) + "]"


def _sql_pick(values: list, idx: str) -> str:
    return f"({_sql_list(values)})[({idx}) + 1]"


# The same alert mapping in DuckDB SQL (used by the oracle queries).
ALERTS_V_SQL = f"""
alerts_base AS (
  SELECT 'EV-' || CAST(event_id AS VARCHAR) AS alert_id, event_id, user_id,
         CAST(ts AS TIMESTAMP) AS "timestamp",
         CASE WHEN event_id % 97 = 0 THEN NULL
              WHEN event_id % 89 = 0 THEN ''
              WHEN event_id % 83 = 0 THEN 'host-' || CAST(user_id AS VARCHAR)
              ELSE {_sql_pick(SRC_PREFIXES, 'event_id % 8')} || CAST(user_id % 250 + 1 AS VARCHAR) END AS source_ip,
         {_sql_pick(DST_PREFIXES, 'event_id % 4')} || CAST(user_id % 50 + 1 AS VARCHAR) AS dest_ip,
         CAST({_sql_pick(PORTS, 'event_id % 9')} AS INTEGER) AS port,
         {_sql_pick(PROTOCOLS, 'event_id % 11')} AS protocol,
         {_sql_pick(ALERT_EVENT_TYPES, '(event_id + user_id) % 20')} AS event_type,
         CASE WHEN event_id % 50 < 5 THEN {_sql_pick(PATHS, 'event_id % 50')} END AS accessed_path,
         {_sql_pick(PROCESSES, 'event_id % 13')} AS "processName",
         value / 500.0 AS severity_raw,
         CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INTEGER) AS label,
         props
  FROM events
),
alerts_v AS (
  SELECT alert_id, event_id, user_id, "timestamp", source_ip, dest_ip, port, protocol, event_type,
         accessed_path, "processName", severity_raw, label,
         concat_ws(' ',
           'src=' || coalesce(source_ip, '-'),
           'dst=' || dest_ip || ':' || CAST(port AS VARCHAR),
           'proto=' || coalesce(protocol, '-'),
           'evt=' || event_type,
           'props=' || props,
           CASE WHEN event_id % 40 = 0 THEN 'sha=' || sha256('EV' || CAST(event_id AS VARCHAR)) END,
           CASE WHEN event_id % 25 = 0 THEN 'md5=' || md5('EV' || CAST(event_id AS VARCHAR)) END,
           CASE WHEN event_id % 30 = 0 THEN 'exploit CVE-2021-44228' END,
           CASE WHEN event_id % 45 = 0 THEN 'CVE-2019-0708' END,
           CASE WHEN event_id % 37 = 0 THEN 'CVE-2020-1472' END,
           CASE WHEN event_id % 53 = 0 THEN 'cve-2017-0144' END,
           CASE WHEN event_id % 7 = 0 THEN 'callback=http://c2-' || CAST(user_id AS VARCHAR) || '.example.ru/beacon?id=' || CAST(event_id AS VARCHAR) END,
           CASE WHEN event_id % 11 = 0 THEN 'resolve=cdn' || CAST(user_id % 9 AS VARCHAR) || '.evil.xyz' END,
           CASE WHEN event_id % 13 = 0 THEN 'peer=10.1.' || CAST(user_id % 200 AS VARCHAR) || '.' || CAST(event_id % 250 AS VARCHAR) END,
           CASE WHEN event_id % 17 = 0 THEN 'relay=45.33.32.' || CAST(user_id % 200 AS VARCHAR) END,
           CASE WHEN event_id % 19 = 0 THEN 'v6=2001:db8:85a3:0:0:8a2e:370:7334' END,
           CASE WHEN event_id % 23 = 0 THEN 'port=' || CAST(event_id % 5000 + 1000 AS VARCHAR) END,
           CASE WHEN event_id % 50 = 0 THEN 'file=salary_2024_Q3_final.xlsx' END,
           CASE WHEN event_id % 61 = 0 THEN 'fetched /backup/cloud_config.json' END,
           CASE WHEN event_id % 67 = 0 THEN 'src2=194.165.16.' || CAST(user_id % 100 AS VARCHAR) END,
           CASE WHEN event_id % 29 = 0 THEN 'via=185.221.' || CAST(user_id % 200 AS VARCHAR) || '.7' END,
           CASE WHEN event_id % 31 = 0 THEN 'dup=' || source_ip END
         ) AS raw_log
  FROM alerts_base
)"""
