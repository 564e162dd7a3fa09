"""Small dimension tables and fixed rule values.

All tables here are constants of bounded size (tens of rows), so joining them
with ``broadcast`` or inlining them as literal arrays is safe at any data
scale.  Threat-intel feeds that come from data instead of this module go
through :mod:`vigil.operators.iprange`, which checks their size first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES — these must equal the reference behaviour for equal results.
# ---------------------------------------------------------------------------

# Known event types: (event_type, description, technique, inherent risk).
EVENT_TYPES = [
    ("PORT_SCAN", "Network reconnaissance", "T1046 — Service Discovery via port sweep", "HIGH"),
    ("AUTH_FAIL", "Brute-force authentication attempt", "T1110 — Credential Brute Forcing", "HIGH"),
    ("RDP_BRUTEFORCE", "Remote Desktop brute-force attack", "T1110.001 — Password Guessing via RDP", "HIGH"),
    ("KERBEROAST", "Kerberos ticket harvesting", "T1558.003 — Kerberoasting", "CRITICAL"),
    ("SMB_LATERAL", "Lateral movement via SMB shares", "T1021.002 — Remote Services: SMB", "CRITICAL"),
    ("C2_BEACON", "Command & Control beacon heartbeat", "T1071 — Application Layer Protocol C2", "CRITICAL"),
    ("C2_CALLBACK", "Active C2 callback / reverse shell", "T1071.001 — Web Protocol C2", "CRITICAL"),
    ("FILE_READ", "Sensitive file access", "T1059 — Command & Scripting Interpreter", "HIGH"),
    ("CREDENTIAL_DUMP", "OS credential harvesting", "T1003 — OS Credential Dumping", "CRITICAL"),
    ("DATA_EXFIL", "Data exfiltration attempt", "T1041 — Exfiltration Over C2 Channel", "CRITICAL"),
    ("PROCESS_SPAWN", "Suspicious child process", "T1059.003 — Windows Command Shell", "HIGH"),
    ("ICMP_PING", "ICMP host discovery sweep", "T1018 — Remote System Discovery", "LOW"),
    ("HTTP_REQUEST", "Outbound HTTP communication", "T1071.001 — Web Protocol", "LOW"),
    ("HTTP_OPTIONS", "HTTP OPTIONS probe (CORS/API recon)", "T1071.001 — Web Protocol Enumeration", "MEDIUM"),
    ("DNS_QUERY", "DNS lookup to external resolver", "T1071.004 — DNS Application Layer Protocol", "LOW"),
    ("FILE_COPY", "Bulk file copy / staging", "T1074 — Data Staged for Exfil", "MEDIUM"),
    ("VPN_FAIL", "Failed VPN authentication attempt", "T1133 — External Remote Services", "MEDIUM"),
    ("ICMP_FLOOD", "ICMP flood — potential DDoS", "T1498 — Network Denial of Service", "HIGH"),
]

# Service ports for the traffic-direction rule.
SERVICE_PORTS = [
    (21, "FTP"), (22, "SSH"), (23, "Telnet"), (25, "SMTP"), (53, "DNS"), (80, "HTTP"),
    (88, "Kerberos"), (135, "RPC"), (139, "NetBIOS"), (389, "LDAP"), (443, "HTTPS"),
    (445, "SMB"), (636, "LDAPS"), (1433, "MSSQL"), (3306, "MySQL"), (3389, "RDP"),
    (5985, "WinRM"), (5986, "WinRM-SSL"), (8080, "HTTP-Proxy"), (8443, "HTTPS-Alt"),
]

# Events exempt from the internal-to-internal rule.
DIRECTION_EXEMPT_EVENTS = ["HTTP_REQUEST", "DNS_QUERY", "FILE_COPY"]

# Accepted protocols for the structural pass (compared lower-cased).
VALID_PROTOCOLS = ["tcp", "udp", "icmp", "http", "https", "smb", "rdp", "ssh"]

# High-risk address ranges, in match order: (cidr, label).
RISK_RANGES = [
    ("185.220.0.0/14", "Tor exit node range"),
    ("94.102.0.0/16", "known C2 hosting AS"),
    ("45.33.0.0/16", "DigitalOcean VPS (threat actor infra)"),
    ("194.165.0.0/16", "bulletproof hosting range"),
    ("91.108.0.0/16", "Telegram / proxy relay range"),
]

# Shipped threat-intel knowledge base.
TI_BAD_IPS = ["185.220.101.0/24", "194.165.16.0/24", "45.33.32.0/24"]
TI_BAD_CVES = ["CVE-2021-44228", "CVE-2017-0144", "CVE-2019-0708"]
TI_BAD_PROCESSES = ["mimikatz", "psexec", "cobalt_strike", "meterpreter", "netcat"]
# Starter knowledge base written when no feed file exists.
TI_STARTER_BAD_IPS = ["185.220.101.0/24", "194.165.16.0/24", "45.33.32.0/24", "91.108.4.0/22"]

# Fixed attack probability per event type (overrides any model output).
EVENT_PROBABILITY_GROUPS = [
    (0.1, ["HTTP_REQUEST", "DNS_QUERY", "FILE_COPY"]),
    (0.3, ["PORT_SCAN", "ICMP_PING", "HTTP_OPTIONS"]),
    (0.5, ["AUTH_FAIL", "VPN_FAIL", "RDP_BRUTEFORCE"]),
    (0.7, ["SMB_LATERAL", "PROCESS_SPAWN", "KERBEROAST"]),
    (0.95, ["C2_CALLBACK", "C2_BEACON", "FILE_READ", "CREDENTIAL_DUMP", "DATA_EXFIL"]),
]
# Probability used for other event types when no model is loaded.
DEFAULT_ATTACK_PROBABILITY = 0.3

# Severity tiers in ascending order with their lower probability bound.
SEVERITY_TIERS = [("BENIGN", 0.0), ("LOW", 0.2), ("MEDIUM", 0.4), ("HIGH", 0.6), ("CRITICAL", 0.8)]

# Verification statuses by score.
STATUS_VERIFIED_MIN = 70
STATUS_UNVERIFIED_MIN = 30

# Decoy assets in rule order: (asset_id, asset_type, description).
DECOYS = [
    ("HP_SALARY_FILE", "fake_file", "salary_2024_Q3_final.xlsx"),
    ("HP_DB_CRED", "fake_file", "db_credentials_prod.conf"),
    ("HP_ADMIN_LOGIN", "fake_endpoint", "/admin/login decoy endpoint"),
    ("HP_SSH_2222", "fake_service", "Dummy SSH on port 2222"),
    ("HP_CLOUD_CONFIG", "fake_file", "/backup/cloud_config.json"),
]
# Decoy rule literals.
DECOY_SALARY_PATH = "salary_2024"
DECOY_SALARY_LOG = "salary_2024_Q3"
DECOY_DB_CRED = "db_credentials_prod"
DECOY_ADMIN_PATH = "/admin/login"
DECOY_ADMIN_EVENTS = ["HTTP_REQUEST", "WEB_ACCESS", "GET", "POST"]
DECOY_SSH_PORT = 2222
DECOY_SSH_PROTOCOLS = ["SSH", "TCP", "unknown"]
DECOY_CLOUD_PATH = "cloud_config"
DECOY_CLOUD_LOG = "cloud_config.json"

# Playbook states (service machine and response machine).
PLAYBOOK_STATES = ["ALERT_RECEIVED", "INITIAL_TRIAGE", "IP_BLOCKED", "ASN_BLOCKED",
                   "HOST_ISOLATED", "ESCALATED_TO_L2", "RESOLVED", "FAILED_DEFENCE"]
# Dashboard status labels per state (unknown states pass through unchanged).
STATE_LABELS = [
    ("ALERT_RECEIVED", "New"), ("TRIAGING", "Triaging"), ("INVESTIGATING", "Investigating"),
    ("ESCALATED", "Escalated"), ("CONTAINMENT", "Containment"), ("REMEDIATION", "Remediation"),
    ("RESOLVED", "Resolved"), ("FAILED_DEFENCE", "Failed Defence"),
]
# Dashboard step list, in order.
DISPLAY_STEPS = ["ALERT_RECEIVED", "TRIAGING", "INVESTIGATING", "ESCALATED",
                 "CONTAINMENT", "REMEDIATION", "RESOLVED"]
# Evidence tagging substrings of the dashboard.
EVIDENCE_THREAT_MARKERS = ["\U0001f6a8", "TI Match", "Malware", "CVE Match", "HONEYPOT"]
EVIDENCE_WARN_MARKERS = ["\u26a0", "WARN", "missing", "anomal", "lateral", "lateral spread", "East-west"]
# Gauge colour bands (score above the bound).
GAUGE_BANDS = [(80, "red"), (60, "orange"), (30, "yellow")]

# Built-in infrastructure topology: nodes (id, node_type, critical_asset).
TOPOLOGY_NODES = [
    ("INTERNET_GW", "INTERNET_GATEWAY", False), ("FIREWALL_1", "SERVER", False),
    ("WEB_SERVER", "SERVER", False), ("APP_SERVER", "SERVER", False),
    ("DB_PROD", "DATABASE", True), ("DOMAIN_CTRL", "DOMAIN_CONTROLLER", True),
    ("BACKUP_SERVER", "SERVER", False), ("SIEM_SERVER", "SERVER", False),
    ("JUMP_BOX", "SERVER", False), ("HONEYPOT_1", "HONEYPOT", False),
    ("HONEYPOT_2", "HONEYPOT", False), ("HR_SERVER", "SERVER", False),
    ("FINANCE_WS", "WORKSTATION", False), ("WS_1", "WORKSTATION", False),
    ("WS_2", "WORKSTATION", False), ("WS_3", "WORKSTATION", False),
    ("WS_4", "WORKSTATION", False), ("WS_5", "WORKSTATION", False),
]
# Built-in topology edges (src, dst, weight, protocol).
TOPOLOGY_EDGES = [
    ("INTERNET_GW", "FIREWALL_1", 4, "SSH"), ("INTERNET_GW", "HONEYPOT_1", 3, "RDP"),
    ("INTERNET_GW", "HONEYPOT_2", 4, "SSH"), ("FIREWALL_1", "WEB_SERVER", 3, "RDP"),
    ("WEB_SERVER", "APP_SERVER", 2, "SMB"), ("APP_SERVER", "DB_PROD", 1, "DB"),
    ("APP_SERVER", "DOMAIN_CTRL", 2, "SMB"), ("APP_SERVER", "BACKUP_SERVER", 2, "SMB"),
    ("DOMAIN_CTRL", "WS_1", 3, "RDP"), ("DOMAIN_CTRL", "WS_2", 3, "RDP"),
    ("DOMAIN_CTRL", "WS_3", 3, "RDP"), ("DOMAIN_CTRL", "WS_4", 3, "RDP"),
    ("DOMAIN_CTRL", "WS_5", 3, "RDP"), ("WS_1", "APP_SERVER", 2, "SMB"),
    ("WS_2", "APP_SERVER", 2, "SMB"), ("WS_3", "APP_SERVER", 2, "SMB"),
    ("WS_4", "APP_SERVER", 2, "SMB"), ("WS_5", "APP_SERVER", 2, "SMB"),
    ("JUMP_BOX", "DOMAIN_CTRL", 2, "SMB"), ("JUMP_BOX", "DB_PROD", 1, "DB"),
    ("SIEM_SERVER", "APP_SERVER", 4, "SSH"), ("DOMAIN_CTRL", "HR_SERVER", 3, "RDP"),
    ("DOMAIN_CTRL", "FINANCE_WS", 3, "RDP"),
]
# Node types the dashboard draws as critical.
DISPLAY_CRITICAL_TYPES = ["CRITICAL_ASSET", "DOMAIN_CONTROLLER", "DATABASE"]

# Classifier feature configuration per dataset tag: (numeric, categorical, target).
FEATURE_CONFIGS = {
    "beth": (["severity_raw"], ["event_type", "processName"], "label"),
    "unsw": (["dur", "sbytes", "dbytes", "sttl", "dttl", "sloss", "dloss", "sload", "dload",
              "spkts", "dpkts", "smeansz", "dmeansz", "ct_srv_src", "ct_state_ttl", "ct_dst_ltm",
              "ct_src_dport_ltm", "ct_dst_sport_ltm", "ct_dst_src_ltm"],
             ["proto", "service", "state"], "label"),
}
# Model selection bars on validation macro-F1.
MODEL_F1_BAR = 0.85
MODEL_F1_FALLBACK_BAR = 0.75
# Minority share under which oversampling is needed.
OVERSAMPLE_MIN_SHARE = 0.10

# ---------------------------------------------------------------------------


def event_probability(event_type: str) -> float | None:
    for p, events in EVENT_PROBABILITY_GROUPS:
        if event_type in events:
            return p
    return None


def dim_event(spark: SparkSession) -> DataFrame:
    rows = [(e, d, t, r, event_probability(e)) for e, d, t, r in EVENT_TYPES]
    return spark.createDataFrame(
        rows, "event_type string, description string, technique string, risk string, p_attack double")


def dim_port(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SERVICE_PORTS, "port int, service string")


def dim_severity(spark: SparkSession) -> DataFrame:
    rows = [(name, i, lo) for i, (name, lo) in enumerate(SEVERITY_TIERS)]
    return spark.createDataFrame(rows, "severity string, severity_ord int, lower_bound double")


def dim_decoys(spark: SparkSession) -> DataFrame:
    rows = [(a, t, d, i) for i, (a, t, d) in enumerate(DECOYS)]
    return spark.createDataFrame(rows, "asset_id string, asset_type string, description string, rule_ord int")


def topology_nodes(spark: SparkSession) -> DataFrame:
    rows = [(n, t, c, i) for i, (n, t, c) in enumerate(TOPOLOGY_NODES)]
    return spark.createDataFrame(rows, "id string, node_type string, critical_asset boolean, node_ord int")


def topology_edges(spark: SparkSession) -> DataFrame:
    rows = [(s, d, float(w), p) for s, d, w, p in TOPOLOGY_EDGES]
    return spark.createDataFrame(rows, "src string, dst string, weight double, protocol string")


def ti_feed(spark: SparkSession, bad_ips=None, bad_cves=None, bad_processes=None) -> dict[str, DataFrame]:
    """Threat-intel knowledge base as three dimension tables."""
    bad_ips = TI_BAD_IPS if bad_ips is None else bad_ips
    bad_cves = TI_BAD_CVES if bad_cves is None else bad_cves
    bad_processes = TI_BAD_PROCESSES if bad_processes is None else bad_processes
    return {
        "ti_cidr": spark.createDataFrame([(i, c) for i, c in enumerate(bad_ips)], "ord int, cidr string"),
        "ti_cve": spark.createDataFrame([(c,) for c in bad_cves], "cve string"),
        "ti_process": spark.createDataFrame([(p,) for p in bad_processes], "process string"),
    }


ALERT_SCHEMA = T.StructType([
    T.StructField("alert_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("dest_ip", T.StringType()),
    T.StructField("port", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("raw_log", T.StringType()),
    T.StructField("iocs", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    T.StructField("severity_raw", T.DoubleType()),
    T.StructField("label", T.IntegerType()),
])
