"""DuckDB SQL building blocks for the correctness oracle.

These strings re-state each operator independently in plain SQL (exploded
joins and list functions instead of the Spark expressions), so a match
between the two is a real cross-check.  DuckDB's RE2 has no look-behind, so
the port kind is never part of an oracle.
"""

from __future__ import annotations

from vigil.functions.ioc import KIND_PATTERNS
from vigil.functions.net import RFC1918_BLOCKS, VALID_IPV4_RE, WIDE_PRIVATE_BLOCKS, cidr_bounds
from vigil.sources import dims
from vigil.sources.testviews import ALERTS_V_SQL, AS_OF

RE2_KINDS = [k for k, _ in KIND_PATTERNS if k != "port"]
IOC_RE2 = "|".join(f"({p})" for k, p in KIND_PATTERNS if k != "port")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in values) + "]"


def ip2long(e: str) -> str:
    return (f"(CASE WHEN regexp_full_match(coalesce({e}, ''), {q(VALID_IPV4_RE)}) THEN "
            f"CAST(split_part({e}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({e}, '.', 2) AS BIGINT) * 65536 + "
            f"CAST(split_part({e}, '.', 3) AS BIGINT) * 256 + CAST(split_part({e}, '.', 4) AS BIGINT) END)")


def in_blocks(e: str, blocks) -> str:
    v = ip2long(e)
    return "(" + " OR ".join(f"{v} BETWEEN {lo} AND {hi}" for lo, hi in (cidr_bounds(b) for b in blocks)) + ")"


def rfc1918(e: str) -> str:
    return f"coalesce({in_blocks(e, RFC1918_BLOCKS)}, false)"


def wide_private(e: str) -> str:
    return in_blocks(e, WIDE_PRIVATE_BLOCKS)


def ordered_distinct(lst: str) -> str:
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


def kind_list(text: str, kind: str) -> str:
    g = RE2_KINDS.index(kind) + 1
    raw = f"list_filter(regexp_extract_all(coalesce({text}, ''), {q(IOC_RE2)}, {g}), lambda x: x IS NOT NULL AND x <> '')"
    return ordered_distinct(raw)


def ioc_cte(name: str, source: str, text: str, keep: str = "*", process: str | None = None) -> str:
    """CTE ``name`` with one list column per kind (ipv4 = external only)."""
    cols = ",\n    ".join(f"{kind_list(text, k)} AS k_{k}" for k in RE2_KINDS)
    proc = (f", CASE WHEN trim({process}) NOT IN ('', 'nan') THEN [trim({process})] ELSE []::VARCHAR[] END AS k_process"
            if process else ", []::VARCHAR[] AS k_process")
    return f"""{name}_raw AS (
  SELECT {keep},
    {cols}{proc}
  FROM {source}
),
{name} AS (
  SELECT * EXCLUDE (k_ipv4),
    list_filter(k_ipv4, lambda ip: NOT {rfc1918('ip')}) AS k_ipv4,
    list_filter(k_ipv4, lambda ip: {rfc1918('ip')}) AS k_lateral
  FROM {name}_raw
)"""


def _values(rows, cols) -> str:
    body = ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(cols)})"


def ranges_values(ranges) -> str:
    rows = []
    for i, (cidr, label) in enumerate(ranges):
        lo, hi = cidr_bounds(cidr)
        rows.append((i, cidr, label, lo, hi))
    return _values(rows, ["ord", "cidr", "label", "lo", "hi"])


EVENT_NAMES = [e for e, _, _, _ in dims.EVENT_TYPES]
PORT_NUMS = [p for p, _ in dims.SERVICE_PORTS]


def alerts_verified_ctes(as_of: str = AS_OF, boost: str = "0") -> str:
    """CTEs: alerts_v, ai (indicators), vv (verification scores per alert)."""
    blank = lambda c: f"({c} IS NULL OR {c} = '')"
    valid = lambda c: f"regexp_full_match(coalesce({c}, ''), {q(VALID_IPV4_RE)})"
    gaps = f"""list_filter([
      CASE WHEN {blank('source_ip')} THEN 'source_ip' END,
      CASE WHEN {blank('event_type')} THEN 'event_type' END,
      CASE WHEN {blank('raw_log')} THEN 'raw_log' END,
      CASE WHEN "timestamp" IS NULL THEN 'timestamp' END,
      CASE WHEN protocol IS NOT NULL AND lower(protocol) NOT IN ({', '.join(q(p) for p in dims.VALID_PROTOCOLS)}) THEN 'protocol=' || protocol END,
      CASE WHEN "timestamp" < TIMESTAMP '{as_of}' - INTERVAL 24 HOUR OR "timestamp" > TIMESTAMP '{as_of}' THEN 'timestamp_out_of_range' END
    ], lambda x: x IS NOT NULL)"""
    broken = f"((NOT {blank('source_ip')} AND NOT {valid('source_ip')}) OR (NOT {blank('dest_ip')} AND NOT {valid('dest_ip')}))"
    src_priv = f"(CASE WHEN {broken} OR {blank('source_ip')} THEN false ELSE coalesce({wide_private('source_ip')}, false) END)"
    dst_priv = f"(CASE WHEN {broken} OR {blank('dest_ip')} THEN false ELSE coalesce({wide_private('dest_ip')}, false) END)"
    service = f"(port IS NOT NULL AND port <> 0 AND port IN ({', '.join(str(p) for p in PORT_NUMS)}))"
    exempt = f"coalesce(event_type IN ({', '.join(q(e) for e in dims.DIRECTION_EXEMPT_EVENTS)}), false)"
    bad_cves = ", ".join(q(c.upper()) for c in dims.TI_BAD_CVES)
    bad_procs = ", ".join(q(p.lower()) for p in dims.TI_BAD_PROCESSES)
    return f"""WITH {ALERTS_V_SQL.strip()},
{ioc_cte('ai', 'alerts_v', 'raw_log', process='"processName"')},
p12 AS (
  SELECT *,
    {gaps} AS gaps,
    (CASE WHEN event_type IN ({', '.join(q(e) for e in EVENT_NAMES)}) THEN 10 ELSE 0 END)
    + (CASE WHEN {service} AND NOT {src_priv} AND {dst_priv} THEN 30 ELSE 0 END)
    + (CASE WHEN {service} AND {src_priv} AND {dst_priv} AND NOT {exempt} THEN 20 ELSE 0 END)
    + (CASE WHEN len(k_lateral) > 0 THEN 15 ELSE 0 END)
    + (CASE WHEN len(k_ipv4) > 0 THEN 10 ELSE 0 END)
    + (CASE WHEN len(k_domain) > 0 THEN 10 ELSE 0 END) AS c2_raw,
    list_concat(k_ipv4, CASE WHEN {blank('source_ip')} THEN []::VARCHAR[] ELSE [source_ip] END) AS all_ips,
    (CASE WHEN {service} AND NOT {src_priv} AND {dst_priv} THEN 1 ELSE 0 END) AS f_ingress,
    (CASE WHEN {service} AND {src_priv} AND {dst_priv} AND NOT {exempt} THEN 1 ELSE 0 END) AS f_eastwest
  FROM ai
),
ipx AS (
  SELECT alert_id, event_type, i AS pos, all_ips[i] AS ip, {ip2long('all_ips[i]')} AS ipl
  FROM (SELECT alert_id, event_type, all_ips, generate_subscripts(all_ips, 1) AS i FROM p12 WHERE len(all_ips) > 0)
),
tih AS (
  SELECT x.alert_id, x.pos, x.ip, x.event_type, arg_min(t.cidr, t.ord) AS cidr
  FROM ipx x JOIN {ranges_values([(c, '') for c in dims.TI_BAD_IPS])} ON x.ipl BETWEEN t.lo AND t.hi
  GROUP BY ALL
),
rkh AS (
  SELECT x.alert_id, x.pos, x.ip, x.event_type, arg_min(t.cidr, t.ord) AS cidr, arg_min(t.label, t.ord) AS label
  FROM ipx x JOIN {ranges_values(dims.RISK_RANGES)} ON x.ipl BETWEEN t.lo AND t.hi
  GROUP BY ALL
),
rk_counted AS (
  SELECT r.* FROM rkh r
  WHERE NOT EXISTS (SELECT 1 FROM tih t WHERE t.alert_id = r.alert_id
                    AND contains(t.ip || ' ' || t.cidr || ' ' || coalesce(t.event_type, 'None'), r.ip))
    AND NOT EXISTS (SELECT 1 FROM rkh e WHERE e.alert_id = r.alert_id AND e.pos < r.pos
                    AND contains(e.ip || ' ' || e.label || ' ' || e.cidr || ' ' || coalesce(e.event_type, 'None'), r.ip))
),
p3 AS (
  SELECT p.alert_id,
    len(list_filter(k_cve, lambda c: upper(c) IN ({bad_cves}))) AS n_cve_hits,
    len(list_filter(k_process, lambda x: lower(x) IN ({bad_procs}))) AS n_proc_hits,
    coalesce((SELECT count(*) FROM tih t WHERE t.alert_id = p.alert_id), 0) * 30
    + coalesce((SELECT count(*) FROM rk_counted r WHERE r.alert_id = p.alert_id), 0) * 20
    + len(list_filter(k_cve, lambda c: upper(c) IN ({bad_cves}))) * 30
    + len(list_filter(k_process, lambda x: lower(x) IN ({bad_procs}))) * 30
    + (CASE WHEN len(k_sha256) > 0 THEN 10 ELSE 0 END) AS c3_raw,
    (SELECT count(*) FROM tih t WHERE t.alert_id = p.alert_id) AS n_ti,
    (SELECT count(*) FROM rk_counted r WHERE r.alert_id = p.alert_id) AS n_risk
  FROM p12 p
),
vv AS (
  SELECT p.*, p3.n_cve_hits, p3.n_proc_hits,
    (CASE WHEN event_type IN ({', '.join(q(e) for e in EVENT_NAMES)}) THEN 1 ELSE 0 END)
    + (CASE WHEN {service} AND NOT {src_priv} AND {dst_priv} THEN 1 ELSE 0 END)
    + (CASE WHEN {service} AND {src_priv} AND {dst_priv} AND NOT {exempt} THEN 1 ELSE 0 END)
    + (CASE WHEN len(k_lateral) > 0 THEN 1 ELSE 0 END) + (CASE WHEN len(k_ipv4) > 0 THEN 1 ELSE 0 END)
    + (CASE WHEN len(k_domain) > 0 THEN 1 ELSE 0 END) AS n2_raw,
    p3.n_ti + p3.n_risk + p3.n_cve_hits + p3.n_proc_hits + (CASE WHEN len(k_sha256) > 0 THEN 1 ELSE 0 END) AS n3_raw,
    CASE WHEN len(p.gaps) = 0 THEN 20 ELSE 0 END AS c1,
    least(p.c2_raw, 50) AS c2, least(p3.c3_raw, 60) AS c3, p3.n_ti, p3.n_risk,
    CAST(least((CASE WHEN len(p.gaps) = 0 THEN 20 ELSE 0 END) + least(p.c2_raw, 50) + least(p3.c3_raw, 60) + {boost}, 100) AS INTEGER) AS confidence_score
  FROM p12 p JOIN p3 USING (alert_id)
),
vs AS (
  SELECT *, CASE WHEN confidence_score >= {dims.STATUS_VERIFIED_MIN} THEN 'VERIFIED'
                 WHEN confidence_score >= {dims.STATUS_UNVERIFIED_MIN} THEN 'UNVERIFIED'
                 ELSE 'FALSE_POSITIVE' END AS verification_status
  FROM vv
)"""


def p_attack_sql(ev: str = "event_type") -> str:
    parts = " ".join(f"WHEN {ev} IN ({', '.join(q(e) for e in events)}) THEN {p}"
                     for p, events in dims.EVENT_PROBABILITY_GROUPS)
    return f"(CASE {parts} ELSE {dims.DEFAULT_ATTACK_PROBABILITY} END)"


def tier_sql(p: str) -> str:
    t = dims.SEVERITY_TIERS
    parts = []
    for i, (name, lo) in enumerate(t):
        hi = t[i + 1][1] if i + 1 < len(t) else None
        parts.append(f"WHEN {p} >= {lo}" + (f" AND {p} < {hi}" if hi is not None else "") + f" THEN {q(name)}")
    return f"(CASE WHEN {p} < 0 OR {p} > 1 OR {p} IS NULL THEN NULL WHEN {p} = 1.0 THEN 'CRITICAL' {' '.join(parts)} END)"


def decoy_sql(raw: str = "raw_log", path: str = "accessed_path", ev: str = "event_type",
              proto: str = "protocol", port: str = "0") -> str:
    r, pa, pr = f"coalesce({raw}, '')", f"coalesce({path}, '')", f"coalesce({proto}, '')"
    return f"""(CASE WHEN contains({pa}, {q(dims.DECOY_SALARY_PATH)}) OR contains({r}, {q(dims.DECOY_SALARY_LOG)}) THEN 'HP_SALARY_FILE'
      WHEN contains({pa}, {q(dims.DECOY_DB_CRED)}) OR contains({r}, {q(dims.DECOY_DB_CRED)}) THEN 'HP_DB_CRED'
      WHEN contains({pa}, {q(dims.DECOY_ADMIN_PATH)}) AND coalesce({ev} IN ({', '.join(q(e) for e in dims.DECOY_ADMIN_EVENTS)}), false) THEN 'HP_ADMIN_LOGIN'
      WHEN {port} = {dims.DECOY_SSH_PORT} AND {pr} IN ({', '.join(q(e) for e in dims.DECOY_SSH_PROTOCOLS)}) THEN 'HP_SSH_2222'
      WHEN contains({pa}, {q(dims.DECOY_CLOUD_PATH)}) OR contains({r}, {q(dims.DECOY_CLOUD_LOG)}) THEN 'HP_CLOUD_CONFIG' END)"""


def scored_ctes(as_of: str = AS_OF) -> str:
    """Verification + tier + decoy override + service playbook (blast 0)."""
    return alerts_verified_ctes(as_of) + f""",
sc0 AS (
  SELECT *, {p_attack_sql()} AS p_attack, {decoy_sql()} AS decoy_asset_id FROM vs
),
sc AS (
  SELECT *, {tier_sql('p_attack')} AS base_severity,
    CASE WHEN decoy_asset_id IS NOT NULL THEN 'CRITICAL' ELSE {tier_sql('p_attack')} END AS severity,
    CASE WHEN decoy_asset_id IS NOT NULL THEN 1.0::DOUBLE ELSE round(p_attack, 4)::DOUBLE END AS confidence,
    0.0::DOUBLE AS blast_radius
  FROM sc0
),
scp AS (
  SELECT *,
    CASE WHEN severity IN ('HIGH', 'CRITICAL') THEN 'IP_BLOCKED' ELSE 'INITIAL_TRIAGE' END AS playbook_state,
    CASE WHEN severity IN ('HIGH', 'CRITICAL') THEN ['Alert Ingestion', 'Blocked IP ' || coalesce(source_ip, '0.0.0.0')]
         ELSE ['Alert Ingestion'] END AS svc_actions
  FROM sc
)"""


def _sealed_field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE CAST(length({value}) AS VARCHAR) || ':' || {value} END"


# The sealed payload of an alert (see ``scoring.SEAL_FIELDS``): text of each field.
_TEXT = ["alert_id", "CAST(epoch_us(\"timestamp\") AS VARCHAR)", "source_ip", "dest_ip", "CAST(port AS VARCHAR)", "protocol",
         "event_type", "accessed_path", "processName", "raw_log",
         *[f"array_to_string({k}, ',')" for k in ("k_sha256", "k_md5", "k_cve", "k_url", "k_ipv6", "k_domain", "k_process", "k_ipv4", "k_lateral", "gaps")],
         "CAST(c1 AS VARCHAR)", "CAST(c2 AS VARCHAR)", "CAST(c3 AS VARCHAR)", "CAST(confidence_score AS VARCHAR)",
         "verification_status", "severity", "CAST(confidence AS VARCHAR)", "decoy_asset_id", "CAST(blast_radius AS VARCHAR)",
         "playbook_state", "array_to_string(svc_actions, ',')"]
SEALED_PAYLOAD = "(" + " || ".join(_sealed_field(v) for v in _TEXT) + ")"


def sealed_payload(fields: list[str]) -> str:
    return "(" + " || ".join(_sealed_field(v) for v in fields) + ")"
