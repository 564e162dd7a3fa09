"""Three-pass alert verification as column expressions.

Each pass yields a score and a list of evidence entries
``struct<pass:int, rule:string, weight:int, subject:string, text:string>``.
Lookups against the event table, the service ports and the fixed address
ranges are literal maps / arrays inside the expression, so the whole operator
is one projection: no join, no shuffle, and it runs unchanged on a streaming
DataFrame.  Threat-intel feeds given as tables are joined by key instead
(:func:`with_feed_hits`) and their hits enter the same scores and evidence, so
a feed of any size is scored alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.ioc import ioc_kind
from vigil.functions.net import WIDE_PRIVATE_BLOCKS, cidr_bounds, ip_to_long, long_in_blocks
from vigil.operators.iprange import keyed_ranges
from vigil.sources import dims

EVIDENCE_TYPE = "struct<pass:int,rule:string,weight:int,subject:string,text:string>"


def empty_evidence() -> Column:
    return F.array().cast(f"array<{EVIDENCE_TYPE}>")



def _lit_map(pairs) -> Column:
    flat = []
    for k, v in pairs:
        flat += [F.lit(k), F.lit(v)]
    return F.create_map(*flat)


def range_array(ranges: list[tuple[str, str]]) -> Column:
    """Constant array<struct<ord,cidr,label,lo,hi>> for inline range probes."""
    items = []
    for i, (cidr, label) in enumerate(ranges):
        lo, hi = cidr_bounds(cidr)
        items.append(F.struct(F.lit(i).alias("ord"), F.lit(cidr).alias("cidr"), F.lit(label).alias("label"),
                              F.lit(lo).cast("bigint").alias("lo"), F.lit(hi).cast("bigint").alias("hi")))
    return F.array(*items)


def first_range(ipl: Column, ranges: Column) -> Column:
    """First range (in list order) containing the address value, else null."""
    return F.get(F.filter(ranges, lambda r: (ipl >= r["lo"]) & (ipl <= r["hi"])), 0)


def _ev(pass_no: int, rule: str, weight, subject: Column, text: Column) -> Column:
    w = weight if isinstance(weight, Column) else F.lit(weight)
    return F.struct(F.lit(pass_no).alias("pass"), F.lit(rule).alias("rule"), w.cast("int").alias("weight"),
                    subject.cast("string").alias("subject"), text.alias("text"))


def _blank(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


def _txt(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _show(c: Column) -> Column:
    """Python-like rendering of an optional value inside evidence text."""
    return F.coalesce(c.cast("string"), F.lit("None"))


# ---------------------------------------------------------------- pass 1
def structural_gaps(source_ip: Column, event_type: Column, raw_log: Column, ts: Column,
                    protocol: Column, as_of: Column, ts_is_string: bool = False) -> Column:
    """array<string> of missing / invalid field tags (empty when well formed)."""
    valid = [F.lit(p) for p in dims.VALID_PROTOCOLS]
    if ts_is_string:
        parsed = F.regexp_replace(ts, "Z$", "+00:00").try_cast("timestamp")
        ts_missing = _blank(ts)
        bad_parse = ts.isNotNull() & parsed.isNull()
        tcheck = parsed
    else:
        ts_missing = ts.isNull()
        bad_parse = F.lit(False)
        tcheck = ts
    out_of_range = tcheck.isNotNull() & ((tcheck < as_of - F.expr("INTERVAL 24 HOURS")) | (tcheck > as_of))
    tags = F.array(
        F.when(_blank(source_ip), F.lit("source_ip")),
        F.when(_blank(event_type), F.lit("event_type")),
        F.when(_blank(raw_log), F.lit("raw_log")),
        F.when(ts_missing, F.lit("timestamp")),
        F.when(protocol.isNotNull() & ~F.lower(protocol).isin(*valid), F.concat(F.lit("protocol="), protocol)),
        F.when(out_of_range, F.lit("timestamp_out_of_range")),
        F.when(bad_parse, F.lit("timestamp_parse_error")),
    )
    return F.filter(tags, lambda t: t.isNotNull())


def structural_pass(gaps: Column, source_ip: Column, dest_ip: Column, port: Column, event_type: Column):
    technique = F.try_element_at(_lit_map([(e, t) for e, _, t, _ in dims.EVENT_TYPES]), event_type)
    ok = F.size(gaps) == 0
    score = F.when(ok, F.lit(20)).otherwise(F.lit(0))
    ev = F.when(
        ok,
        _ev(1, "structure_ok", 20, event_type,
            _txt("PASS 1: ✓ Well-formed alert: ", _show(source_ip), " -> ", _show(dest_ip), ":",
                 F.coalesce(port.cast("string"), F.lit("N/A")), ", event ", _show(event_type), " (",
                 F.coalesce(technique, F.concat(F.lit("event_type="), _show(event_type))), ")."))
    ).otherwise(
        _ev(1, "structure_gap", 0, F.array_join(gaps, ", "),
            _txt("PASS 1: ⚠ Structural gap, missing/invalid fields: [", F.array_join(gaps, ", "),
                 "]. Alert ", F.coalesce(F.nullif(source_ip, F.lit("")), F.lit("unknown")), " -> ",
                 F.coalesce(F.nullif(dest_ip, F.lit("")), F.lit("unknown")), " typed ", _show(event_type),
                 " cannot be fully verified."))
    )
    return score, ev


# ---------------------------------------------------------------- pass 2
def direction_flags(source_ip: Column, dest_ip: Column, src_l: Column, dst_l: Column):
    """(src_private, dst_private) as the direction rule sees them: an empty
    address is not private; any non-empty unparsable address makes both false.
    ``src_l`` / ``dst_l`` are the parsed address values (null when invalid)."""
    broken = (~_blank(source_ip) & src_l.isNull()) | (~_blank(dest_ip) & dst_l.isNull())
    src_priv = F.when(broken | _blank(source_ip), False).otherwise(
        F.coalesce(long_in_blocks(src_l, WIDE_PRIVATE_BLOCKS), F.lit(False)))
    dst_priv = F.when(broken | _blank(dest_ip), False).otherwise(
        F.coalesce(long_in_blocks(dst_l, WIDE_PRIVATE_BLOCKS), F.lit(False)))
    return src_priv, dst_priv


def behaviour_entries(source_ip: Column, dest_ip: Column, port: Column, event_type: Column,
                      src_priv: Column, dst_priv: Column, lateral: Column, ext: Column, dom: Column) -> Column:
    """Pass-2 evidence entries (without the filler)."""
    known = event_type.isin(*[e for e, _, _, _ in dims.EVENT_TYPES])
    desc = F.try_element_at(_lit_map([(e, d) for e, d, _, _ in dims.EVENT_TYPES]), event_type)
    technique = F.try_element_at(_lit_map([(e, t) for e, _, t, _ in dims.EVENT_TYPES]), event_type)
    risk = F.try_element_at(_lit_map([(e, r) for e, _, _, r in dims.EVENT_TYPES]), event_type)
    service = F.try_element_at(_lit_map(dims.SERVICE_PORTS), port)
    has_service = port.isNotNull() & (port != 0) & service.isNotNull()
    exempt = F.coalesce(event_type.isin(*dims.DIRECTION_EXEMPT_EVENTS), F.lit(False))
    ingress = has_service & ~src_priv & dst_priv
    east_west = has_service & src_priv & dst_priv & ~exempt
    def listed(arr: Column, n: int) -> Column:
        more = F.when(F.size(arr) > n, F.concat(F.lit(" +"), (F.size(arr) - n).cast("string"), F.lit(" more")))
        return F.concat(F.array_join(F.slice(arr, 1, n), ", "), F.coalesce(more, F.lit("")))

    src_s, dst_s, evt_s = _show(source_ip), _show(dest_ip), _show(event_type)
    entries = F.array(
        F.when(known, _ev(2, "event_known", 10, event_type,
                          _txt("PASS 2: Event ", evt_s, " means \"", desc, "\", ATT&CK ", technique,
                               " (inherent risk ", risk, "); ", src_s, " -> ", dst_s, "."))),
        F.when(ingress, _ev(2, "ingress_service", 30, port,
                            _txt("PASS 2: ⚠ External source ", src_s, " reaches internal ", service,
                                 " (port ", port.cast("string"), ") on ", dst_s, ", an ingress attack shape."))),
        F.when(east_west, _ev(2, "east_west", 20, port,
                              _txt("PASS 2: ⚠ East-west traffic ", src_s, " -> ", dst_s, " on port ",
                                   port.cast("string"), " (", service, ") is unusual for ", evt_s,
                                   "; consistent with lateral movement."))),
        F.when(F.size(lateral) > 0, _ev(2, "lateral_ips", 15, F.array_join(lateral, ","),
                                        _txt("PASS 2: ⚠ Private addresses in the payload: [", listed(lateral, 4),
                                             "]; internal targets inside a ", evt_s, " log from ", src_s,
                                             " suggest lateral spread."))),
        F.when(F.size(ext) > 0, _ev(2, "external_ips", 10, F.array_join(ext, ","),
                                    _txt("PASS 2: External addresses in the payload: [", listed(ext, 3),
                                         "] in a ", evt_s, " log from ", src_s, "."))),
        F.when(F.size(dom) > 0, _ev(2, "domains", 10, F.array_join(dom, ","),
                                    _txt("PASS 2: Domains in the payload: [", listed(dom, 3), "] during ",
                                         evt_s, "."))),
    )
    return F.filter(entries, lambda e: e.isNotNull())


def behaviour_score(port: Column, event_type: Column, src_priv: Column, dst_priv: Column,
                    lateral: Column, ext: Column, dom: Column) -> Column:
    known = F.coalesce(event_type.isin(*[e for e, _, _, _ in dims.EVENT_TYPES]), F.lit(False))
    service = F.try_element_at(_lit_map(dims.SERVICE_PORTS), port)
    has_service = port.isNotNull() & (port != 0) & service.isNotNull()
    exempt = F.coalesce(event_type.isin(*dims.DIRECTION_EXEMPT_EVENTS), F.lit(False))
    pts = (F.when(known, 10).otherwise(0)
           + F.when(has_service & ~src_priv & dst_priv, 30).otherwise(0)
           + F.when(has_service & src_priv & dst_priv & ~exempt, 20).otherwise(0)
           + F.when(F.size(lateral) > 0, 15).otherwise(0)
           + F.when(F.size(ext) > 0, 10).otherwise(0)
           + F.when(F.size(dom) > 0, 10).otherwise(0))
    return F.least(pts, F.lit(50))


def behaviour_filler(source_ip: Column, dest_ip: Column, event_type: Column) -> Column:
    return _ev(2, "no_anomaly", 0, event_type,
               _txt("PASS 2: Behaviour check ", _show(source_ip), " -> ", _show(dest_ip), " on ",
                    _show(event_type), " found no anomalous indicator pattern."))


# ---------------------------------------------------------------- pass 3
def all_addresses(source_ip: Column, ext: Column) -> Column:
    """Indicator addresses, then the source."""
    return F.concat(ext, F.when(~_blank(source_ip), F.array(source_ip.cast("string")))
                    .otherwise(F.array().cast("array<string>")))


def feed_keys(feed: dict[str, DataFrame]) -> DataFrame:
    """The feed's tables as one: ``_key``, bounds ``_lo`` and ``_hi`` of address
    ranges, ``_ord`` (a range's place in the feed) and ``_hit``, the listed value.
    Of entries for the same range the first counts, so at most 33 hold one address."""
    ranges = (keyed_ranges(feed["ti_cidr"]).groupBy("level", "bkey", "lo", "hi")
              .agg(F.min("ord").alias("_ord"), F.min_by("cidr", "ord").alias("_hit")))

    def listed(table: DataFrame, value: str, fold) -> DataFrame:
        return (table.select(fold(value).alias("_hit")).distinct()
                .select(F.concat(F.lit(f"{value}:"), "_hit").alias("_key"), F.lit(None).cast("bigint").alias("_lo"),
                        F.lit(None).cast("bigint").alias("_hi"), F.lit(None).cast("int").alias("_ord"), "_hit"))

    return (ranges.select(F.concat_ws(":", "level", "bkey").alias("_key"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "_ord", "_hit")
            .unionByName(listed(feed["ti_cve"], "cve", F.upper)).unionByName(listed(feed["ti_process"], "process", F.lower)))


def with_feed_hits(df: DataFrame, feed: dict[str, DataFrame]) -> DataFrame:
    """Adds ``_ti`` (the feed ranges that hold an address occurrence, with its
    position), ``_bad_cves`` and ``_bad_procs`` (the alert's values that the feed lists).

    An alert becomes one row with its columns and one for each value to look up.
    These meet the feed by key in one join, and one grouping puts the hits to
    their alert: its columns are computed and moved once, and only the feed is
    ever small enough to broadcast."""
    c = F.col

    def entries(kind: str, values: Column, fold) -> Column:
        found = F.transform(values, lambda v, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), fold(v).alias("text")))
        return F.coalesce(found, F.array().cast("array<struct<kind:string,pos:int,text:string>>"))

    wanted = F.concat(F.array(F.struct(F.lit("alert").alias("kind"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("text"))),
                      entries("ip", all_addresses(c("source_ip"), c("_ext")), lambda v: v),
                      entries("cve", c("_cve"), F.upper), entries("process", c("_proc"), F.lower))
    kind, own = c("_e.kind"), c("_e.kind") == "alert"
    rows = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_e", F.explode_outer(wanted))
    rows = rows.select("_row", "_e", F.when(kind == "ip", ip_to_long(c("_e.text"))).alias("_ipl"),
                       *[F.when(own, c(f"`{x}`")).alias(x) for x in df.columns])
    keys = (F.when(kind == "ip", F.array(*[F.concat(F.lit(f"{n}:"), F.shiftright("_ipl", 32 - n) if n else F.when(c("_ipl").isNotNull(), 0)) for n in (16, 8, 0)]))
            .otherwise(F.array(F.concat(kind, F.lit(":"), F.when(own, c("_row").cast("string")).otherwise(c("_e.text"))))))
    rows = rows.withColumn("_key", F.explode_outer(keys)).where(c("_key").isNotNull())
    known = feed_keys(feed).withColumnRenamed("_key", "_feed_key")
    hits = rows.join(known, (c("_key") == c("_feed_key")) & (c("_lo").isNull() | c("_ipl").between(c("_lo"), c("_hi"))), "left")

    def hits_of(k: str, value: Column, out: str) -> Column:
        return F.collect_set(F.when(kind == k, value)).alias(out)

    return (hits.where(own | c("_hit").isNotNull()).groupBy("_row")
            .agg(*[F.first(f"`{x}`", ignorenulls=True).alias(x) for x in df.columns],
                 hits_of("ip", F.struct(c("_ord").alias("ord"), c("_hit").alias("cidr"), c("_e.pos").alias("pos")), "_ti"),
                 hits_of("cve", c("_hit"), "_bad_cves"), hits_of("process", c("_hit"), "_bad_procs")).drop("_row"))


def feed_probes(source_ip: Column, ext: Column, ti: Column, risk_ranges: list[tuple[str, str]] | None = None) -> Column:
    """As ``intel_probes``, the feed ranges coming from ``with_feed_hits``."""
    risk_arr = range_array(dims.RISK_RANGES if risk_ranges is None else risk_ranges)
    return F.transform(all_addresses(source_ip, ext), lambda ip, i: F.struct(
        ip.alias("ip"), F.array_min(F.filter(ti, lambda h: h["pos"] == i)).alias("ti"),
        first_range(ip_to_long(ip), risk_arr).alias("risk")))


def intel_probes(source_ip: Column, ext: Column, ti_ranges: list[str] | None = None,
                 risk_ranges: list[tuple[str, str]] | None = None) -> Column:
    """Every address occurrence (indicator addresses, then the source) with
    its first feed range and first high-risk range."""
    ti_ranges = dims.TI_BAD_IPS if ti_ranges is None else ti_ranges
    risk_ranges = dims.RISK_RANGES if risk_ranges is None else risk_ranges
    ti_arr = range_array([(c, "") for c in ti_ranges])
    risk_arr = range_array(risk_ranges)
    parsed = F.transform(all_addresses(source_ip, ext), lambda ip: F.struct(ip.alias("ip"), ip_to_long(ip).alias("ipl")))
    return F.transform(parsed, lambda p: F.struct(
        p["ip"].alias("ip"),
        first_range(p["ipl"], ti_arr).alias("ti"),
        first_range(p["ipl"], risk_arr).alias("risk")))


def intel_hits(event_type: Column, probes: Column, cves: Column, procs: Column,
               bad_cves: list[str] | Column | None = None, bad_processes: list[str] | Column | None = None) -> Column:
    """Pass-3 hits without any text: feed hits (one per address occurrence),
    counted risk-range hits, bad CVEs and bad processes.

    A risk-range hit is skipped when its address occurs in an earlier entry
    of the pass.  Entry texts hold only the address, range, label and event
    between fixed words without digits or dots, so the test runs on the key
    ``ip cidr [label] event`` instead of the rendered sentence."""
    def among(values, fixed: list[str], fold: str):
        if isinstance(values, Column):  # the alert's own listed values
            return lambda x: F.coalesce(F.array_contains(values, x), F.lit(False))
        return lambda x: x.isin(*[getattr(v, fold)() for v in (fixed if values is None else values)])

    is_bad_cve = among(bad_cves, dims.TI_BAD_CVES, "upper")
    is_bad_proc = among(bad_processes, dims.TI_BAD_PROCESSES, "lower")
    evt_s = _show(event_type)
    ti = F.filter(probes, lambda p: p["ti"].isNotNull())
    ti_keys = F.transform(ti, lambda p: F.concat_ws(" ", p["ip"], p["ti"]["cidr"], evt_s))
    risk_t = "struct<keys:array<string>,hits:array<struct<ip:string,cidr:string,label:string>>>"
    init = F.struct(ti_keys.alias("keys"),
                    F.array().cast("array<struct<ip:string,cidr:string,label:string>>").alias("hits")).cast(risk_t)

    def add_risk(acc, p):
        seen = F.exists(acc["keys"], lambda k: F.contains(k, p["ip"]))
        hit = F.struct(p["ip"].alias("ip"), p["risk"]["cidr"].alias("cidr"), p["risk"]["label"].alias("label"))
        grown = F.struct(F.concat(acc["keys"], F.array(F.concat_ws(" ", p["ip"], p["risk"]["label"], p["risk"]["cidr"], evt_s)))
                         .alias("keys"), F.concat(acc["hits"], F.array(hit)).alias("hits"))
        return F.when(seen, acc).otherwise(grown)

    risk = F.aggregate(F.filter(probes, lambda p: p["risk"].isNotNull()), init, add_risk)
    return F.struct(F.transform(ti, lambda p: F.struct(p["ip"].alias("ip"), p["ti"]["cidr"].alias("cidr"))).alias("ti"),
                    risk["hits"].alias("risk"),
                    F.filter(cves, lambda c: is_bad_cve(F.upper(c))).alias("cve"),
                    F.filter(procs, lambda x: is_bad_proc(F.lower(x))).alias("process"))


def intel_score(hits: Column, sha: Column) -> Column:
    raw = (F.size(hits["ti"]) * 30 + F.size(hits["risk"]) * 20 + F.size(hits["cve"]) * 30
           + F.size(hits["process"]) * 30 + F.when(F.size(sha) > 0, 10).otherwise(0))
    return F.least(raw, F.lit(60))


def intel_entries(source_ip: Column, event_type: Column, hits: Column, sha: Column) -> Column:
    """Pass-3 evidence entries (without the filler), from the hit lists."""
    evt_s = _show(event_type)
    ti_entries = F.transform(
        hits["ti"], lambda h: _ev(3, "ti_ip", 30, h["ip"],
                                  _txt("PASS 3: \U0001f6a8 TI Match: address ", h["ip"], " lies in feed range ",
                                       h["cidr"], "; ", evt_s, " traffic with it is high-confidence malicious.")))
    risk_entries = F.transform(
        hits["risk"], lambda h: _ev(3, "risk_range", 20, h["ip"],
                                    _txt("PASS 3: ⚠ Address ", h["ip"], " is in ", h["label"], " (",
                                         h["cidr"], "), often used for ", evt_s, " campaigns.")))
    cve_entries = F.transform(
        hits["cve"], lambda c: _ev(3, "ti_cve", 30, c,
                                   _txt("PASS 3: \U0001f6a8 CVE Match: ", c, " is a weaponised exploit in the feed, linked to ",
                                        evt_s, " chains.")))
    proc_entries = F.transform(
        hits["process"], lambda p: _ev(3, "ti_process", 30, p,
                                       _txt("PASS 3: \U0001f6a8 Malware tool match: process \"", p,
                                            "\" is a known offensive tool; run during ", evt_s, " on ",
                                            _show(source_ip), ".")))
    sha_entries = F.when(
        F.size(sha) > 0,
        F.array(_ev(3, "sha256", 10, F.array_join(F.slice(sha, 1, 2), ", "),
                    _txt("PASS 3: SHA-256 values in the payload [", F.array_join(F.slice(sha, 1, 2), ", "),
                         "...] call for sandbox detonation.")))
    ).otherwise(empty_evidence())
    return F.concat(ti_entries, risk_entries, cve_entries, proc_entries, sha_entries)


def intel_filler(event_type: Column) -> Column:
    return _ev(3, "no_intel", 0, event_type,
               _txt("PASS 3: Threat-intel lookup found no match for ", _show(event_type),
                    "; not corroborated by the feeds."))


def _sum_weights(entries: Column) -> Column:
    return F.aggregate(entries, F.lit(0), lambda a, e: a + e["weight"])


def status_of(score: Column) -> Column:
    return (F.when(score >= dims.STATUS_VERIFIED_MIN, F.lit("VERIFIED"))
            .when(score >= dims.STATUS_UNVERIFIED_MIN, F.lit("UNVERIFIED"))
            .otherwise(F.lit("FALSE_POSITIVE")))


def verify(df: DataFrame, as_of: str | Column, boost: Column | int = 0, ts_col: str = "timestamp",
           ts_is_string: bool = False, ti_ranges=None, risk_ranges=None, bad_cves=None,
           bad_processes=None, feed: dict[str, DataFrame] | None = None) -> DataFrame:
    """Add c1, c2, c3, confidence_score, verification_status, evidence and
    evidence_trail (rendered text) to an alert DataFrame with an ``iocs`` map.

    Built as a short chain of projections: every shared intermediate (parsed
    addresses, indicator lists, probes, entry lists) is its own column so it
    is evaluated once per row and the generated code stays small."""
    as_of_c = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    c = F.col
    # with a feed (tables ti_cidr, ti_cve, ti_process), its hits replace the listed values
    boost_c = boost if isinstance(boost, Column) else F.lit(boost)
    df = (df
          .withColumn("structural_gaps", structural_gaps(c("source_ip"), c("event_type"), c("raw_log"), c(ts_col),
                                                         c("protocol"), as_of_c, ts_is_string))
          .withColumn("_src_l", ip_to_long(c("source_ip")))
          .withColumn("_dst_l", ip_to_long(c("dest_ip")))
          .withColumn("_ext", ioc_kind(df, "ipv4"))
          .withColumn("_lat", ioc_kind(df, "lateral_movement"))
          .withColumn("_dom", ioc_kind(df, "domain"))
          .withColumn("_cve", ioc_kind(df, "cve"))
          .withColumn("_proc", ioc_kind(df, "process"))
          .withColumn("_sha", ioc_kind(df, "sha256")))
    src_priv, dst_priv = direction_flags(c("source_ip"), c("dest_ip"), c("_src_l"), c("_dst_l"))
    df = df.withColumn("_src_priv", src_priv).withColumn("_dst_priv", dst_priv)
    if feed is None:
        df = df.withColumn("_probes", intel_probes(c("source_ip"), c("_ext"), ti_ranges, risk_ranges))
    else:
        df = with_feed_hits(df, feed).withColumn("_probes", feed_probes(c("source_ip"), c("_ext"), c("_ti"), risk_ranges))
        bad_cves, bad_processes = c("_bad_cves"), c("_bad_procs")
    s1, e1 = structural_pass(c("structural_gaps"), c("source_ip"), c("dest_ip"), c("port"), c("event_type"))
    df = (df.withColumn("_hits3", intel_hits(c("event_type"), c("_probes"), c("_cve"), c("_proc"), bad_cves, bad_processes))
            .withColumn("c1", s1)
            .withColumn("c2", behaviour_score(c("port"), c("event_type"), c("_src_priv"), c("_dst_priv"),
                                              c("_lat"), c("_ext"), c("_dom")))
            .withColumn("c3", intel_score(c("_hits3"), c("_sha"))))
    # Evidence is built from the same flags and hit lists; when only scores
    # are selected the optimizer prunes all of it.
    e2 = behaviour_entries(c("source_ip"), c("dest_ip"), c("port"), c("event_type"),
                           c("_src_priv"), c("_dst_priv"), c("_lat"), c("_ext"), c("_dom"))
    e3 = intel_entries(c("source_ip"), c("event_type"), c("_hits3"), c("_sha"))
    df = (df.withColumn("e1", e1)
            # every rule weight is positive: a pass has entries exactly when it scores
            .withColumn("e2", F.when(c("c2") > 0, e2)
                        .otherwise(F.array(behaviour_filler(c("source_ip"), c("dest_ip"), c("event_type")))))
            .withColumn("e3", F.when(c("c3") > 0, e3).otherwise(F.array(intel_filler(c("event_type"))))))
    total = F.least(c("c1") + c("c2") + c("c3") + boost_c, F.lit(100))
    out = (df.withColumn("confidence_score", total.cast("int"))
             .withColumn("verification_status", status_of(c("confidence_score")))
             .withColumn("evidence", F.concat(F.array(c("e1")), c("e2"), c("e3")))
             .withColumn("evidence_trail", F.transform(c("evidence"), lambda e: e["text"]))
             .drop("e1", "e2", "e3", "_e2", "_e3", "_src_l", "_dst_l", "_ext", "_lat", "_dom", "_cve",
                   "_proc", "_sha", "_probes", "_src_priv", "_dst_priv", "_ti", "_bad_cves", "_bad_procs"))
    return out
