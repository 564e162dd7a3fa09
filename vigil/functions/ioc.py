"""Indicator-of-compromise extraction as column expressions.

One ``regexp_extract_all`` scans each text once with the ordered alternation
(so the host inside a URL is not reported again as a domain).  Each match is
then assigned to its kind with anchored per-kind patterns: the kinds are
textually disjoint, so the first anchored pattern a match satisfies is the
alternative that produced it.  No shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.functions.net import is_rfc1918
from vigil.functions.text import strip

# ---------------------------------------------------------------------------
# FIXED VALUES — indicator pattern, alternatives in match priority order.
# ---------------------------------------------------------------------------
TLDS = "com|net|org|ru|io|xyz|info|biz|top|cc|tk|cn|de|uk|co"
KIND_PATTERNS = [
    ("sha256", r"\b[a-fA-F0-9]{64}\b"),
    ("md5", r"\b[a-fA-F0-9]{32}\b"),
    ("cve", r"CVE-\d{4}-\d{4,7}"),
    ("url", r"https?://[^\s\"'>,)]{4,100}"),
    ("ipv6", r"(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}"),
    ("ipv4", r"\b(?:(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)\b"),
    ("domain", r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+(?:" + TLDS + r")\b"),
    ("port", r"(?<=:)\d{2,5}\b|(?<=port=)\d{2,5}\b"),
]
# Anchored forms used to classify a match (word boundaries and look-behinds
# are properties of the context, which the scan already checked).
KIND_ANCHORED = {
    "sha256": r"^[a-fA-F0-9]{64}$",
    "md5": r"^[a-fA-F0-9]{32}$",
    "cve": r"^CVE-\d{4}-\d{4,7}$",
    "url": r"^https?://",
    "ipv6": r"^(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$",
    "ipv4": r"^\d+\.\d+\.\d+\.\d+$",
    "domain": r"^[a-zA-Z0-9.\-]*\.[a-zA-Z]+$",
    "port": r"^\d{2,5}$",
}
# Kinds in output order; ``lateral_movement`` and ``process`` are derived.
KINDS = ["sha256", "md5", "cve", "url", "ipv6", "ipv4", "domain", "port"]
OUTPUT_KINDS = ["sha256", "md5", "cve", "url", "ipv6", "ipv4", "lateral_movement", "domain", "port", "process"]

# Every alternative starts at an ASCII letter or digit, so a one-character
# look-ahead lets the scan skip all other positions cheaply (same matches).
IOC_PATTERN = "(?=[0-9A-Za-z])(?:" + "|".join(f"({p})" for _, p in KIND_PATTERNS) + ")"


def ioc_matches(text: Column) -> Column:
    """All indicator matches of a text, in text order (one regex scan)."""
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(IOC_PATTERN), 0)


def kind_code(m: Column) -> Column:
    """Index into KINDS of the alternative that produced a match.

    Matches of different kinds are textually disjoint, so cheap string tests
    suffice: only URLs start with a scheme, only IPv6 matches contain ':',
    dotted matches are IPv4 when all digits (else domains), and the remaining
    dot-free matches differ by length (64 / 32 hex, 2-5 digit ports).  A
    domain may begin with 'CVE-', so that prefix is confirmed by the pattern."""
    k = {name: F.lit(i) for i, name in enumerate(KINDS)}
    return (F.when(m.startswith("http://") | m.startswith("https://"), k["url"])
            .when(m.startswith("CVE-") & m.rlike(KIND_ANCHORED["cve"]), k["cve"])
            .when(F.contains(m, F.lit(":")), k["ipv6"])
            .when(F.contains(m, F.lit(".")), F.when(m.rlike(KIND_ANCHORED["ipv4"]), k["ipv4"]).otherwise(k["domain"]))
            .when(F.length(m) == 64, k["sha256"])
            .when(F.length(m) == 32, k["md5"])
            .otherwise(k["port"]))


def process_values(process: Column) -> Column:
    """Structured process name as a one-element list ('' / 'nan' / null → empty)."""
    p = strip(process)
    return F.when(p.isNotNull() & ~p.isin("", "nan"), F.array(p)).otherwise(F.array().cast("array<string>"))


def _values_of(tagged: Column, code: int) -> Column:
    return F.array_distinct(F.transform(F.filter(tagged, lambda t: t["k"] == code), lambda t: t["v"]))


def ioc_struct_from_matches(m: Column, process: Column | None = None) -> Column:
    """Struct of indicator lists; ipv4 holds external addresses only and the
    RFC 1918 ones move to ``lateral_movement``.  Each match is classified once
    and each address is range-tested once."""
    tagged = F.transform(m, lambda x: F.struct(x.alias("v"), kind_code(x).alias("k")))
    return _ioc_struct_from_tagged(tagged, process)


def _ioc_struct_from_tagged(tagged: Column, process: Column | None) -> Column:
    fields = {k: _values_of(tagged, i) for i, k in enumerate(KINDS) if k != "ipv4"}
    v4 = F.transform(_values_of(tagged, KINDS.index("ipv4")),
                     lambda ip: F.struct(ip.alias("ip"), is_rfc1918(ip).alias("priv")))
    fields["ipv4"] = F.transform(F.filter(v4, lambda x: ~x["priv"]), lambda x: x["ip"])
    fields["lateral_movement"] = F.transform(F.filter(v4, lambda x: x["priv"]), lambda x: x["ip"])
    fields["process"] = process_values(process) if process is not None else F.array().cast("array<string>")
    return F.struct(*[fields[k].alias(k) for k in OUTPUT_KINDS])


def ioc_map(ioc: Column) -> Column:
    """The reference data model: kind → values, kinds without values absent."""
    entries = F.map_from_arrays(F.array(*[F.lit(k) for k in OUTPUT_KINDS]),
                                F.array(*[ioc[k] for k in OUTPUT_KINDS]))
    return F.map_filter(entries, lambda k, v: F.size(v) > 0)


def ioc_get(iocs: Column, kind: str) -> Column:
    """Values of a kind from an indicator map, empty when the kind is absent."""
    return F.coalesce(F.try_element_at(iocs, F.lit(kind)), F.array().cast("array<string>"))


def ioc_struct(text: Column, process: Column | None = None) -> Column:
    return ioc_struct_from_matches(ioc_matches(text), process)


def with_ioc_struct(df, text_col: str = "raw_log", process_col: str | None = None, out: str = "ioc",
                    fenced: bool = False):
    """Add a struct column of indicator lists.  The classified match list is
    its own projection, so the regex scan and the classification run once per
    row (the optimizer does not inline an expensive expression referenced
    several times)."""
    proc = F.col(process_col) if process_col and process_col in df.columns else None
    tagged = F.transform(ioc_matches(F.col(text_col)), lambda x: F.struct(x.alias("v"), kind_code(x).alias("k")))
    x = (df.withColumn("_ioc_tagged", tagged)
           .withColumn(out, _ioc_struct_from_tagged(F.col("_ioc_tagged"), proc))
           .drop("_ioc_tagged"))
    if not fenced:
        # unfenced, the whole extraction is pruned when nothing reads it
        return x
    # fenced: a later filter on the indicators cannot be pushed below (and so
    # duplicate) the scan; the fence itself is never pruned
    from vigil.functions.fence import fence
    return fence(x, [out])


def with_iocs(df, text_col: str = "raw_log", process_col: str | None = None, out: str = "iocs"):
    """Add the indicator map ``out`` (kinds without values absent) and the
    struct ``ioc`` it is built from; consumers read the struct, and the map
    is pruned by the optimizer when nothing selects it."""
    return with_ioc_struct(df, text_col, process_col, out="ioc").withColumn(out, ioc_map(F.col("ioc")))


def ioc_kind(df, kind: str):
    """Values of one kind from the struct when present, else from the map."""
    if "ioc" in df.columns:
        return F.col("ioc")[kind]
    return ioc_get(F.col("iocs"), kind)
