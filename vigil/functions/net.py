"""IPv4 column functions (all JVM-side expressions, no UDFs).

Addresses are strings in the data; for range tests they become ``bigint``
values.  A string is a valid address only in strict dotted-quad form
(octets 0-255 without leading zeros), which is what ``ipaddress`` accepts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
VALID_IPV4_RE = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
# Shape-only check of request validation (octets are not range checked).
IPV4_SHAPE_RE = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"

# FIXED VALUES: address blocks counted as private.
# Narrow RFC 1918 list used to split indicator addresses.
RFC1918_BLOCKS = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"]
# Wide list used for traffic direction (private in the sense of Python's ipaddress).
WIDE_PRIVATE_BLOCKS = ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16",
                       "172.16.0.0/12", "192.0.0.0/29", "192.0.0.8/32", "192.0.0.11/32",
                       "192.0.0.12/30", "192.0.0.16/28", "192.0.0.32/27", "192.0.0.64/26",
                       "192.0.0.128/25", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
                       "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
                       "255.255.255.255/32"]


def cidr_bounds(cidr: str) -> tuple[int, int]:
    """Integer bounds of a CIDR block, host bits ignored."""
    addr, _, bits = cidr.partition("/")
    a, b, c, d = (int(x) for x in addr.split("."))
    value = (a << 24) | (b << 16) | (c << 8) | d
    n = int(bits) if bits else 32
    mask = ((1 << 32) - 1) ^ ((1 << (32 - n)) - 1)
    lo = value & mask
    return lo, lo | ((1 << (32 - n)) - 1)


def is_valid_ipv4(c: Column) -> Column:
    return F.coalesce(c.rlike(VALID_IPV4_RE), F.lit(False))


def ipv4_shape_ok(c: Column) -> Column:
    return F.coalesce(c.rlike(IPV4_SHAPE_RE), F.lit(False))


def ip_to_long(c: Column) -> Column:
    """bigint value of a valid address, else null (one split, one regex test)."""
    value = F.aggregate(F.split(c, r"\."), F.lit(0).cast("bigint"),
                        lambda acc, x: acc * F.lit(256) + x.cast("bigint"))
    return F.when(is_valid_ipv4(c), value)


def blocks_array(blocks: list[str]) -> Column:
    """Constant array<struct<lo,hi>> of CIDR blocks."""
    return F.array(*[F.struct(F.lit(lo).cast("bigint").alias("lo"), F.lit(hi).cast("bigint").alias("hi"))
                     for lo, hi in (cidr_bounds(b) for b in blocks)])


def long_in_blocks(ipl: Column, blocks: list[str]) -> Column:
    """Null when ``ipl`` is null, else whether it lies in any block."""
    return F.when(ipl.isNotNull(),
                  F.exists(blocks_array(blocks), lambda r: (ipl >= r["lo"]) & (ipl <= r["hi"])))


def is_rfc1918(c: Column) -> Column:
    """True for valid addresses in 10/8, 172.16/12, 192.168/16; false otherwise."""
    return F.coalesce(long_in_blocks(ip_to_long(c), RFC1918_BLOCKS), F.lit(False))


def is_private_wide(c: Column) -> Column:
    """Direction-rule privacy; null when the string is not a valid address."""
    return long_in_blocks(ip_to_long(c), WIDE_PRIVATE_BLOCKS)


def slash16(c: Column) -> Column:
    """The /16 block 'a.b.0.0/16' of a dotted string, else '0.0.0.0/16'."""
    return F.aggregate(
        F.array(F.split(F.coalesce(c, F.lit("")), r"\.", -1)), F.lit("0.0.0.0/16"),
        lambda acc, parts: F.when(F.size(parts) == 4,
                                  F.concat(F.get(parts, 0), F.lit("."), F.get(parts, 1), F.lit(".0.0/16")))
        .otherwise(acc))
