from pyspark.sql import functions as F

from vigil.functions.ioc import with_iocs


def _iocs(spark, rows, process=False):
    schema = "id int, raw_log string" + (", processName string" if process else "")
    df = spark.createDataFrame(rows, schema)
    out = with_iocs(df, "raw_log", "processName" if process else None)
    return {r.id: dict(r.iocs) for r in out.select("id", "iocs").collect()}


def test_rfc1918_split(spark):
    got = _iocs(spark, [(1, "conn 192.168.1.50 10.0.0.1 185.220.101.1 8.8.8.8 d41d8cd98f00b204e9800998ecf8427e"),
                        (2, "a 192.168.1.50 b 185.220.101.1"),
                        (3, "only 185.220.101.1"),
                        (4, "only 10.1.2.3 and 172.16.0.9")])
    assert got[1]["ipv4"] == ["185.220.101.1", "8.8.8.8"]
    assert got[1]["lateral_movement"] == ["192.168.1.50", "10.0.0.1"]
    assert got[1]["md5"] == ["d41d8cd98f00b204e9800998ecf8427e"]
    assert got[2]["ipv4"] == ["185.220.101.1"] and got[2]["lateral_movement"] == ["192.168.1.50"]
    assert got[3] == {"ipv4": ["185.220.101.1"]}
    assert "ipv4" not in got[4] and got[4]["lateral_movement"] == ["10.1.2.3", "172.16.0.9"]


def test_ordered_alternation_and_ports(spark):
    text = "x http://evil.com/a 10.0.0.1:8080 to 8.8.8.8 bad.ru CVE-2021-44228 14:56:00Z port=22"
    got = _iocs(spark, [(1, text)])[1]
    assert got["url"] == ["http://evil.com/a"]
    assert got["lateral_movement"] == ["10.0.0.1"]
    assert got["ipv4"] == ["8.8.8.8"]
    assert got["domain"] == ["bad.ru"]          # the host inside the URL is not a domain hit
    assert got["cve"] == ["CVE-2021-44228"]
    assert got["port"] == ["8080", "56", "22"]


def test_distinct_first_seen_and_kinds(spark):
    sha = "a" * 64
    got = _iocs(spark, [(1, f"8.8.8.8 1.1.1.1 8.8.8.8 {sha} fe80:0:0:0:202:b3ff:fe1e:8329 999.1.1.1")])[1]
    assert got["ipv4"] == ["8.8.8.8", "1.1.1.1"]
    assert got["sha256"] == [sha]
    assert got["ipv6"] == ["fe80:0:0:0:202:b3ff:fe1e:8329"]


def test_process_column(spark):
    got = _iocs(spark, [(1, "x", " bash "), (2, "x", ""), (3, "x", "nan"), (4, "x", None)], process=True)
    assert got[1]["process"] == ["bash"]
    assert "process" not in got[2] and "process" not in got[3] and "process" not in got[4]


def test_unicode_word_boundary(spark):
    # a letter glued to the address is a word character: no match
    got = _iocs(spark, [(1, "é1.2.3.4 and 5.6.7.8")])[1]
    assert got["ipv4"] == ["5.6.7.8"]


def test_matches_python_group_semantics(spark):
    """Random token mixes: per-kind lists equal Python's group-by-alternative
    extraction with the same pattern (first-seen order, distinct)."""
    import random
    import re

    from vigil.functions.ioc import KIND_PATTERNS, KINDS

    pat = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KIND_PATTERNS))
    tokens = ["10.0.0.1", "8.8.8.8", "999.1.1.1", "1.2.3.4:8080", "evil.com", "a-b.evil.ru", "CVE-2021-44228",
              "CVE-x.com", "httpbin.org", "http://x.io/p?q=1", "https://a.b.cn/", "port=443", "x:22", "ab:cd",
              "d41d8cd98f00b204e9800998ecf8427e", "a" * 64, "fe80:0:0:0:202:b3ff:fe1e:8329", "1.2.3", "x.co",
              "0.0.0.0", "255.255.255.255", "12:34:56", "-bad-.com", "mail.example.de,", "(10.1.1.1)", "'q.uk'"]
    random.seed(7)
    texts = [(i, " ".join(random.choice(tokens) for _ in range(random.randint(1, 12)))) for i in range(300)]
    df = spark.createDataFrame(texts, "id int, raw_log string")
    from vigil.functions.ioc import with_ioc_struct
    got = {r.id: r.ioc for r in with_ioc_struct(df, "raw_log", out="ioc").select("id", "ioc").collect()}
    for i, t in texts:
        exp = {k: [] for k in KINDS}
        for m in pat.finditer(t):
            k = m.lastgroup
            if m.group(k) not in exp[k]:
                exp[k].append(m.group(k))
        g = got[i]
        for k in KINDS:
            have = list(g[k]) if k != "ipv4" else list(g["ipv4"]) + list(g["lateral_movement"])
            want = exp[k]
            if k == "ipv4":
                assert sorted(have) == sorted(want), (t, k)
            else:
                assert have == want, (t, k, have, want)
