import math
from collections import Counter

from pyspark.sql import functions as F

from vigil.llm import url_filter as U
from vigil.llm.queries import URL_RULES


def naive(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = tail[:min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for action, rule in URL_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = action, rule
    return host, path, best


URLS = ["http://www.example.com/en/1", "https://Blog.EXAMPLE.com/en/2?x=1", "http://example.com/fr/3", "http://a.net/es/4", "http://net/fr/5",
        "http://xnet/es/1", "http://com", "http://com/", "http://a.com?p=/en/", "http://a.org/x://b.com/", "ftp://h#f/en/", "no scheme", "", None,
        "http://ÄB.com/é\n/x", "://", "http:///path"]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    df = df.withColumn("host", U.host_of(F.col("url"))).withColumn("path", U.path_of(F.col("url")))
    for r in df.withColumn("r", U.matching_rule(F.col("host"), F.col("path"), URL_RULES)).collect():
        host, path, best = naive(r.url)
        assert (r.host, r.path) == (host, path), r.url
        assert (r.r and (r.r.action, r.r.rule)) == best, r.url


def test_entropy(spark):
    for text in ("", "aaaa", "abab", "http://x.y/z?1"):
        n = Counter(text)
        want = -sum(c / len(text) * math.log2(c / len(text)) for c in n.values()) if text else 0.0
        got = spark.createDataFrame([(text,)], "url string").select(U.entropy(F.col("url")).alias("e")).first().e
        assert abs(got - want) < 1e-9


def pages_and_labels(spark, n=400):
    bad = lambda i: i % 3 == 0
    pages = [(i, f"http://h{i}.org/{'win-' * 6 if bad(i) else 'news'}/{i}", "x") for i in range(n)]
    labels = [(i, 0 if bad(i) else 1, 0) for i in range(n // 2)]
    return spark.createDataFrame(pages, "page_id long, url string, suffix string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_trees_learn_held_out_urls(spark):
    pages, labels = pages_and_labels(spark)
    got = U.judge(pages, U.fit(pages, labels, trees=5), []).collect()
    assert len(got) == 400
    assert sum((r.verdict == "block") == (r.page_id % 3 == 0) for r in got if r.page_id >= 200) >= 195


def test_labelled_rows_are_bounded(spark):
    pages, labels = pages_and_labels(spark)
    assert U.labelled_urls(pages, labels).count() == 200
    assert U.labelled_urls(pages, labels, 50).count() < 100


def test_no_labels_one_class_nulls_and_empty(spark):
    pages = spark.createDataFrame([(1, None), (None, "http://a.org/"), (2, "x" * 100_000), (2, "x" * 100_000)], "page_id long, url string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.verdict for r in U.judge(pages, U.fit(pages, none), URL_RULES).collect()] == ["allow"] * 4
    assert U.judge(pages.limit(0), U.fit(pages.limit(0), none), URL_RULES).count() == 0
    toxic = spark.createDataFrame([(7, 1, 1)], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, "http://a.org/7"), (2, "http://b.com/7")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in U.judge(some, U.fit(some, toxic), URL_RULES).collect()} == {1: "block", 2: "allow"}


def test_suffix_rates_cover_all_labelled_urls(spark):
    from vigil.llm import url_filter as filters
    pages = spark.createDataFrame([(i, f"https://h{i}.{'com' if i % 2 else 'net'}/{i}") for i in range(400)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 4 != 1), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    base = filters.labelled_urls(pages, labels, 40).selectExpr("avg(bad)").first()[0]
    got = sorted(r.suffix_bad_rate for r in filters.fit(pages, labels, trees=1, depth=1, limit=40).suffixes.collect())
    assert all(abs(x - y) < 1e-9 for x, y in zip(got, [10 * base / 210, (100 + 10 * base) / 210], strict=True))
