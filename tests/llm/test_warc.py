import base64
import hashlib
import random

from vigil.llm import warc as W

SCHEMA = "page_id long, url string, html string, digest string"


def test_loser_tree_merge():
    rng = random.Random(3)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randrange(50), i) for i in range(rng.randrange(0, 30))) for _ in range(k)]
        got = list(W.loser_tree_merge([iter(r) for r in runs]))
        assert [g[0] for g in got] == sorted(x[0] for r in runs for x in r)
        assert sorted(got) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert W.url_key("http://www.Example.com:80/A?b=1#f") == "com,example,www:80)/a?b=1"
    assert W.url_key("http://a.org") == "org,a)/"
    assert W.url_key(None) == W.url_key("") == ""
    assert W.url_key("http://[bad") == "http://[bad"


def expected(rows):
    last = {}
    for p, _, h, _ in rows:
        last[h or ""] = max(last.get(h or "", p), p, key=lambda x: (x is not None, x or 0))
    out = []
    for p, _, h, _ in rows:
        raw = (h or "").encode()
        again = p != last[h or ""]
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", last[h or ""] if again else None))
    return sorted(out, key=repr)


def test_round_trip_with_odd_payloads(spark, tmp_path):
    odd = "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n\r\n\r\nWARC/1.1\r\n"
    rows = [(i, f"http://h{i % 3}.org/p{i % 5}", f"payload {i % 7}" if i % 2 else f"{i}é\r\n\n", "x") for i in range(60)]
    rows += [(100, None, None, None), (101, "http://a.org/\r\nX: y%0A", odd, None), (102, "u", "", None), (102, "u", "", None),
             (103, "z", "long " * 200_000, None), (None, "n", "payload 3", None), (104, "http://a.org/", odd, None)]
    got = W.archived_captures(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path / "a")).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=repr) == expected(rows)
    assert sorted(str(r.url) for r in got) == sorted(str(r[1]) for r in rows)
    keys = [(r.url_key, r.capture_time) for r in got]
    assert keys == sorted(keys)


def test_several_files_and_empty_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "FILE_BYTES", 4096)
    rows = [(i, f"http://same.org/{i % 2}", f"page {i % 50} " * 40, "x") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    W.write_archive(df, str(tmp_path / "a"))
    index = W.read_archive(spark, str(tmp_path / "a"))
    assert index.select("file").distinct().count() > 5
    got = W.merged_index(index, 3).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=repr) == expected(rows)
    keys = [(r.url_key, r.capture_time, r.page_id) for r in got]
    assert keys == sorted(keys)
    assert W.archived_captures(spark, df.limit(0), str(tmp_path / "b")).count() == 0
