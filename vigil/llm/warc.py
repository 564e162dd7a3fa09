"""WARC archives and globally ordered capture histories.

``write_archive`` turns pages into WARC/1.1 records and stores them through
Spark's text writer: a record's text is one value and the blank lines that end
a record are the line separator, so the files are plain (gzipped) WARC and any
file system Spark can write to will do.  Records whose payload occurs again
under a larger page id become ``revisit`` records.

``read_archive`` parses the files by ``Content-Length``, and lists each file's
captures sorted by (URL key, time): one locally sorted run per file.
``merged_index`` range-partitions the runs by key and time and merges the runs
of a range with a loser tree, which gives globally ordered capture histories.
A frequently captured URL is split between ranges, for time and page id are
part of the range key.

Defined results: a null html is an empty payload; a null URL has no target
header and sorts first under the empty key; control characters in a URL are
percent-encoded; of rows that tie for the largest page id with one payload,
each is a response; a null page id counts as smaller than any other; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import blocks_for, shuffle_partitions

RECORD_END = "\r\n\r\n"
FILE_BYTES = 8 << 20          # aimed-at bytes of a file before compression
CAPTURE_START = 1_704_067_200  # time of page 0; pages carry no capture time, so page n follows n seconds later
INDEX_SCHEMA = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, "
                "url_key string, capture_time string, file string, record_offset long, record_length long, run string, run_pos long")


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then path and query, lower case."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = (parts.netloc or "").rsplit("@", 1)[-1].lower()
        tail = parts.path + (f"?{parts.query}" if parts.query else "")
    except ValueError:
        return url.lower()
    name, _, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + (f":{port}" if port else "") + ")" + (tail or "/").lower()


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def records(pages: DataFrame) -> DataFrame:
    """``record`` texts, one per page.

    Payload equality is decided on (page id, digest) pairs alone: the largest id
    of each digest comes from a pre-aggregated count, and only those light rows
    meet by digest.  The payloads move once, by page id, which no group skews."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    ids = rows.select(F.coalesce("page_id", F.lit(-(1 << 62))).alias("id"), "digest")
    largest = ids.groupBy("digest").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisits = ids.join(largest, "digest").where("id < last").groupBy("id", "digest").agg(F.max("last").alias("last"))
    rows = (rows.withColumn("id", F.coalesce("page_id", F.lit(-(1 << 62))))
            .join(revisits, ["id", "digest"], "left"))
    n_bytes = F.octet_length("payload")
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "%", "%25"), "\r", "%0D"), "\n", "%0A")
    is_revisit = F.col("last").isNotNull()
    when = F.date_format(F.timestamp_seconds(F.lit(CAPTURE_START) + F.coalesce("page_id", F.lit(0)) % (1 << 32)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), n_bytes.cast("string"), F.lit("\r\n\r\n"))
    block = F.when(is_revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(is_revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")), F.lit("\r\nWARC-Date: "), when,
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), uri), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(is_revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
                                    name(F.when(F.col("last") > -(1 << 62), F.col("last"))))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    return rows.select(F.concat(head, block).alias("record"))


def write_archive(pages: DataFrame, path: str) -> None:
    """Records of all pages as gzipped WARC files under ``path``.  A file ends
    after so many records that it holds about ``FILE_BYTES`` on average."""
    n, size = pages.agg(F.count(F.lit(1)), F.sum(F.octet_length("html"))).first()
    per_file = max(1, n // blocks_for((size or 0) + 600 * n, FILE_BYTES)) if n else 1
    (records(pages).write.option("lineSep", RECORD_END).option("compression", "gzip")
     .option("maxRecordsPerFile", per_file).text(path))


_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def parse_file(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """``offset, length, headers, block`` of each record of an unpacked WARC file."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at) + 4
        first = content.index(b"\r\n", at) + 2
        if not content.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.decode().lower(): v.decode("utf-8", "replace") for k, v in _HEADER.findall(content, first, end - 2)}
        stop = end + int(headers["content-length"])
        yield at, stop + 4 - at, headers, content[end:stop]
        at = stop + 4


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def _decoded(uri: str | None) -> str | None:
    return None if uri is None else uri.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _captures(path: str, content: bytes) -> list[tuple]:
    out = []
    raw = gzip.decompress(content) if path.endswith(".gz") else content
    for at, length, h, block in parse_file(raw):
        http_end = block.index(b"\r\n\r\n") + 4
        payload = block[http_end:]
        if h["warc-type"] == "response":
            n, digest = len(payload), base32_sha1(payload)
            if bytes.fromhex(h["warc-payload-digest"].split(":")[1]) != base64.b32decode(digest):
                raise ValueError(f"{path} at byte {at}: the payload does not match its digest")
        else:  # a revisit keeps the response's HTTP header, with the full payload's length
            n = int(re.search(rb"Content-Length: (\d+)", block)[1])
            digest = base64.b32encode(bytes.fromhex(h["warc-payload-digest"].split(":")[1])).decode("ascii")
        url = _decoded(h.get("warc-target-uri"))
        out.append((_page(h["warc-record-id"]), n, digest, h["warc-type"], _page(h.get("warc-refers-to")), url, url_key(url),
                    re.sub(r"\D", "", h["warc-date"]), path, at, length))
    out.sort(key=lambda r: (r[6], r[7], -1 if r[0] is None else r[0]))
    return [(*r, path, i) for i, r in enumerate(out)]


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The captures of every file, each file a run sorted by (URL key, time)."""
    names = [f.split()[0] for f in INDEX_SCHEMA.split(", ")]

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                got = pd.DataFrame(_captures(name, content), columns=names)
                for c in ("page_id", "refers_to"):
                    got[c] = got[c].astype("Int64")
                yield got

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(runs, INDEX_SCHEMA)


def loser_tree_merge(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Merge sorted runs of ``(key, value)``: inner nodes keep the losers of
    their last match, so one path of comparisons replaces each winner."""
    k = len(runs)
    if not k:
        return
    heads = [next(r, None) for r in runs]
    loser = [-1] * k  # loser[0]: the overall winner

    def beats(a: int, b: int) -> bool:
        if heads[a] is None or heads[b] is None:
            return heads[a] is not None
        return (heads[a][0], a) < (heads[b][0], b)

    def replay(run: int) -> None:
        node, winner = (run + k) // 2, run
        while node > 0:
            if loser[node] == -1:  # first match at this node: wait for the other side
                loser[node] = winner
                return
            if beats(loser[node], winner):
                winner, loser[node] = loser[node], winner
            node //= 2
        loser[0] = winner

    for i in range(k):
        replay(i)
    while heads[loser[0]] is not None:
        run = loser[0]
        yield heads[run]
        heads[run] = next(runs[run], None)
        replay(run)


def merged_index(index: DataFrame, ranges: int | None = None) -> DataFrame:
    """The runs merged into one order by (URL key, time, page id): partition i
    holds the i-th range, sorted."""
    columns = index.columns

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True).sort_values(["run", "run_pos"], kind="stable", ignore_index=True)
        keys = list(zip(rows["url_key"], rows["capture_time"], rows["page_id"].fillna(-1), strict=True))
        starts = rows.groupby("run", sort=False).indices.values()
        runs = [iter([(keys[i], i) for i in sorted(at)]) for at in starts]
        yield rows.iloc[[i for _, i in loser_tree_merge(runs)]]

    n = ranges or shuffle_partitions(index.sparkSession)
    return (index.repartitionByRange(n, "url_key", "capture_time", "page_id")
            .mapInPandas(merge, index.schema).select(*columns))


def archived_captures(spark: SparkSession, pages: DataFrame, path: str) -> DataFrame:
    """Write the pages as an archive under ``path``, read it back, merge its runs."""
    write_archive(pages, path)
    return merged_index(read_archive(spark, path))
