"""Raw log and feed sources: CSV logs, threat-intel JSON, request JSON.

CSV files are read with Spark's splittable reader (no chunking needed);
header names are trimmed; the encoding can be chosen per read.  Normalisers
turn host-log rows and network-flow rows into the alert schema with
null-safe ``try_cast`` rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.net import ipv4_shape_ok
from vigil.functions.text import strip
from vigil.sources.dims import ALERT_SCHEMA


ENCODINGS = ["UTF-8", "ISO-8859-1", "windows-1252"]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether any file matches ``path``, on whatever file system it names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def detect_encoding(spark: SparkSession, path: str) -> str:
    """First encoding in ``ENCODINGS`` that decodes every line of the input
    without replacement characters: one distributed pass over all lines."""
    for enc in ENCODINGS[:-1]:
        lines = spark.read.option("encoding", enc).option("lineSep", "\n").csv(path)
        text = F.concat_ws("\u0001", *[F.coalesce(F.col(c), F.lit("")) for c in lines.columns])
        if lines.where(F.instr(text, "\ufffd") > 0).isEmpty():
            return enc
    return ENCODINGS[-1]


def derive_label(df: DataFrame) -> DataFrame:
    """Training label by column presence: ``label`` if present, else ``evil``,
    else ``sus``."""
    for c in ("label", "evil", "sus"):
        if c in df.columns:
            return df.withColumn("label", F.col(c).try_cast("double").cast("int"))
    return df.withColumn("label", F.lit(None).cast("int"))


def file_report(df: DataFrame) -> DataFrame:
    """Per input file: rows and size in bytes (from the ``_metadata`` column)."""
    return (df.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_size"))
              .groupBy("file_path").agg(F.count(F.lit(1)).alias("n_rows"), F.max("file_size").alias("file_size")))


def read_csv_logs(spark: SparkSession, paths: list[str], encoding: str | None = None,
                  skipped: list[str] | None = None) -> DataFrame:
    """Read CSV files (header, all columns as strings), trim header names and
    keep the source file.  The encoding of each path is detected from all its
    lines unless one is given.  Paths that do not exist are skipped (and added
    to ``skipped``); any other read error is raised.  Files are unioned by name,
    columns missing in some files become null."""
    frames = []
    for p in paths:
        if not path_exists(spark, p):
            if skipped is not None:
                skipped.append(p)
            continue
        enc = encoding or detect_encoding(spark, p)
        df = spark.read.option("header", True).option("encoding", enc).csv(p)
        df = df.toDF(*[c.strip() for c in df.columns]).withColumn("source_file", F.input_file_name())
        frames.append(df)
    if not frames:
        raise FileNotFoundError("no readable input files")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def row_text(df: DataFrame) -> Column:
    """The whole row as text, every column in order: ``{'name': value, ...}``,
    numbers bare, other values quoted, ``nan`` for null."""
    def item(c: str) -> Column:
        v = F.col(f"`{c}`").cast("string")
        shown = F.when(v.isNull(), F.lit("nan")).when(v.rlike(NUMBER), v).otherwise(F.concat(F.lit("'"), v, F.lit("'")))
        return F.concat(F.lit(f"'{c}': "), shown)
    return F.concat(F.lit("{"), F.concat_ws(", ", *[item(c) for c in df.columns if c != "source_file"]), F.lit("}"))


def normalise_host_log(df: DataFrame, now: Column) -> DataFrame:
    """Host-log rows → alert columns (event id as text, user as source,
    suspicious score as severity, evil flag as label, epoch seconds as time)."""
    ts_s = F.col("timestamp").try_cast("double")
    sus = F.col("sus").try_cast("double")
    evil = F.col("evil").try_cast("double")
    return df.select(
        F.coalesce(F.col("eventId").cast("string"), F.lit("None")).alias("event_type"),
        F.col("userId").cast("string").alias("source_ip"),
        F.coalesce(sus, F.lit(0.0)).alias("severity_raw"),
        evil.cast("int").alias("label"),
        F.coalesce(F.timestamp_micros((ts_s * 1000000).cast("bigint")), now).alias("timestamp"),
        F.when(F.col("processName").isNotNull(), F.col("processName")).alias("processName"),
        row_text(df).alias("raw_log"))


def normalise_flow_log(df: DataFrame, now: Column) -> DataFrame:
    """Network-flow rows → alert columns ('-' or non-numeric port → null,
    blank attack category → 'normal', processing time as timestamp)."""
    port_txt = strip(F.col("dsport"))
    port = F.when(port_txt == "-", F.lit(None)).otherwise(port_txt.try_cast("int"))
    cat = F.col("attack_cat")
    return df.select(
        F.col("srcip").alias("source_ip"), F.col("dstip").alias("dest_ip"), port.alias("port"),
        F.col("proto").alias("protocol"),
        F.when(cat.isNull() | (strip(cat) == ""), F.lit("normal")).otherwise(cat).alias("event_type"),
        F.col("Label").try_cast("int").alias("label"), now.alias("timestamp"), row_text(df).alias("raw_log"))


def read_ti_feed(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Threat-intel JSON (bad_ips, bad_cves, bad_processes) → three tables."""
    kb = spark.read.option("multiLine", True).json(path)
    return {
        "ti_cidr": kb.select(F.posexplode_outer("bad_ips").alias("ord", "cidr")).where(F.col("cidr").isNotNull()),
        "ti_cve": kb.select(F.explode_outer("bad_cves").alias("cve")).where(F.col("cve").isNotNull()),
        "ti_process": kb.select(F.explode_outer("bad_processes").alias("process")).where(F.col("process").isNotNull()),
    }


REQUEST_SCHEMA = ("raw_log string, source_ip string, dest_ip string, port int, timestamp string, "
                  "event_type string, accessed_path string, protocol string, _corrupt_record string")


def read_requests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Alert requests (JSON lines) → (valid, rejected with reason)."""
    df = (spark.read.schema(REQUEST_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    reason = (F.when(F.col("_corrupt_record").isNotNull(), F.lit("unparsable"))
              .when(F.col("raw_log").isNull() | F.col("source_ip").isNull() | F.col("dest_ip").isNull()
                    | F.col("port").isNull(), F.lit("missing required field"))
              .when(~ipv4_shape_ok(F.col("source_ip")) | ~ipv4_shape_ok(F.col("dest_ip")), F.lit("invalid IPv4 address"))
              .when(~F.col("port").between(0, 65535), F.lit("port out of range")))
    tagged = df.withColumn("reject_reason", reason)
    return (tagged.where(F.col("reject_reason").isNull()).drop("reject_reason", "_corrupt_record"),
            tagged.where(F.col("reject_reason").isNotNull()))


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: type, non-null count and smallest value (as text)."""
    cols = [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))]
    aggs = []
    for c in cols:
        aggs += [F.count(F.col(c)).alias(f"{c}__n"), F.min(F.col(c)).cast("string").alias(f"{c}__min")]
    wide = df.agg(*aggs)
    types = dict(df.dtypes)
    stack = ", ".join(f"'{c}', '{types[c]}', `{c}__n`, `{c}__min`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {stack}) as (column_name, dtype, non_null, min_value)")


def conform(df: DataFrame, schema: T.StructType, defaults: dict[str, Column]) -> DataFrame:
    """``df`` with every field of ``schema`` in its type: a missing field takes its
    default, or null; other columns stay behind them."""
    have = set(df.columns)

    def field(f: T.StructField) -> Column:
        value = F.col(f"`{f.name}`").cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        return (F.coalesce(value, defaults[f.name].cast(f.dataType)) if f.name in defaults else value).alias(f.name)

    return df.select(*[field(f) for f in schema.fields], *[F.col(f"`{c}`") for c in df.columns if c not in schema.fieldNames()])


def alerts_of_requests(requests: DataFrame, now: Column) -> DataFrame:
    """Accepted requests as alerts.  The request's own fields lie over the alert
    that its log gives; the id is a digest of the request, a missing time is now,
    indicators start empty."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("raw_log", "source_ip", "dest_ip", "port", "timestamp", "event_type")]
    own = requests.withColumn("alert_id", F.concat(F.lit("REQ-"), F.md5(F.concat_ws("|", *parts))))
    own = own.withColumn("timestamp", F.regexp_replace("timestamp", "Z$", "+00:00").try_cast("timestamp"))
    empty = F.create_map().cast("map<string,array<string>>")
    return conform(own, ALERT_SCHEMA, {"timestamp": now, "iocs": empty}).drop("iocs")


def read_or_quarantine(spark: SparkSession, path: str, schema: str, valid: Column, quarantine: str) -> DataFrame:
    """Documents of JSON lines that parse and are ``valid``; the other lines go to
    the folder ``quarantine`` with their reason and text."""
    rows = spark.read.text(path)
    parsed = rows.select("value", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("d"))
    parsed = parsed.select("value", "d.*")
    reason = F.when(F.col("_corrupt").isNotNull(), F.lit("unparsable")).when(~F.coalesce(valid, F.lit(False)), F.lit("incomplete"))
    judged = parsed.withColumn("reason", reason)
    judged.where("reason is not null").select("reason", F.col("value").alias("line")).write.mode("overwrite").parquet(quarantine)
    return judged.where("reason is null").drop("reason", "value", "_corrupt")
