"""Structured Streaming jobs over alert sources.

The scoring plan is the batch plan applied to a streaming DataFrame (it is
a chain of projections).  Stateful parts use Spark's own state:
``groupBy`` aggregates for counters and decoy state, a watermark with
``dropDuplicatesWithinWatermark`` for duplicate suppression, event-time
windows for tick counts, and ``foreachBatch`` upserts where the sink is a
plain parquet folder.  Sinks write one folder per micro-batch and replace it
when the batch is replayed.  A job with a folder of its own resumes where it
stopped; a one-off run uses fresh folders under the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.folders import file_system, versions
from vigil.operators import report as R
from vigil.plans.scoring import score_alerts
from vigil.session import shared_path
from vigil.sources.testviews import alerts_view


def event_stream(spark: SparkSession, folder: str, file_glob: str = "events.parquet",
                 max_files_per_trigger: int = 1) -> DataFrame:
    """Events of a folder, a few files per micro-batch.  A file of one row group is
    one split, so a batch's rows are dealt to all cores before they are scored."""
    schema = spark.read.parquet(f"{folder}/{file_glob}").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
            .option("maxFilesPerTrigger", max_files_per_trigger).parquet(folder)
            .repartition(spark.sparkContext.defaultParallelism))


def scored_stream(spark: SparkSession, folder: str, as_of: str) -> DataFrame:
    return score_alerts(alerts_view(event_stream(spark, folder)), as_of)


def run_available_now(df: DataFrame, name: str, mode: str, sink, job: str | None = None) -> str:
    """Run a streaming query over everything available, then stop.
    ``sink(batch_df, batch_id, out_path)`` writes one micro-batch.

    ``job`` is the folder of a job that is run again and again: its output and
    checkpoint lie there, and a later run goes on where the last one stopped.
    Without it the run is a one-off in fresh folders."""
    spark = df.sparkSession
    out = f"{job}/out" if job else shared_path(spark, f"{name}-out")
    ckpt = f"{job}/ckpt" if job else shared_path(spark, f"{name}-ckpt")
    q = (df.writeStream.outputMode(mode).option("checkpointLocation", ckpt)
         .foreachBatch(lambda b, i: sink(b, i, out)).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def batch_sink(batch: DataFrame, batch_id: int, out: str) -> None:
    """One folder per micro-batch, replaced when the batch is replayed."""
    batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")


def latest_per_key(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Read an upsert log and keep the newest version of each key (a partial
    aggregate, so each task sends one row per key)."""
    log = spark.read.parquet(out)
    values = [c for c in log.columns if c not in (*keys, "batch_id")]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v"))
    return newest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])


def compact_log(spark: SparkSession, out: str, keys: list[str], into: str) -> None:
    """Write the newest version of each key as a log of one batch."""
    last = spark.read.parquet(out).agg(F.max("batch_id")).first()[0]
    latest_per_key(spark, out, keys).write.mode("overwrite").parquet(f"{into}/batch_id={last}")


def severity_counters(scored: DataFrame) -> DataFrame:
    return scored.groupBy("severity").agg(F.count(F.lit(1)).alias("n_alerts"))


def decoy_state(scored: DataFrame) -> DataFrame:
    return (scored.where(F.col("decoy_asset_id").isNotNull())
            .groupBy(F.col("decoy_asset_id").alias("asset_id"))
            .agg(F.count(F.lit(1)).alias("trigger_count"), F.max("timestamp").alias("last_triggered")))


def tick_counts(scored: DataFrame, tick: str = "5 seconds", watermark: str = "10 minutes") -> DataFrame:
    """Duplicate suppression by alert id, then per-tick counts by severity.
    Rows later than the watermark are dropped by Spark (dedup and windows)."""
    w = scored.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(["alert_id"])
    return (w.groupBy(F.window("timestamp", tick).alias("win"), "severity")
             .agg(F.count(F.lit(1)).alias("n_alerts"))
             .select(F.col("win.start").alias("tick_ts"), "severity", "n_alerts"))


def seal_sink(batch: DataFrame, batch_id: int, out: str) -> None:
    """Append sealed alerts (never drops rows) to a parquet archive."""
    batch_sink(batch.select("snapshot_id", "alert_id", "payload", F.col("vault_hash").alias("sha256"), "captured_at"), batch_id, out)


def recent_buffer_sink(n: int = 50):
    """foreachBatch sink keeping only the newest ``n`` alerts (bounded table).

    Version k of the buffer is made of version k - 1 and batch k, and replaces
    itself when the batch is replayed; read errors are raised."""
    def sink(batch: DataFrame, batch_id: int, out: str) -> None:
        spark = batch.sparkSession
        cur = batch.select("alert_id", "timestamp", "severity", "verification_status")
        if batch_id > 0:
            cur = spark.read.parquet(f"{out}/batch_id={batch_id - 1}").unionByName(cur)
        top = (cur.dropDuplicates(["alert_id"]).orderBy(F.col("timestamp").desc(), F.col("alert_id").desc()).limit(n))
        batch_sink(top, batch_id, out)
    return sink


def newest_buffer(spark: SparkSession, out: str) -> DataFrame:
    """The last version of a buffer."""
    versions = spark.read.parquet(out)
    return versions.where(F.col("batch_id") == versions.agg(F.max("batch_id")).first()[0]).drop("batch_id")


def drop_known(batch: DataFrame, known: DataFrame | None, key: str) -> DataFrame:
    """One row of each ``key`` that ``known`` does not hold."""
    fresh = batch.dropDuplicates([key])
    return fresh if known is None else fresh.join(known.select(key), key, "left_anti")


class SeenStore:
    """Keys seen so far, in a folder: ``base=k`` holds those of all batches up to
    k, ``batch_id=k`` the new ones of batch k.  A batch reads what came before it
    only, so a replay sees the same store; every ``compact_every`` batches the
    earlier ones become one base, and what it covers is deleted."""

    def __init__(self, spark: SparkSession, folder: str, key: str, compact_every: int = 20):
        self.spark, self.folder, self.key, self.compact_every = spark, folder, key, compact_every

    def versions(self, kind: str) -> list[int]:
        return versions(self.spark, self.folder, kind)

    def before(self, batch_id: int) -> DataFrame | None:
        """The keys of all batches before ``batch_id``."""
        base = max((b for b in self.versions("base") if b < batch_id), default=None)
        parts = [f"{self.folder}/base={base}"] if base is not None else []
        parts += [f"{self.folder}/batch_id={b}" for b in self.versions("batch_id") if (-1 if base is None else base) < b < batch_id]
        return self.spark.read.schema(f"{self.key} string").parquet(*parts) if parts else None

    def add(self, keys: DataFrame, batch_id: int) -> None:
        keys.select(self.key).write.mode("overwrite").parquet(f"{self.folder}/batch_id={batch_id}")
        if batch_id and batch_id % self.compact_every == 0:
            self.compact(batch_id - 1)

    def compact(self, upto: int) -> None:
        bases = self.versions("base")
        covered = [("base", b) for b in bases if b < upto] + [("batch_id", b) for b in self.versions("batch_id") if b <= upto]
        if upto not in bases:  # a replay finds it written
            self.before(upto + 1).write.mode("overwrite").parquet(f"{self.folder}/base={upto}")
        fs, path = file_system(self.spark, self.folder)
        for kind, b in covered:
            fs.delete(path.suffix(f"/{kind}={b}"), True)


def unique_sink(key: str, columns: list[str], compact_every: int = 20):
    """foreachBatch sink that writes each ``key`` once, over all batches and restarts."""
    def sink(batch: DataFrame, batch_id: int, out: str) -> None:
        spark = batch.sparkSession
        store = SeenStore(spark, f"{out}-seen", key, compact_every)
        batch_sink(drop_known(batch.select(*columns), store.before(batch_id), key), batch_id, out)
        store.add(spark.read.parquet(f"{out}/batch_id={batch_id}"), batch_id)
    return sink


def fp_rate_of_buffer(buffer: DataFrame) -> DataFrame:
    return R.false_positive_rate(buffer, n=50)


REPEAT_OUT = "alert_id string, slash16 string, n_sources long, repeat_attacker boolean"
REPEAT_STATE = "ts array<bigint>, ips array<string>"


def sources_in_window(times, sources, window_us: int):
    """For rows in order of time the number of different sources from
    ``window_us`` before each to its own time (equal times included).  Both ends
    of the window move forward only, so the work is linear in the rows."""
    import numpy as np
    out = np.zeros(len(times), dtype="int64")
    counts: dict = {}
    left = right = 0
    for i, t in enumerate(times):
        while right < len(times) and times[right] <= t:
            counts[sources[right]] = counts.get(sources[right], 0) + 1
            right += 1
        while times[left] < t - window_us:
            if counts[sources[left]] == 1:
                del counts[sources[left]]
            else:
                counts[sources[left]] -= 1
            left += 1
        out[i] = len(counts)
    return out


def _repeat_state_fn(window_us: int):
    """Per /16: distinct sources within ``window_us`` before each alert
    (inclusive, equal times included).  State keeps only the (time, source)
    pairs still inside the window after the batch, so it stays bounded by
    the arrival rate of one /16 over one window."""
    def fn(key, pdfs, state):
        import numpy as np
        import pandas as pd
        batch = pd.concat(list(pdfs), ignore_index=True)
        ts, ips = state.get if state.exists else ([], [])
        t = np.concatenate([np.asarray(ts, dtype="int64"), batch["t"].to_numpy()])
        source = np.concatenate([np.asarray(list(ips), dtype=object), batch["source_ip"].to_numpy(dtype=object)])
        order = np.argsort(t, kind="stable")
        n = np.empty(len(t), dtype="int64")
        n[order] = sources_in_window(t[order].tolist(), source[order].tolist(), window_us)
        n = n[len(ts):]
        keep = order[t[order] >= t.max() - window_us]
        state.update((t[keep].tolist(), source[keep].tolist()))
        yield pd.DataFrame({"alert_id": batch["alert_id"], "slash16": key[0], "n_sources": n,
                            "repeat_attacker": n > 1})
    return fn


def repeat_attackers_stream(scored: DataFrame, window_s: int = 600) -> DataFrame:
    """Keyed state per /16 (``applyInPandasWithState``): pandas runs inside the
    tasks on one /16's rows of one micro-batch plus its retained window."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    from vigil.functions.net import slash16
    rows = (scored.where(F.col("source_ip").isNotNull() & (F.col("source_ip") != ""))
                  .select("alert_id", "source_ip", F.unix_micros("timestamp").alias("t"),
                          slash16(F.col("source_ip")).alias("slash16")))
    return rows.groupBy("slash16").applyInPandasWithState(
        _repeat_state_fn(window_s * 1_000_000), REPEAT_OUT, REPEAT_STATE, "append", GroupStateTimeout.NoTimeout)

