import os
import tempfile
import time

import pyarrow.parquet as pq

from vigil.operators.cards import repeat_attackers
from vigil.sources.testviews import alerts_view
from vigil.streaming import alerts_stream as S


def test_repeat_state_across_batches(spark):
    t = pq.read_table("/root/testdata/sf0.001/events.parquet").sort_by("ts")
    d = tempfile.mkdtemp(prefix="vigil-stream-")
    half = t.num_rows // 2
    pq.write_table(t.slice(0, half), os.path.join(d, "events-a.parquet"))
    time.sleep(1.1)
    pq.write_table(t.slice(half), os.path.join(d, "events-b.parquet"))
    stream = alerts_view(S.event_stream(spark, d, file_glob="events-*.parquet", max_files_per_trigger=1))
    out = S.run_available_now(S.repeat_attackers_stream(stream), "repeat-test", "append", S.batch_sink)
    got = {r.alert_id: r.n_sources for r in spark.read.parquet(out).collect()}
    batch = alerts_view(spark.read.parquet(os.path.join(d, "events-*.parquet")))
    exp = {r.alert_id: r.n_sources for r in repeat_attackers(batch).collect()}
    assert got == exp
    assert spark.read.parquet(out).count() == len(exp)


def test_micro_batch_is_dealt_to_all_cores(spark, tmp_path):
    """Files of one row group each: a batch is scored by all cores, and no row is lost or doubled."""
    spark.range(0, 4000, 1, 2).selectExpr("id as event_id", "id % 7 as user_id").write.parquet(f"{tmp_path}/feed")
    found = []

    def sink(batch, batch_id, out):
        found.append(batch.selectExpr("event_id", "spark_partition_id() p").collect())

    S.run_available_now(S.event_stream(spark, f"{tmp_path}/feed", "*.parquet", 1), "dealt", "append", sink)
    assert sorted(r.event_id for rows in found for r in rows) == list(range(4000))
    assert len(found) == 2 and all(len({r.p for r in rows}) == spark.sparkContext.defaultParallelism for rows in found)
