"""Sharding by fixed virtual slots.

Every record hashes to one of ``N_SLOTS`` virtual slots; the number of slots
never changes.  A *slot map* gives each slot's shard.  It is versioned: growing
or rebalancing appends a version that differs from the last in the slots that
move, so only their records move.  Bytes and records are aggregated per slot;
``rebalanced`` edits the map by those bytes, ``grown`` by slot counts alone
(then the record's key and the number of shards decide its shard, law ``key``).

The map has ``N_SLOTS`` entries whatever the data, so it is edited on the
driver, kept as a small Parquet table and attached to rows as a literal array.
Rows themselves are placed by expressions only.

Defined results: a null key hashes like one more key value; a null text has no
bytes (size is the fixed overhead) and checksum 0; repeated rows share a slot
and get successive positions; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import shared_folder

N_SLOTS = 4096
ROW_OVERHEAD = 16


def virtual_slot(key: Column, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_slots)).cast("int")


def grown(slot_map: list[int]) -> list[int]:
    """The next version with one more shard: it takes its even share of slots,
    one at a time from whichever shard then has most; no other slot moves."""
    n_old = max(slot_map) + 1
    held: dict[int, list[int]] = {s: [] for s in range(n_old)}
    for slot, shard in enumerate(slot_map):
        held[shard].append(slot)
    out = list(slot_map)
    for _ in range(len(slot_map) // (n_old + 1)):
        giver = max(held, key=lambda s: (len(held[s]), -s))
        out[held[giver].pop()] = n_old
    return out


def map_for(n_shards: int, n_slots: int = N_SLOTS) -> list[int]:
    """The map that ``n_shards - 1`` growth edits make of the one-shard map."""
    if not 1 <= n_shards <= n_slots:
        raise ValueError("the number of shards must lie between 1 and the number of slots")
    slot_map = [0] * n_slots
    for _ in range(n_shards - 1):
        slot_map = grown(slot_map)
    return slot_map


def rebalanced(slot_map: list[int], slot_bytes: dict[int, int], tolerance: float = 0.02) -> list[int]:
    """The next version with bytes evened out: while the heaviest shard lies
    more than ``tolerance`` above the mean, it gives the lightest the largest
    slot that fits into half their gap."""
    n = max(slot_map) + 1
    out, load = list(slot_map), [0] * n
    held: list[set[int]] = [set() for _ in range(n)]
    for slot, shard in enumerate(slot_map):
        load[shard] += slot_bytes.get(slot, 0)
        held[shard].add(slot)
    mean = sum(load) / n
    for _ in range(len(slot_map)):
        high, low = max(range(n), key=lambda s: (load[s], -s)), min(range(n), key=lambda s: (load[s], s))
        if load[high] <= mean * (1 + tolerance):
            break
        movable = [s for s in held[high] if 0 < 2 * slot_bytes.get(s, 0) <= load[high] - load[low]]
        if not movable:
            break
        slot = max(movable, key=lambda s: (slot_bytes[s], -s))
        held[high].remove(slot)
        held[low].add(slot)
        load[high] -= slot_bytes[slot]
        load[low] += slot_bytes[slot]
        out[slot] = low
    return out


def _map_column(slot: Column, slot_map: list[int]) -> Column:
    table = F.split(F.lit(",".join(map(str, slot_map))), ",").cast("array<int>")
    return F.element_at(table, slot + 1)


def save_map(spark: SparkSession, path: str, version: int, slot_map: list[int]) -> None:
    """Append one version (``version, slot, shard``); earlier versions stay readable."""
    (spark.range(len(slot_map)).select(F.lit(version).alias("version"), F.col("id").cast("int").alias("slot"))
     .withColumn("shard", _map_column(F.col("slot"), slot_map))
     .coalesce(1).write.mode("append").partitionBy("version").parquet(path))


def load_map(spark: SparkSession, path: str, version: int | None = None) -> list[int]:
    """A stored version, the newest by default."""
    maps = spark.read.parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return [r["shard"] for r in maps.where(F.col("version") == version).orderBy("slot").collect()]


def place(df: DataFrame, key: str, slot_map: list[int], out: str = "shard") -> DataFrame:
    """Adds ``vslot`` and the shard that ``slot_map`` gives it."""
    df = df if "vslot" in df.columns else df.withColumn("vslot", virtual_slot(F.col(key), len(slot_map)))
    return df.withColumn(out, _map_column(F.col("vslot"), slot_map))


def slot_totals(placed: DataFrame, size: str = "size") -> DataFrame:
    """``vslot, slot_rows, slot_bytes``: at most one row per virtual slot."""
    return placed.groupBy("vslot").agg(F.count(F.lit(1)).alias("slot_rows"), F.sum(size).alias("slot_bytes"))


def with_positions(placed: DataFrame, totals: DataFrame, order_by: list[str]) -> DataFrame:
    """Adds ``slot``, the row's position in its shard (gapless from 0).

    Rows are numbered inside their virtual slot, a small share of a shard, and
    shifted by the rows of the shard's earlier slots; that offset table has one
    row per virtual slot, which bounds the broadcast."""
    earlier = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (totals.join(placed.select("vslot", "shard").distinct(), "vslot") if "shard" not in totals.columns else totals)
    offsets = offsets.select("vslot", "slot_bytes", F.coalesce(F.sum("slot_rows").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("vslot").orderBy(*order_by)
    return (placed.withColumn("_in_slot", F.row_number().over(inside) - 1)
            .join(F.broadcast(offsets), "vslot")
            .withColumn("slot", (F.col("_before") + F.col("_in_slot")).cast("long"))
            .drop("_before", "_in_slot"))


def shard_documents(docs: DataFrame, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """One row per document with size, checksum, shard, position and the shard after growth by one.

    The map is stored in the shared folder, version 1 with ``n_shards`` shards and
    version 2 with one more; rows are placed by what is read back."""
    spark = docs.sparkSession
    path = shared_folder(spark, "slot-map")
    save_map(spark, path, 1, map_for(n_shards, n_slots))
    save_map(spark, path, 2, grown(load_map(spark, path)))
    now, more = load_map(spark, path, 1), load_map(spark, path, 2)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + ROW_OVERHEAD).cast("long").alias("size"),
                       F.crc32(raw).cast("long").alias("text_crc32"))
    rows = place(place(rows, "doc_id", now), "doc_id", more, "grown_shard")
    totals = place(slot_totals(rows), "doc_id", now)
    return with_positions(rows, totals, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "vslot", "slot_bytes")
