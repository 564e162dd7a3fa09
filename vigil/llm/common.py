"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.session import ensure_checkpoint_dir


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package where it is run from its folder
    rather than installed or shipped with ``--py-files``."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known]))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"


def text_bytes(col: str | Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there, so
    that later branches neither recompute it nor depend on one executor.  The
    shuffle files that led to it go at once."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    drop_shuffles(df)
    return out


def drop_shuffles(df: DataFrame) -> None:
    """Remove the shuffle files that an action on ``df`` itself has left.

    Spark keeps them until the driver's JVM happens to collect the plan, which no
    amount of disk hurries.  Their stages stay registered, so a plan that is run
    again makes them anew.  Without adaptive execution they wait as before."""
    sc = df.sparkSession.sparkContext
    try:
        for i in list(df._jdf.queryExecution().executedPlan().context().shuffleIds().keySet()):
            sc._jsc.sc().shuffleDriverComponents().removeShuffle(i, False)
    except Py4JError:  # another plan, or another version of Spark
        pass


def release() -> None:
    """Give memory that a task has freed back to the system; a worker that waits
    for its next task would keep it beside those that run."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, with its memory given back at the end."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return task


def then_release(run: Callable, *tables: pa.Table) -> pa.Table:
    """``run`` over a group's tables, with its memory given back at the end."""
    out = run(*tables)
    release()
    return out


def blocks_for(total_bytes: int | None, block_bytes: int) -> int:
    """Number of blocks of about ``block_bytes`` that hold ``total_bytes``; it grows with the data."""
    return max(1, -(-int(total_bytes or 0) // block_bytes))


BITMAP_WORDS = 1 << 17  # 64-bit words of a membership bitmap: 1 MB of bits, whatever the data


def _bit(col: str) -> Column:
    return F.pmod(F.xxhash64(F.col(col).cast("long")), F.lit(BITMAP_WORDS * 64))


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores after it until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def in_bitmap(df: DataFrame, col: str, ids: DataFrame, id_col: str, outside: bool = False) -> DataFrame:
    """Rows whose hashed ``col`` is marked by some id (a superset of the rows
    whose id is among ``ids``), or with ``outside`` the other rows.

    A prefilter before a join on the id: it keeps long texts that cannot match
    out of the shuffle.  The bitmap has at most ``BITMAP_WORDS`` rows, which
    bounds the broadcast; with very many ids it fills up and lets rows pass."""
    hashed, word, bits = (free_name(df, c) for c in ("_h", "_w", "_bits"))
    words = (ids.where(F.col(id_col).isNotNull()).select(_bit(id_col).alias("p"))
             .groupBy(F.floor(F.col("p") / 64).cast("long").alias(word))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias(bits)))
    marked = F.expr(f"{bits} is not null and {hashed} is not null and (shiftright({bits}, cast({hashed} % 64 as int)) & 1L) = 1L")
    out = (df.withColumn(hashed, F.when(F.col(f"`{col}`").isNotNull(), _bit(f"`{col}`"))).withColumn(word, F.floor(F.col(hashed) / 64).cast("long"))
           .join(F.broadcast(words), word, "left"))
    return out.where(~marked if outside else marked).select(*[F.col(f"`{c}`") for c in df.columns])


def keyed(docs: DataFrame, row: str = "row") -> DataFrame:
    """``docs`` with a 64-bit key of each row, the same for rows of equal doc_id and text; null counts as empty text."""
    return docs.withColumn(row, F.xxhash64(F.col("doc_id").cast("long"), text_bytes("text")))


def without_ids(df: DataFrame, col: str, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``df`` whose ``col`` is not among ``ids``; only rows that the bitmap marks are shuffled."""
    sure = in_bitmap(df, col, ids, id_col, outside=True)
    gone = free_name(df, "_gone")
    ids = ids.select(F.col(id_col).alias(col)).distinct().withColumn(gone, F.lit(True))
    # no anti-join: the optimizer would put it below the bitmap, and all rows into its shuffle
    rest = in_bitmap(df, col, ids, col).join(ids, col, "left").where(F.col(gone).isNull()).select(*[F.col(f"`{c}`") for c in df.columns])
    return sure.unionByName(rest)
