"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import types
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as a regular expression class body.
SPACE = r"\x20\x09-\x0D"
#: A side is broadcast only when its rows are counted and stay under this many.
BROADCAST_ROWS = 200_000
#: Rows of a key that one task of a join may hold, and how many keys may have more.
KEY_ROWS, KEYS = 2048, 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a local session without one gets its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not re.match(r"local($|\[)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def durable(df: DataFrame, name: str = "stage", by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: lineage ends here, and a lost
    executor costs a file read.  Column pruning still reaches the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def bucketed(df: DataFrame, buckets: int, *keys: str) -> DataFrame:
    """Like ``durable``, of rows already dealt by keys into as many partitions: joins by these keys don't move them again."""
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").bucketBy(buckets, *keys).saveAsTable(name)
    return spark.table(name)


def release(df: DataFrame) -> None:
    """Delete what ``durable`` wrote, once nothing reads it any more."""
    jvm, path = df.sparkSession._jvm, df._durable_path
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def wrapped(docs: DataFrame, *more: Column) -> DataFrame:
    """(record, doc_id, text, more...): a row's own columns travel inside ``record``, so their names can't clash."""
    record = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("record")
    return docs.select(record, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def unwrapped(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select(*(F.col(f"record.`{c}`") for c in names))


def spread_join(rows: DataFrame, one: DataFrame, keys: list[str], count: str, by: str | Column, most: int = 0) -> DataFrame:
    """Inner join of ``rows`` with ``one``, which holds each key once, and in ``count`` how many of the rows have it.

    Keys with over ``most`` rows (default: KEY_ROWS, or a share of 1 / KEYS of all rows, so at most
    KEYS keys exceed it and their list can be broadcast) are dealt over several tasks by a hash of ``by``.
    """
    if not most:
        most = max(KEY_ROWS, -(-(one.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]) // KEYS))
    hot = one.where(F.col(count) > most).select(*keys, F.ceil(F.col(count) / most).cast("int").alias("_parts"))
    if not hot.take(1):
        return rows.join(one, keys)
    salt = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("_parts"))).cast("int")
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_parts")
    parts = F.greatest(F.lit(1), F.ceil(F.col(count) / most).cast("int"))
    copies = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(copies, [*keys, "_salt"]).drop("_salt")


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcast a side whose counted rows stay under the bound; larger ones join by shuffle."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def few_at_a_time(batches, rows: int = 2000):
    """The rows of a task's batches, few at a time, so what is built beside them stays small; the memory they took goes back at the end."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    give_back()


def give_back() -> None:
    """Return a worker's free memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def crc32_of(column: str) -> Column:
    """Unsigned crc32 of a value written as text; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def worker_cache(key, make):
    """One value per Python worker process, kept across the tasks that the process runs."""
    store = sys.modules.setdefault("_arealmap_worker_cache", types.ModuleType("_arealmap_worker_cache")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]
