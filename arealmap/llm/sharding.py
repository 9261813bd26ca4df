"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly into memory-sized buckets by a seeded
hash.  Pass two shuffles each bucket in memory (Fisher-Yates over an order that
does not depend on arrival) and numbers its records after those of the buckets
before it.  The numbers are one uniform permutation of all records; cutting
it evenly gives shards whose row counts are at most one apart (law ``rows``).

Defined cases: a null text has no bytes and the checksum of no bytes; equal
texts, and rows that are equal throughout, are records of their own; an id whose
rows are more than ``hot_rows``, or more bytes than a bucket, is spread by row number instead; a
null id hashes like any value; an empty table gives an empty result; all
columns travel inside ``record``, so no name can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import small_side

SEED = 11
#: Bytes of a bucket, on average, and rows of one id beyond which they are spread.
BUCKET_BYTES = 8 << 20
HOT_ROWS = 10_000


def record_size(text: str = "text"):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def shuffled(docs: DataFrame, shards: int = 40, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(record, shard, slot): every row of ``docs`` (with doc_id and text) in its shard, slots gapless from 0."""
    total, rows = docs.agg(F.coalesce(F.sum(record_size()), F.lit(0)), F.count("*")).first()
    buckets, rows = max(1, -(-total // bucket_bytes)), max(1, rows)
    # Rows of one key go by the text's digest; what can't be ordered needs no order then.
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("record"), F.col("doc_id").cast("long").alias("id"), digest.alias("digest"))
    many = (F.count("*") > hot_rows) | (F.sum(record_size()) > bucket_bytes)
    hot = docs.groupBy(F.col("doc_id").cast("long").alias("hot")).agg(many.alias("many")).where("many").select("hot")
    if n := hot.count():
        held = held.join(small_side(hot, n), F.col("id").eqNullSafe(F.col("hot")), "left_outer")
        held = held.withColumn("spread", F.when(F.col("id").eqNullSafe(F.col("hot")), F.monotonically_increasing_id()).otherwise(F.lit(0))).drop("hot")
    else:
        held = held.withColumn("spread", F.lit(0).cast("long"))
    held = held.withColumn("key", F.xxhash64(F.lit(seed), "id", "spread"))
    held = held.withColumn("bucket", F.pmod(F.col("key"), F.lit(buckets)).cast("int"))

    scattered = held.select("bucket", F.struct("key", "digest", "record").alias("item")).repartitionById(buckets, F.col("bucket"))
    # One bucket a partition: sorting first makes the seeded shuffle the same however records arrived.
    ordered = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).when(a["digest"] < b["digest"], -1).when(a["digest"] > b["digest"], 1).otherwise(0)
    collected = scattered.groupBy("bucket").agg(F.collect_list("item").alias("items"))
    plain = not any(isinstance(x.dataType, MapType) or "map<" in x.dataType.simpleString() or "variant" in x.dataType.simpleString() for x in docs.schema)
    whole = collected.select("bucket", (F.sort_array("items") if plain else F.array_sort("items", ordered)).alias("items"))
    mixed = whole.select("bucket", F.size("items").alias("found"), F.shuffle("items", F.lit(seed)).alias("items"))

    counts = held.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("group", F.floor(F.col("bucket") / 1024))
    inner = Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.groupBy("group").agg(F.sum("n").alias("words")).select("group", (F.sum("words").over(outer) - F.col("words")).alias("before"))
    offsets = counts.join(sums, "group").select(F.col("bucket").alias("of"), "n", (F.col("before") + F.sum("n").over(inner) - F.col("n")).alias("offset"))
    placed = mixed.join(small_side(offsets, buckets), F.col("bucket") == F.col("of"))
    placed = placed.withColumn("offset", F.when(F.col("found") == F.col("n"), F.col("offset")).otherwise(F.raise_error(F.lit("the input changed between the two passes")).cast("long")))
    spread = placed.select("offset", F.posexplode("items").alias("at", "item")).select((F.col("offset") + F.col("at")).alias("place"), F.col("item.record").alias("record"))
    spread = spread.withColumn("shard", F.expr(f"place * {shards} div {rows}").cast("int"))
    return spread.select("record", "shard", (F.col("place") - F.expr(f"(shard * {rows}L + {shards - 1}) div {shards}")).alias("slot"))


def write_shards(out: DataFrame, path: str, shards: int = 40) -> None:
    """One folder per shard, its records in slot order."""
    out.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
