"""Exact deduplication by composable polynomial fingerprints.

A text's fingerprint is a polynomial in its bytes, modulo two primes.  Two
neighbouring chunks combine by shifting the left value by the length of the
right one, so chunks of a huge text are hashed in parallel and combined
afterwards.  Texts with equal fingerprints are then compared chunk by chunk
against one representative per group, streaming; groups of any size are split
over tasks and only their representatives meet again.

Defined cases: a null text counts as empty; empty texts equal each other; of
equal texts the smallest id stays (null ids last; of repeated rows with that
id, one row); an empty table gives an empty result; columns other than the id
and the text are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACE, durable, few_at_a_time, small_side, spread_join, unwrapped, wrapped

#: The two primes and the point at which the polynomials are taken.
PRIMES = (2147483647, 2147483629)
POINTS = (1103515245, 362436069)
#: Bytes hashed by one vector operation, and compared at once.
CHUNK = 1 << 16
#: Characters beyond which the chunks of one text are hashed by several tasks.
HUGE = 1 << 24
#: Rows of one fingerprint that one task compares; larger groups are split.
GROUP_ROWS = 4096


def _powers(n: int, point: int, prime: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    for i in range(1, n):
        out[i] = int(out[i - 1]) * point % prime
    return out[::-1].copy()


class Polynomial:
    """Fingerprints (value per prime, length); ``primes`` can be weakened in tests."""

    def __init__(self, primes: tuple[int, int] = PRIMES, points: tuple[int, int] = POINTS, chunk: int = CHUNK):
        self.primes, self.points, self.chunk = primes, points, chunk
        self.tables = [_powers(chunk, x % p, p) for x, p in zip(points, primes, strict=True)]

    def chunk_hash(self, data: bytes | memoryview) -> tuple[int, int, int]:
        n = len(data)
        values = np.frombuffer(data, np.uint8).astype(np.uint64)
        return (*(int((values * t[-n:]).sum()) % p if n else 0 for t, p in zip(self.tables, self.primes, strict=True)), n)

    def combine(self, left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
        return (*((a * pow(x, right[2], p) + b) % p for a, b, x, p in zip(left[:2], right[:2], self.points, self.primes, strict=True)), left[2] + right[2])

    def of(self, data: bytes) -> tuple[int, int, int]:
        view, out = memoryview(data), (0, 0, 0)
        if len(view) <= self.chunk:
            return self.chunk_hash(view)
        for i in range(0, len(view), self.chunk):
            out = self.combine(out, self.chunk_hash(view[i : i + self.chunk]))
        return out


def _packed(value: tuple[int, int, int]) -> int:
    return value[0] << 31 | value[1]


def normalised(text: str = "text"):
    """Each run of white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), f"[{SPACE}]+", " ")


def fingerprints(docs: DataFrame, make=Polynomial, huge: int = HUGE, huge_texts: bool = True) -> DataFrame:
    """From (doc_id, row, norm, text_sha256) to (doc_id, row, text_sha256, fp, n_bytes); the text itself stays behind.

    ``huge_texts`` tells whether any text may have more than ``huge`` characters.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = make()
        for batch in few_at_a_time(batches):
            found = [hasher.of(x.as_py().encode()) for x in batch.column("norm")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), batch.column("text_sha256"), pa.array([_packed(x) for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64())], ["doc_id", "row", "text_sha256", "fp", "n_bytes"])

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = make()
        for batch in few_at_a_time(batches):
            found = [hasher.of(x.as_py().encode()) for x in batch.column("norm")]
            columns = [pa.array([x[i] for x in found], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "row", "text_sha256", "piece")] + columns, ["doc_id", "row", "text_sha256", "piece", "h0", "h1", "n"])

    def joined(key, pieces):
        hasher, out = make(), (0, 0, 0)
        for x in pieces.sort_values("piece").itertuples():
            out = hasher.combine(out, (x.h0, x.h1, x.n))
        return pieces.iloc[:1][["doc_id", "row", "text_sha256"]].assign(fp=_packed(out), n_bytes=out[2])

    shape = "doc_id long, row long, text_sha256 string, fp long, n_bytes long"
    size = F.length("norm")
    short = docs.where(size <= huge).select("doc_id", "row", "text_sha256", "norm").mapInArrow(whole, shape)
    if not huge_texts:
        return short
    pieces = docs.where(size > huge).select("doc_id", "row", "text_sha256", "norm", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / huge).cast("int"))).alias("piece"))
    pieces = pieces.select("doc_id", "row", "text_sha256", "piece", F.expr(f"substring(norm, piece * {huge} + 1, {huge})").alias("norm"))
    hashed = pieces.repartition("row", "piece").mapInArrow(chunked, "doc_id long, row long, text_sha256 string, piece int, h0 long, h1 long, n long")
    return short.unionByName(hashed.groupBy("row").applyInPandas(lambda key, x: joined(key, x), shape))


def _compare(label: str):
    """Stream rows sorted by group; each row is compared, chunk by chunk, with the group's representatives so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in few_at_a_time(batches):
            out = []
            for row in batch.to_pylist():
                key = (row["fp"], row["n_bytes"], row[label]) if label != "none" else (row["fp"], row["n_bytes"])
                if key != group:
                    group, held = key, []
                text = memoryview(row["norm"].encode())
                found = next((i for i, other in enumerate(held) if all(other[k : k + CHUNK] == text[k : k + CHUNK] for k in range(0, len(text), CHUNK))), len(held))
                fresh = found == len(held)
                if fresh:
                    held.append(text)
                out.append((row["fp"], row["n_bytes"], row["text_sha256"], found, row["norm"] if fresh else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string()), strict=True)], ["fp", "n_bytes", "text_sha256", "class", "norm"])

    return run


def equal_groups(docs: DataFrame, make=Polynomial, huge: int = HUGE) -> DataFrame:
    """Group the rows of ``docs`` (doc_id, text) by normalised text.

    Returns doc_id, row (a number of the input row), keep_id, group_size, kept,
    text_sha256, n_bytes.  Only fingerprints are shuffled; texts move only where a
    fingerprint repeats.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("norm")).withColumn("text_sha256", F.sha2("norm", 256))
    # Normalising never lengthens a text, so the raw bytes tell without it that none is huge.
    huge_texts = bool(docs.where(F.octet_length(F.col("text").cast("string")) > huge).take(1))
    marks = durable(fingerprints(texts.withColumn("row", F.monotonically_increasing_id()), make, huge, huge_texts), "fingerprints")
    repeated = durable(marks.groupBy("fp", "n_bytes").agg(F.count("*").alias("members")).where("members > 1"), "members")
    wanted = durable(spread_join(marks, repeated, ["fp", "n_bytes"], "members", "row").groupBy("text_sha256", "fp", "n_bytes").agg(F.max("members").alias("members"), F.count("*").alias("same")), "repeated")
    if wanted.take(1):
        again = texts.withColumn("row", F.monotonically_increasing_id())
        n = wanted.count()
        again = again.join(F.broadcast(wanted), "text_sha256") if n <= BROADCAST_ROWS else spread_join(again, wanted, ["text_sha256"], "same", "row")
        salted = again.withColumn("salt", F.when(F.col("members") > GROUP_ROWS, F.pmod(F.xxhash64("row"), F.ceil(F.col("members") / GROUP_ROWS))).otherwise(F.lit(0)).cast("long"))
        keys, shape = ["fp", "n_bytes", "salt"], "fp long, n_bytes long, text_sha256 string, class int, norm string"
        local = salted.select(*keys, "text_sha256", "norm").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare("salt"), shape)
        # One text of each class of each part remains; these meet again, by fingerprint alone.
        leaders = local.where("norm is not null").drop("class")
        classes = leaders.repartition("fp", "n_bytes").sortWithinPartitions("fp", "n_bytes", "text_sha256").mapInArrow(_compare("none"), shape).groupBy("text_sha256", "fp", "n_bytes").agg(F.max("class").alias("class"))
    else:
        classes = wanted.select("text_sha256", "fp", "n_bytes", F.lit(0).alias("class"))
    apart = durable(classes.where("class > 0").select("text_sha256", "class"), "collisions")
    marks = marks.join(small_side(apart), "text_sha256", "left").withColumn("class", F.coalesce("class", F.lit(0)))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    groups = durable(marks.groupBy("fp", "n_bytes", "class").agg(first, F.count("*").alias("group_size")), "groups")
    out = spread_join(marks, groups, ["fp", "n_bytes", "class"], "group_size", "row")
    return out.select("doc_id", "row", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256", "n_bytes")


def drop_copies(docs: DataFrame, make=Polynomial) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows of one id, one stays."""
    groups = durable(equal_groups(docs, make).where("not kept").select("doc_id", "keep_id", "text_sha256"), "dropped")
    again = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    gone = small_side(groups.where(~again).select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha")).distinct())
    marked = wrapped(docs, F.sha2(normalised(), 256).alias("sha")).drop("text")
    kept = marked.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("sha") == F.col("gone_sha")), "left_anti")
    if groups.where(again).take(1):
        kept = kept.dropDuplicates(["doc_id", "sha"])
    return unwrapped(kept, docs.columns)
