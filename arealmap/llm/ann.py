"""Approximate nearest neighbours by multi-index hashing.

Codes: vectors are centred, projected on their principal axes and rotated so
that their signs lose least (iterative quantisation); the signs are the bits.
Index: a code is split into m substrings, and each substring of each shard has
a table from its value to rows.  Search: if two codes differ in at most r bits,
one substring differs in at most its share of r (pigeonhole), so probing every
table within that share and checking whole codes finds every code within r.
The radius grows ring by ring, so that only keys near the query's are looked
up: step r adds, in table r mod m, the keys r div m bits away, after which every
code within r bits is found.  It stops ``margin`` bits past the radius that
holds k codes.  The found rows are ranked by exact distances of the original
vectors, in double precision.

Codes and margin are learnt from a bounded sample (``sample_rows``, smallest
seeded hash first): the margin takes in the wanted share of the sample's true
neighbours.  Every row is indexed.  The stated queries meet the shards in
blocks; a task holds one shard and one block.  How many rows the probes touch
is the data's: few where vectors lie in clusters, most where they have no
direction in common (the README has figures).

Defined cases: vectors that are null, empty, zero, or hold a null or a value
that isn't finite take no part, nor do rows without an id, nor vectors of
another length than the most frequent (longest of equals), to which no distance
is defined; rows that share an id are rows of their own, each a candidate of the
other; ties go to the smaller id; fewer rows than neighbours give them all; an
empty table gives an empty result; other columns are ignored, whatever they
are called.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

SAMPLE_ROWS, SAMPLE_QUERIES = 20_000, 256
#: Share of the sample's true neighbours that the margin takes in.
WITHIN = 0.975
#: Rows of a shard, and queries of a block.
SHARD_ROWS, BLOCK_ROWS = 16_384, 16_384
#: Bits of a substring.
SUBSTRING = 16
SEED = 5


@dataclass(frozen=True)
class Coder:
    mean: np.ndarray
    axes: np.ndarray
    margin: int

    @property
    def bits(self) -> int:
        return self.axes.shape[1]

    def codes(self, rows: np.ndarray) -> np.ndarray:
        signs = (rows - self.mean) @ self.axes > 0
        out = np.zeros(len(rows), np.uint64)
        for i in range(self.bits):
            out |= signs[:, i].astype(np.uint64) << np.uint64(i)
        return out


def distances(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    apart = rows - query
    return np.sqrt((apart * apart).sum(axis=1))


def learn(sample: np.ndarray, k: int = 10, within: float = WITHIN, rounds: int = 40, seed: int = SEED) -> Coder:
    """Rotation by iterative quantisation, and the radius of the sample's neighbours."""
    width = sample.shape[1]
    bits = min(64, width)
    mean = sample.mean(0)
    _, _, turned = np.linalg.svd(np.cov((sample - mean).T).reshape(width, width) if len(sample) > 1 else np.eye(width))
    axes = turned[:bits].T
    flat = (sample - mean) @ axes
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))[0]
    for _ in range(rounds):
        signs = np.where(flat @ rotation > 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(signs.T @ flat)
        rotation = (u @ v).T
    coder = Coder(mean, axes @ rotation, bits)
    if len(sample) <= 4 * k:
        return coder
    codes, past = coder.codes(sample), []
    for i in np.linspace(0, len(sample) - 1, min(SAMPLE_QUERIES, len(sample))).astype(int):
        d = distances(sample[i], sample)
        d[i] = np.inf
        bits_apart = np.bitwise_count(codes[i] ^ codes).astype(np.int64)
        bits_apart[i] = 64
        past.append(bits_apart[np.argpartition(d, k)[:k]] - np.partition(bits_apart, k - 1)[k - 1])
    return Coder(mean, coder.axes, max(0, int(np.quantile(np.concatenate(past), within, method="higher"))))


class Index:
    """The substring tables of one shard: rows by the value of a substring, found by address."""

    def __init__(self, codes: np.ndarray, bits: int, substring: int = SUBSTRING):
        self.codes, self.tables = codes, []
        for low in range(0, bits, substring):
            width = min(substring, bits - low)
            part = self._part(codes, low, width)
            order = np.argsort(part, kind="stable")
            starts = np.searchsorted(part[order], np.arange((1 << width) + 1))
            keys = np.arange(1 << width)
            apart = np.bitwise_count(keys.astype(np.uint64))
            self.tables.append((low, width, order, starts, [keys[apart == x] for x in range(width + 1)], np.unique(part)))

    @staticmethod
    def _part(codes, low: int, width: int):
        return (codes >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64)

    def _ring(self, code: np.uint64, table: int, away: int) -> np.ndarray:
        """Rows whose substring differs from the code's in ``away`` bits."""
        low, width, order, starts, masks, present = self.tables[table]
        if away > width:
            return order[:0]
        own = self._part(code, low, width)
        # The keys that far away, or those that are there, whichever are fewer.
        keys = masks[away] ^ own if len(masks[away]) <= len(present) else present[np.bitwise_count((present ^ own).astype(np.uint64)) == away]
        begin = starts[keys]
        many = starts[keys + 1] - begin
        ends = np.cumsum(many)
        return order[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + many, many)]

    def search(self, code: np.uint64, k: int, margin: int) -> tuple[np.ndarray, int]:
        """Rows within ``margin`` bits past the radius that holds k codes (all, if there are fewer), and how many rows the probes touched."""
        n = len(self.codes)
        apart = np.full(n, 255, np.uint8)
        counts, touched, stop, r = np.zeros(65, np.int64), 0, None, 0
        while touched < n and (stop is None or r <= stop):
            rows = self._ring(code, r % len(self.tables), r // len(self.tables))
            rows = rows[apart[rows] == 255]
            apart[rows] = np.bitwise_count(self.codes[rows] ^ code)
            counts += np.bincount(apart[rows], minlength=65)
            touched += len(rows)
            if stop is None and counts[: r + 1].sum() >= k:
                stop = r + margin
            r += 1
        if stop is None:  # all rows are found; the radius that holds k of them is known
            holds = np.flatnonzero(np.cumsum(counts) >= k)
            stop = int(holds[0]) + margin if len(holds) else 64
        return np.flatnonzero(apart <= min(stop, 64)), touched


def _search(coder: Coder, k: int):
    shape = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def vectors(rows: pa.Table, name: str) -> np.ndarray:
        return rows.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, -1)

    def run(shard: pa.Table, block: pa.Table) -> pa.Table:
        if not shard.num_rows or not block.num_rows:
            return shape.empty_table()
        ids, own, rows = shard.column("vec_id").to_numpy(), shard.column("row").to_numpy(), vectors(shard, "embedding")
        index, out = Index(coder.codes(rows), coder.bits), []
        wanted = vectors(block, "query")
        for query, number, vector, code in zip(block.column("query_id").to_numpy(), block.column("query_row").to_numpy(), wanted, coder.codes(wanted), strict=True):
            found, _ = index.search(code, k + 1, coder.margin)
            found = found[own[found] != number]
            d = distances(vector, rows[found])
            if len(d) > k:
                near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                found, d = found[near], d[near]
            best = np.lexsort((ids[found], d))[:k]
            out.append((np.full(len(best), query), np.full(len(best), number), ids[found[best]], d[best]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=shape)

    return run


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part, all of one length."""
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    plain = plain.where("vec_id is not null and embedding is not null").where(fine)
    length = plain.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return plain.where(F.size("embedding") == (length["n"] if length else 0))


def nearest(vectors: DataFrame, is_query, k: int = 10, sample_rows: int = SAMPLE_ROWS, within: float = WITHIN) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found rows of each row of ``vectors`` for which ``is_query`` holds."""
    rows = durable(valid(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, queries = rows.agg(F.count("*"), F.count_if(is_query)).first()
    empty = "query_id long, query_row long, vec_id long, score double"
    if not n or not queries:
        return vectors.sparkSession.createDataFrame([], empty).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    sample = rows.orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id", "embedding").limit(sample_rows).select("embedding").toArrow()
    coder = learn(sample.column("embedding").combine_chunks().flatten().to_numpy().reshape(sample.num_rows, -1), k, within)
    shards, blocks = -(-n // SHARD_ROWS), -(-queries // BLOCK_ROWS)
    spread = lambda m, over, seed: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(m)).cast("int").alias(over)
    every = lambda m, over: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(over)
    index = rows.select("vec_id", "row", "embedding", spread(shards, "shard", 1), every(blocks, "block"))
    asked = rows.where(is_query).select("vec_id", "row", "embedding", spread(blocks, "of_block", 2), every(shards, "of_shard"))
    asked = asked.withColumnsRenamed({"vec_id": "query_id", "row": "query_row", "embedding": "query"})  # both sides come from one table
    found = index.groupBy("shard", "block").cogroup(asked.groupBy("of_shard", "of_block")).applyInArrow(_search(coder, k), empty)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
