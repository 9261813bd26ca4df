"""SimHash near-deduplication with BK-trees.

Each text gets a 64-bit SimHash of its word shingles.  Distinct fingerprints
are routed to shards: a radius of r splits the bits into r + 1 blocks, and two
fingerprints within r agree on one block at least, so a shard is one value of
one block.  Every shard has its own BK-tree (children keyed by the integer
Hamming distance to the parent); the queries of a shard follow only edges
within the radius.  Handing every tree to every executor would grow with the
data, so trees stay with the fingerprints that can match them.  A shard of any
size is cut into parts of bounded size: each is a tree, and each pair of parts
is a piece of work of its own, one part the tree and the other its queries.
What a task finds leaves it as a spanning forest, never as all pairs; an
alternating star contraction joins the forests into components.

Defined cases: a null or wordless text has fingerprint zero and links like any
other; fewer words than a shingle make one shingle of all words; repeated
shingles count as often as they stand; equal texts share a fingerprint and so
a component; the smallest non-null id names a component; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, few_at_a_time, release, small_side, spread_join

#: Fingerprints in one BK-tree.
TREE_ROWS = 16_384
#: Fingerprints, over all shards, that one task holds.
TASK_ROWS = 250_000
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def simhash(text: bytes, words: int = 3, seed: int = 42) -> int:
    """SimHash over the XXH64 of word shingles, unsigned; a bit is set if over half the shingles set it."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    hash_of = xxhash.xxh64_digest
    if len(found) <= words:
        digests = [hash_of(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        starts = [0, *ends[:-words].tolist()]
        digests = [hash_of(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(digests), BLOCK):
        part = np.frombuffer(b"".join(digests[i : i + BLOCK]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(digests)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint) of each row's whole text; the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_at_a_time(batches):
            values = np.array([simhash(x.encode(), words) if x else 0 for x in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint long")


class Forest:
    """BK-trees over several shards at once: node 0 of each shard is its root."""

    def __init__(self, values: np.ndarray, shards: np.ndarray):
        n = len(values)
        self.values = values
        first, where = np.unique(shards, return_index=True)
        self.root_of = dict(zip(first.tolist(), where.tolist(), strict=True))
        at = where[np.searchsorted(first, shards)]
        left = np.flatnonzero(at != np.arange(n))
        keys, children = [], []
        while len(left):  # one level of all trees at a time
            key = at[left] * 65 + np.bitwise_count(values[left] ^ values[at[left]])
            fresh, index = np.unique(key, return_index=True)
            keys.append(fresh)
            children.append(left[index])
            at[left] = left[index][np.searchsorted(fresh, key)]
            left = left[at[left] != left]
        key, child = np.concatenate([*keys, np.empty(0, np.int64)]), np.concatenate([*children, np.empty(0, np.int64)])
        order = np.argsort(key)
        self.edges, self.children = key[order].astype(np.int64), child[order].astype(np.int64)

    def within(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) within the radius, level by level; only edges within the radius are followed."""
        query, node = np.arange(len(queries)), roots
        while len(query):
            apart = np.bitwise_count(queries[query] ^ self.values[node]).astype(np.int64)
            hit = apart <= radius
            yield query[hit], node[hit]
            # Children lie by parent and distance, so the edges within the radius are one stretch.
            lo = np.searchsorted(self.edges, node * 65 + np.maximum(apart - radius, 0))
            many = np.searchsorted(self.edges, node * 65 + np.minimum(apart + radius, 64), side="right") - lo
            ends = np.cumsum(many)
            node = self.children[np.arange(ends[-1]) + np.repeat(lo - ends + many, many)]
            query = np.repeat(query, many)


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the classes of the pairs; labels point at the smallest member."""
    while True:
        x, y = label[a], label[b]
        if not (apart := x != y).any():
            return label
        low, high = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


def _links(radius: int, step: int = 2048):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        shard, value, tree, query = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "fingerprint", "tree", "query"))
        value = value.view(np.uint64)
        distinct = np.unique(value)
        place = np.searchsorted(distinct, value)
        label = np.arange(len(distinct))
        inside, asked = np.flatnonzero(tree), np.flatnonzero(query)
        forest = Forest(value[inside], shard[inside])
        # A hash may leave one side of a pair of parts empty.
        asked = asked[np.isin(shard[asked], shard[inside])]
        roots = np.array([forest.root_of[x] for x in shard[asked].tolist()], np.int64)
        for i in range(0, len(asked), step):
            for which, node in forest.within(value[asked[i : i + step]], roots[i : i + step], radius):
                label = _merge(label, place[asked[which + i]], place[inside[node]])
        moved = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([pa.array(distinct[moved].view(np.int64)), pa.array(distinct[label[moved]].view(np.int64))], ["a", "b"])

    return run


def block_masks(radius: int) -> list[int]:
    """radius + 1 blocks that cover all bits: two fingerprints within the radius agree on one at least."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:], strict=False)]


def links(marks: DataFrame, radius: int = 2, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Edges (a, b) whose components are those of all distinct fingerprints within the radius."""
    signed = [x - (1 << 64) if x >> 63 else x for x in block_masks(radius)]
    parts = F.array(*(F.struct(F.lit(i).alias("i"), F.col("fingerprint").bitwiseAND(F.lit(x).cast("long")).alias("v")) for i, x in enumerate(signed)))
    routed = marks.select("fingerprint").distinct().select("fingerprint", F.explode(parts).alias("b")).select("fingerprint", "b.i", "b.v")
    routed = durable(routed, "routed")
    sizes = routed.groupBy("i", "v").agg(F.count("*").alias("members")).where("members > 1")
    sizes = durable(sizes.withColumn("parts", F.ceil(F.col("members") / tree_rows).cast("int")), "shards")
    total = sizes.agg(F.coalesce(F.sum(F.col("members") * F.col("parts")), F.lit(0))).first()[0]
    if not total:
        return marks.select(F.col("fingerprint").alias("a"), F.col("fingerprint").alias("b")).limit(0)
    held = spread_join(routed, sizes, ["i", "v"], "members", "fingerprint")
    # A shard of several parts: every pair of parts is a piece of work, the lower part its tree, the upper one its queries.
    held = held.withColumn("part", F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    held = held.select(F.xxhash64("i", "v", low, high).alias("shard"), "fingerprint", (F.col("part") == low).alias("tree"), (F.col("part") == high).alias("query"))
    return held.repartition(max(12, -(-total // TASK_ROWS)), "shard").mapInArrow(_links(radius), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge: alternating large-star and small-star steps until nothing moves.

    Each step takes minima by key with map-side combining, so a node of any degree costs one row per task.
    """
    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        near = both.join(low, "a")
        moved = near.where("b > a" if large else "b <= a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return ordered(moved if large else moved.unionByName(low.select("a", F.col("m").alias("b"))))

    pairs, last = durable(ordered(edges), "edges"), None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            break
        last, before = state, pairs
        pairs = durable(star(star(pairs, True), False), "edges")
        release(before)
    roots = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def grouped(marks: DataFrame, radius: int = 2, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(row, doc_id, fingerprint, component_id, first_row) of each of ``marks`` (row, doc_id, fingerprint); the smallest id, and its row, name the component."""
    nodes = durable(components(links(marks, radius, tree_rows)), "components")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    distinct = marks.groupBy("fingerprint").agg(first, F.count("*").alias("rows"))
    placed = distinct.join(small_side(nodes), distinct["fingerprint"] == nodes["node"], "left").select("fingerprint", "first", "rows", F.coalesce("root", "fingerprint").alias("root"))
    placed = durable(placed, "placed")
    linked = placed.groupBy("root").agg(F.min("first").alias("lowest"), F.count("*").alias("prints"))
    names = durable(spread_join(placed, linked, ["root"], "prints", "fingerprint").select("fingerprint", "rows", "lowest"), "names")
    return spread_join(marks, names, ["fingerprint"], "rows", "row").select("row", "doc_id", "fingerprint", F.col("lowest.doc_id").alias("component_id"), F.col("lowest.row").alias("first_row"))


def near_groups(docs: DataFrame, words: int = 3, radius: int = 2, tree_rows: int = TREE_ROWS) -> DataFrame:
    """(doc_id, fingerprint as long, component_id) of each row of ``docs`` (doc_id, text)."""
    marks = durable(fingerprints(docs, words).withColumn("row", F.monotonically_increasing_id()), "simhash")
    return grouped(marks, radius, tree_rows).select("doc_id", "fingerprint", "component_id")
