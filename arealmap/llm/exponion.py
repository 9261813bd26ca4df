"""Exact k-means over integer vectors by Exponion search.

Every vector keeps its centroid, an upper bound on the distance to it and a lower
bound on the distance to any other.  A round moves the bounds by how far the
centroids went; a vector whose upper bound stays below its lower bound, or below
half the way from its centroid to the nearest other one, keeps its centroid
unseen.  For the others the upper bound is made exact, and if that doesn't settle
it they scan the centroids in a ball round their own one, of twice the upper
bound and the distance to the nearest other centroid: a stretch of the list of
centroids sorted by distance from it.  Both the nearest and the second nearest lie
there, and the radius is inclusive, so a tie is always seen and goes to the
smaller number.

Distances are squared in 64-bit integers and compared as such; bounds are doubles,
widened by more than their rounding errors, so they only ever cost a scan.  A
round reads the state once and writes it once.  Beside its vectors each task
writes one row for each centroid, the exact sum of its vectors, under a folder of
its own, so the driver gets as many numbers as k centroids have components.

Defined cases: vectors that are null, of another length, or hold a null, a NaN or
an infinity take no part; a component beyond 2^27 in size counts as that, so that
squared distances fit a long; fewer vectors than centroids make as many
centroids; equal vectors may start as several centroids, of which the smallest
number gets all and the others stay as they are; ties of hashes (repeated ids) go
to the smaller vector; a null id is hashed as an empty text; repeated rows count
each; an empty table gives an empty result; other columns are ignored, whatever
they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, few_at_a_time, release

#: Components beyond this size count as it.
LARGEST = 1 << 27
#: Bounds are widened by this share of themselves: far above the rounding of a root, far below a gap of distances.
SLACK = 1e-9
STATE = "kind string, vec_id long, v array<int>, cluster int, upper double, lower double, distance long, sums array<decimal(38,0)>, members long, inertia decimal(38,0)"


def vectors(table: DataFrame, size: int, scale: float) -> DataFrame:
    """(vec_id, v): floor(scale * x) of the vectors that take part."""
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int")
    good = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    held = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e")).where(F.size("e") == size)
    return held.where(F.forall("e", good)).select("vec_id", F.transform("e", whole).alias("v"))


def first_centroids(held: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in held.orderBy(mark, "v").limit(k).collect()], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    step = x - c
    return np.einsum("ij,ij->i", step, step)


class Search:
    """Centroids, their shifts since the last round, and for each the others by distance."""

    def __init__(self, centers: np.ndarray, before: np.ndarray | None):
        self.centers = centers
        k = len(centers)
        self.moved = np.zeros(k) if before is None else np.sqrt(squared(centers, before).astype(float)) * (1 + SLACK)
        # The farthest that any other centroid than one's own has moved.
        self.others = np.array([max((self.moved[j] for j in range(k) if j != i), default=0.0) for i in range(k)])
        gaps = np.array([np.sqrt(squared(centers, c).astype(float)) for c in centers])
        self.order = np.argsort(gaps, axis=1, kind="stable")
        for i in range(k):  # of centroids in one place each heads its own list
            self.order[i] = np.concatenate([[i], self.order[i][self.order[i] != i]])
        self.gaps = np.take_along_axis(gaps, self.order, axis=1)
        self.nearest = self.gaps[:, 1] if k > 1 else np.full(k, np.inf)
        self.scanned = 0

    def fresh(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid and both bounds of vectors without a state."""
        return self._scan(x, np.zeros(len(x), int), np.full(len(x), len(self.centers)))

    def again(self, x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid and both bounds, from those of the round before."""
        upper = (upper + self.moved[at]) * (1 + SLACK)
        lower = np.maximum(lower - self.others[at], 0.0) * (1 - SLACK)
        at, far = at.copy(), np.maximum(lower, self.nearest[at] / 2 * (1 - SLACK))
        open_ = np.flatnonzero(~(upper < far))
        upper[open_] = np.sqrt(squared(x[open_], self.centers[at[open_]]).astype(float)) * (1 + SLACK)
        open_ = open_[~(upper[open_] < far[open_])]
        if len(open_):
            own = at[open_]
            ball = (2 * upper[open_] + self.nearest[own]) * (1 + SLACK)
            reach = (self.gaps[own] <= ball[:, None]).sum(1)
            at[open_], upper[open_], lower[open_] = self._scan(x[open_], own, reach)
        return at, upper, lower

    def _scan(self, x: np.ndarray, own: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best and the second distance among the first ``reach`` centroids of each vector's list."""
        none = np.iinfo(np.int64).max
        best, second, at = np.full(len(x), none), np.full(len(x), none), np.full(len(x), len(self.centers))
        for place in range(int(reach.max(initial=0))):
            rows = np.flatnonzero(reach > place)
            j = self.order[own[rows], place]
            d = squared(x[rows], self.centers[j])
            self.scanned += len(rows)
            ahead = (d < best[rows]) | ((d == best[rows]) & (j < at[rows]))
            second[rows] = np.minimum(second[rows], np.where(ahead, best[rows], d))
            at[rows[ahead]], best[rows[ahead]] = j[ahead], d[ahead]
        bound = np.sqrt(second.astype(float)) * (1 - SLACK)
        return at, np.sqrt(best.astype(float)) * (1 + SLACK), np.where(second == none, np.inf, bound)


def _round(centers: np.ndarray, before: np.ndarray | None, last: bool):
    """A pass over the state: vectors with their new centroid, then the task's sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, (k, size) = Search(centers, before), centers.shape
        sums, members, inertia = np.zeros((k, size), object), np.zeros(k, np.int64), [0] * k
        names = ["kind", "vec_id", "v", "cluster", "upper", "lower", "distance", "sums", "members", "inertia"]
        shape = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.decimal128(38, 0)), pa.int64(), pa.decimal128(38, 0)]
        for batch in few_at_a_time(batches):
            n = batch.num_rows
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, size)
            if before is None:
                at, upper, lower = search.fresh(x)
            else:
                at, upper, lower = search.again(x, batch.column("cluster").to_numpy(), batch.column("upper").to_numpy(), batch.column("lower").to_numpy())
            distance = squared(x, centers[at]) if last else None
            for c in np.unique(at):
                of = at == c
                sums[c] += x[of].sum(0)
                members[c] += int(of.sum())
                inertia[c] += sum(distance[of].tolist()) if last else 0
            empty = [pa.nulls(n, t) for t in shape]
            empty[:6] = [pa.array(["v"] * n), batch.column("vec_id"), batch.column("v").cast(shape[2]), pa.array(at, pa.int32()), pa.array(upper), pa.array(lower)]
            if last:
                empty[6] = pa.array(distance, pa.int64())
            yield pa.RecordBatch.from_arrays(empty, names)
        if members.any():
            held = np.flatnonzero(members)
            rows = [pa.nulls(len(held), t) for t in shape]
            rows[0], rows[3] = pa.array(["s"] * len(held)), pa.array(held, pa.int32())
            rows[7:] = [pa.array([[int(a) for a in sums[c]] for c in held], shape[7]), pa.array(members[held]), pa.array([int(inertia[c]) for c in held], shape[9])]
            yield pa.RecordBatch.from_arrays(rows, names)

    return run


def _totals(state: DataFrame, k: int, size: int) -> tuple[dict[int, list[int]], dict[int, int], dict[int, int]]:
    """Exact sums, members and inertia of each centroid; k rows of as many numbers as a vector has."""
    parts = state.where("kind = 's'")
    sums = parts.select("cluster", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum("col").alias("s")).groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("s"))
    rest = parts.groupBy("cluster").agg(F.sum("members").alias("n"), F.sum("inertia").alias("i"))
    rows = sums.join(rest, "cluster").collect()
    return {r.cluster: [int(x.s) for x in r.s] for r in rows}, {r.cluster: r.n for r in rows}, {r.cluster: int(r.i) for r in rows}


def clusters(table: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, scale: float = 1024.0, seed: int = 3) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, center) of every vector that takes part.

    ``center`` is the final centroid; all numbers are exact integers, sums beyond a long count as the largest long.
    """
    if k < 1 or rounds < 0:
        raise ValueError("k is 1 at least, and rounds 0 at least")
    state = durable(vectors(table, size, scale), "vectors")
    centers, before = first_centroids(state, k, seed), None
    if not len(centers):
        return table.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, center array<long>")
    for i in range(rounds + 1):
        last = i == rounds
        read = state if before is None else state.where("kind = 'v'").select("vec_id", "v", "cluster", "upper", "lower")
        found = durable(read.mapInArrow(_round(centers, before, last), STATE), "assigned", by=["kind"])
        release(state)
        state = found
        sums, members, inertia = _totals(state, len(centers), size)
        if not last:
            # // rounds down, whatever the sign.
            before, centers = centers, np.array([[s // members[c] for s in sums[c]] if c in sums else centers[c].tolist() for c in range(len(centers))], np.int64)
    most, whole = 2**63 - 1, sum(inertia.values())
    told = [(c, min(inertia.get(c, 0), most), min(whole, most), [int(x) for x in row]) for c, row in enumerate(centers)]
    named = table.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, center array<long>")  # k rows
    return state.where("kind = 'v'").select("vec_id", "cluster", "distance").join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "center")


def sql(k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """``clusters`` in SQL: every round compares all vectors with all centroids."""
    distance = "CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    nearest = lambda i: f"a{i} AS MATERIALIZED (SELECT vec_id, v, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT row, vec_id, v, k, {distance} AS d FROM kept, c{i}) GROUP BY row, vec_id, v)"
    # Floor division of sums of either sign.
    moved = lambda i: f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (SELECT k, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY p) AS c
    FROM (SELECT k, p, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, unnest(range(1, {size + 1})) AS p FROM a{i}) GROUP BY k, p) GROUP BY k) m ON m.k = c{i}.k)"""  # noqa: E731
    steps = ",\n".join(f"{nearest(i)},\n{moved(i)}" for i in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS k, v AS c FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {k})),
{steps},
{nearest(rounds)}
SELECT vec_id, k AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(list_aggregate(c, 'string_agg', ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (k)
"""
