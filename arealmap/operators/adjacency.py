"""Neighbouring regions: pairs, weights, components, and what is done per component."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..kernels.planar import boundary_within
from .measure import map_keys, per_map

#: Cells of the finest grid are this many mean region sides wide.
WIDTH = 2.0


def default_tolerance(regions: DataFrame) -> float:
    """A thousandth of the mean side of the regions."""
    return 0.001 * (regions.agg(F.avg(F.sqrt(G.area(F.col("geom"))))).first()[0] or 0.0)


def boxes_of(regions: DataFrame, tolerance: float | None = None) -> DataFrame:
    """(map_id, region_id, b, tol): bounds, and the tolerance given or a thousandth of the mean side of the map's own regions."""
    held = regions.select(*map_keys(regions), "region_id", G.bounds(F.col("geom")).alias("b"), F.sqrt(G.area(F.col("geom"))).alias("_side"))
    if tolerance is not None:
        return held.withColumn("tol", F.lit(float(tolerance))).drop("_side")
    return per_map(held, tol=0.001 * F.coalesce(F.avg("_side"), F.lit(0.0))).drop("_side")


def near_boxes(boxes: DataFrame) -> DataFrame:
    """(map_id, i, j, a, b, tol) of boxes (map_id, region_id, b, tol) of one map, i < j, that come within the tolerance of each other, with their bounds.

    A box goes by its size to one of several levels of its map's grid, each twice as coarse as the one below, and
    covers few cells there however large it is.  It is looked for in the cells of its own and all coarser
    levels, and a pair is kept in the cell of the lower left corner of the overlap alone, so none repeats.
    """
    keys = map_keys(boxes)
    held = boxes.select(*keys, "region_id", "b", "tol", F.greatest(F.col("b.xmax") - F.col("b.xmin"), F.col("b.ymax") - F.col("b.ymin")).alias("side"))
    held = per_map(held, _mean=F.avg("side"), _most=F.max("side")).withColumn("cell", F.greatest("_mean", "tol", F.lit(1e-12)) * WIDTH)
    held = held.withColumn("top", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("_most") / F.col("cell"), F.lit(1.0))))).cast("int"))
    level = F.greatest(F.lit(0), F.least(F.col("top"), F.ceil(F.log2(F.greatest(F.col("side"), F.col("cell")) / F.col("cell"))))).cast("int")
    half = F.col("tol") / 2
    grown = held.select(*keys, "region_id", "b", "tol", "cell", "top", level.alias("level"), *((F.col(f"b.{c}") + s * half).alias(n) for c, s, n in (("xmin", -1, "x0"), ("ymin", -1, "y0"), ("xmax", 1, "x1"), ("ymax", 1, "y1"))))
    width = lambda c: F.pow(F.lit(2.0), F.col(c)) * F.col("cell")
    put = lambda df, at: df.withColumn("kx", F.explode(F.sequence(F.floor(F.col("x0") / width(at)), F.floor(F.col("x1") / width(at))))).withColumn("ky", F.explode(F.sequence(F.floor(F.col("y0") / width(at)), F.floor(F.col("y1") / width(at)))))
    homes = put(grown.withColumn("at", F.col("level")), "at")
    asked = put(grown.withColumn("at", F.explode(F.sequence("level", "top"))), "at")
    other = homes.select(*keys, "at", "kx", "ky", *(F.col(c).alias(c + "_") for c in ("region_id", "b", "level", "x0", "y0", "x1", "y1")))
    # The finer box asks; of two of one level the one with the smaller id.
    met = asked.join(other, [*keys, "at", "kx", "ky"]).where("(level < level_ or region_id < region_id_) and x0 <= x1_ and x0_ <= x1 and y0 <= y1_ and y0_ <= y1")
    first = (F.floor(F.greatest("x0", "x0_") / width("at")) == F.col("kx")) & (F.floor(F.greatest("y0", "y0_") / width("at")) == F.col("ky"))
    turned = F.col("region_id") > F.col("region_id_")
    pick = lambda c: (F.when(turned, F.col(c + "_")).otherwise(F.col(c)), F.when(turned, F.col(c)).otherwise(F.col(c + "_")))
    (i, j), (a, b) = pick("region_id"), pick("b")
    return met.where(first).select(*keys, i.alias("i"), j.alias("j"), a.alias("a"), b.alias("b"), "tol")


def candidate_pairs(regions: DataFrame, tolerance: float | None = None) -> DataFrame:
    """(map_id, i, j, tol, gi, gj) of regions of one map, i < j, whose bounding boxes come within the tolerance; shapes join the pairs that are left."""
    keys = map_keys(regions)
    met = near_boxes(boxes_of(regions, tolerance)).select(*keys, "i", "j", "tol")
    shape = lambda k, g: regions.select(*keys, F.col("region_id").alias(k), F.col("geom").alias(g))
    return met.join(shape("i", "gi"), [*keys, "i"]).join(shape("j", "gj"), [*keys, "j"]).select(*keys, "i", "j", "tol", "gi", "gj")


def box_pairs(regions: DataFrame, tolerance: float | None = None, min_shared: float | None = None) -> DataFrame:
    """(map_id, i, j, shared_len) of axis-aligned boxes, in closed form: an edge of length L counts L + tolerance, a corner the tolerance."""
    met = near_boxes(boxes_of(regions, tolerance))
    run = lambda lo, hi: F.greatest(F.least(f"a.{hi}", f"b.{hi}") - F.greatest(f"a.{lo}", f"b.{lo}"), F.lit(0.0))
    held = met.select(*map_keys(regions), "i", "j", (F.greatest(run("xmin", "xmax"), run("ymin", "ymax")) + F.col("tol")).alias("shared_len"))
    return held.where(F.col("shared_len") >= (min_shared or 0.0))


def pairs(regions: DataFrame, tolerance: float | None = None, min_shared: float | None = None, min_tolerances: float = 0.0) -> DataFrame:
    """(map_id, i, j, shared_len) of any polygons of one map: the length of i's boundary that lies within half the tolerance of j.

    Pairs stay that share ``min_shared`` and ``min_tolerances`` times the tolerance at least.
    """

    def run(batches):
        for batch in batches:
            held = zip(*(batch.column(c).to_pylist() for c in ("gi", "gj", "tol")), strict=True)
            out = np.array([boundary_within(a, b, tol / 2) for a, b, tol in held], float)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.float64())], [*names, "shared_len"])

    keys = map_keys(regions)
    names = [*keys, "i", "j", "tol"]
    met = candidate_pairs(regions, tolerance).select(*keys, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "tol", "gi", "gj")
    shape = "".join(f"{k} {regions.schema[k].dataType.simpleString()}, " for k in keys) + "i long, j long, tol double, shared_len double"
    held = met.mapInArrow(run, shape).where((F.col("shared_len") > 0) & (F.col("shared_len") >= (min_shared or 0.0)))
    return held.where(F.col("shared_len") >= min_tolerances * F.col("tol")).drop("tol")


def both_ways(edges: DataFrame) -> DataFrame:
    way = lambda a, b: edges.select(*map_keys(edges), F.col(a).alias("src"), F.col(b).alias("dst"), "shared_len")
    return way("i", "j").unionByName(way("j", "i"))


MODES = ("binary", "weighted", "area_weighted")


def weights(regions: DataFrame, edges: DataFrame, mode: str = "binary") -> DataFrame:
    """(map_id, src, dst, weight) both ways: 1; the shared part of src's perimeter; or dst's part of the area of src's neighbours."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    both, keys = both_ways(edges), map_keys(regions)
    if mode == "binary":
        return both.select(*keys, "src", "dst", F.lit(1.0).alias("weight"))
    if mode == "weighted":
        lengths = regions.select(*keys, F.col("region_id").alias("src"), G.perimeter(F.col("geom")).alias("p"))
        return both.join(lengths, [*keys, "src"]).select(*keys, "src", "dst", (F.col("shared_len") / F.col("p")).alias("weight"))
    areas = regions.select(*keys, F.col("region_id").alias("dst"), G.area(F.col("geom")).alias("a"))
    held = both.join(areas, [*keys, "dst"])
    sums = held.groupBy(*keys, "src").agg(F.sum("a").alias("s"))
    return held.join(sums, [*keys, "src"]).select(*keys, "src", "dst", (F.col("a") / F.col("s")).alias("weight"))


def shared_dir(spark) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a local session without one gets its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if where is None:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not re.match(r"local($|\[)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        where = context._jsc.sc().getCheckpointDir().get()
    return where.rstrip("/")


def _kept(df: DataFrame) -> DataFrame:
    """``df`` written once to the folder that the cluster shares; lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/regions-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(map_id, region_id, component): the smallest id of its map reachable over (i, j).

    In rounds: each takes the least label among the neighbours, then that label's own label, so long
    chains halve; labels are minima, combined within tasks.  A round is written once, nothing else is.
    """
    keys = map_keys(nodes)
    both = _kept(edges.select(*keys, F.col("i").alias("a"), F.col("j").alias("b")).unionByName(edges.select(*keys, F.col("j").alias("a"), F.col("i").alias("b"))))
    label = nodes.select(*keys, "region_id", F.col("region_id").alias("component"))
    if not both.take(1):
        return label
    last = None
    while True:
        near = both.join(label.withColumnRenamed("region_id", "b"), [*keys, "b"]).groupBy(*keys, "a").agg(F.min("component").alias("m"))
        held = label.join(near.withColumnRenamed("a", "region_id"), [*keys, "region_id"], "left").select(*keys, "region_id", F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = held.select(*keys, F.col("region_id").alias("component"), F.col("component").alias("c"))
        label = _kept(held.join(jump, [*keys, "component"], "left").select(*keys, "region_id", F.least("component", F.coalesce("c", "component")).alias("component")))
        state = label.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if state == last:
            return label
        last = state


def prescale(regions: DataFrame, parts: DataFrame, value: str = "value", target_density: float | None = None) -> DataFrame:
    """Regions with every component scaled about its centroid to the area its values ask for; (scale) beside them."""
    keys = map_keys(regions)
    held = regions.join(parts, [*keys, "region_id"]).withColumn("_a", G.area(F.col("geom"))).withColumn("_c", G.centroid(F.col("geom")))
    held = per_map(held, _d=F.lit(target_density) if target_density else F.sum(value) / F.sum("_a"))
    sums = held.groupBy(*keys, "component").agg(F.sum(value).alias("v"), F.sum("_a").alias("a"), F.max("_d").alias("d"), (F.sum(F.col("_a") * F.col("_c.x")) / F.sum("_a")).alias("cx"), (F.sum(F.col("_a") * F.col("_c.y")) / F.sum("_a")).alias("cy"))
    factor = F.sqrt(F.col("v") / F.col("d") / F.col("a"))
    sums = sums.withColumn("scale", F.when((F.col("a") <= 0) | (F.col("v") <= 0) | (F.abs(factor - 1) < 1e-6), F.lit(1.0)).otherwise(factor))
    out = held.drop("_a", "_c", "_d").join(sums.select(*keys, "component", "scale", "cx", "cy"), [*keys, "component"])
    return out.withColumn("geom", G.scale_about(F.col("geom"), F.col("scale"), F.col("cx"), F.col("cy"))).drop("cx", "cy")
