"""Geometries as vertex tables, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

KINDS = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection", "LinearRing")


def explode_vertices(regions: DataFrame) -> DataFrame:
    """(keys, kind, ring, part, sign, seq, x, y): one row per point, all columns but the geometry beside it."""
    keys = [c for c in regions.columns if c != "geom"]
    known = F.when(F.col("geom.kind").isin(*KINDS), F.col("geom.kind")).otherwise(F.raise_error(F.concat(F.lit("unsupported geometry kind: "), F.coalesce(F.col("geom.kind"), F.lit("null")))))
    rings = regions.select(*keys, known.alias("kind"), F.posexplode("geom.rings").alias("ring", "r"))
    return rings.select(*keys, "kind", "ring", "r.part", "r.sign", F.posexplode("r.pts").alias("seq", "p")).select(*keys, "kind", "ring", "part", "sign", "seq", "p.x", "p.y")


def rebuild(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """The inverse: points by ring and place, rings by number."""
    rings = vertices.groupBy(*keys, "kind", "ring", "part", "sign").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("pts"))
    ring = F.struct("ring", "part", "sign", F.transform("pts", lambda p: G.point_of(p["x"], p["y"])).alias("pts"))
    whole = rings.groupBy(*keys, "kind").agg(F.array_sort(F.collect_list(ring)).alias("rings"))
    bare = F.transform("rings", lambda r: F.struct(r["part"].alias("part"), r["sign"].alias("sign"), r["pts"].alias("pts")))
    return whole.select(*keys, F.struct(F.col("kind"), bare.alias("rings")).alias("geom"))


def statistics(regions: DataFrame) -> DataFrame:
    """Numbers of geometries, points, rings and polygons by kind."""
    polygons = F.size(F.array_distinct(F.transform(F.filter("geom.rings", lambda r: r["sign"] > 0), lambda r: r["part"])))
    return regions.groupBy(F.col("geom.kind").alias("kind")).agg(
        F.count("*").alias("n_geometries"), F.sum(G.n_points(F.col("geom"))).alias("n_points"),
        F.sum(F.size("geom.rings")).alias("n_rings"), F.sum(polygons).alias("n_polygons"),
    )


def total_bounds(regions: DataFrame) -> DataFrame:
    b = regions.select(*(["map_id"] if "map_id" in regions.columns else []), G.bounds(F.col("geom")).alias("b"))
    return b.groupBy(*(["map_id"] if "map_id" in regions.columns else [])).agg(F.min("b.xmin").alias("xmin"), F.min("b.ymin").alias("ymin"), F.max("b.xmax").alias("xmax"), F.max("b.ymax").alias("ymax"))


def displace(vertices: DataFrame, cells: DataFrame, grid, dt: float) -> DataFrame:
    """One forward step of every vertex along the field, bilinear between cell centres.

    The index goes toward zero and is held inside the grid, the weight is not, so points
    beyond the outer centres extrapolate.  Cells join by their integer place.
    """
    fx, fy = (F.col("x") - (grid.xmin + grid.dx / 2)) / grid.dx, (F.col("y") - (grid.ymin + grid.dy / 2)) / grid.dy
    held = vertices.withColumns({"_fx": fx, "_fy": fy})
    held = held.withColumns({"_ix": F.least(F.greatest(F.col("_fx").cast("int"), F.lit(0)), F.lit(grid.sx - 2)), "_iy": F.least(F.greatest(F.col("_fy").cast("int"), F.lit(0)), F.lit(grid.sy - 2))})
    # A cell's four corners as one row, so the vertices join once.
    at = lambda dx, dy: cells.select((F.col("ix") - dx).alias("_ix"), (F.col("iy") - dy).alias("_iy"), F.struct(F.lit(2 * dy + dx).alias("k"), "vx", "vy").alias("c"))
    corners = at(0, 0).unionByName(at(1, 0)).unionByName(at(0, 1)).unionByName(at(1, 1)).groupBy("_ix", "_iy").agg(F.array_sort(F.collect_list("c")).alias("c"))
    wx, wy = F.col("_fx") - F.col("_ix"), F.col("_fy") - F.col("_iy")
    mean = lambda n: (1 - wx) * (1 - wy) * F.col("c")[0][n] + wx * (1 - wy) * F.col("c")[1][n] + (1 - wx) * wy * F.col("c")[2][n] + wx * wy * F.col("c")[3][n]
    joined = held.join(corners, ["_ix", "_iy"])
    moved = {"x": F.col("x") + dt * mean("vx"), "y": F.col("y") + dt * mean("vy")}
    return joined.withColumns(moved).select(*vertices.columns)


def field_maxima(cells: DataFrame) -> DataFrame:
    """Largest speed, and largest component, of a field."""
    return cells.agg(F.max(F.hypot("vx", "vy")).alias("max_speed"), F.greatest(F.max(F.abs("vx")), F.max(F.abs("vy"))).alias("max_component"))


def interpolate_rings(a: DataFrame, b: DataFrame, t) -> DataFrame:
    """Rings of regions with equal vertex counts, a share ``t`` of the way from ``a`` to ``b``."""
    both = a.select("region_id", F.col("geom").alias("ga")).join(b.select("region_id", F.col("geom").alias("gb")), "region_id")
    rings = F.zip_with(F.col("ga.rings"), F.col("gb.rings"), lambda p, q: F.struct(p["part"].alias("part"), p["sign"].alias("sign"), G.lerp(p["pts"], q["pts"], F.lit(t)).alias("pts")))
    return both.select("region_id", F.struct(F.col("ga.kind").alias("kind"), rings.alias("rings")).alias("geom"))


def ring_table(regions: DataFrame) -> DataFrame:
    """(region_id, k, sign, pts): a region's rings in the order paths are drawn, each part's exterior before its holes."""
    ordered = F.array_sort("geom.rings", lambda p, q: F.when(p["part"] != q["part"], F.signum((p["part"] - q["part"]).cast("double")).cast("int")).otherwise(F.signum((q["sign"] - p["sign"]).cast("double")).cast("int")))
    return regions.select("region_id", F.posexplode(ordered).alias("k", "r")).select("region_id", "k", F.col("r.sign").cast("int").alias("sign"), F.col("r.pts").alias("pts"))


def geometries_of(source) -> DataFrame:
    """(region_id, geom) of a table of regions, or of the latest state of a result that has ``regions`` or ``cells``."""
    held = source if isinstance(source, DataFrame) else getattr(source, "regions", None) or getattr(source, "cells", None)
    if not isinstance(held, DataFrame) or "geom" not in held.columns:
        raise TypeError(f"no geometries in {type(source).__name__}")
    return held.select("region_id", "geom")
