"""Any polygons on a grid: scanline spans, the cells they hold, and what an area gets of each region.

A region's edges name the grid rows they cross; the crossings of a row, in order,
open and close the region by turns, holes and parts alike.  Spans are the raster
in short, one row for each stretch of a grid row; only cells that a region holds
are ever made, and no region meets another.

A centre on a border lies in no region, as ``contains`` has it.  Of several regions
the last one counts.  Maps named by ``map_id`` stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .grids import Grid
from .measure import map_keys


def ring_edges(regions: DataFrame, *more: str) -> DataFrame:
    """(map_id, region_id, ..., part, sign, ring, seq, ax, ay, bx, by) of rings that bound areas, without edges of no length; each from its own row."""
    keep = [*map_keys(regions), "region_id", *more]
    rings = regions.select(*keep, F.posexplode("geom.rings").alias("ring", "r")).where("r.sign <> 0")
    rings = rings.select(*keep, "ring", "r.part", "r.sign", "r.pts")
    n = F.size("pts")
    ends = F.zip_with(F.slice("pts", 1, F.greatest(n - 1, F.lit(0))), F.slice("pts", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    out = rings.select(*keep, "part", "sign", "ring", F.posexplode(ends).alias("seq", "e"))
    out = out.select(*keep, "part", "sign", "ring", "seq", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))
    return out.where("ax <> bx or ay <> by")


def _first(at: Column, start: float, step: float) -> Column:
    """The first cell whose centre isn't below ``at``."""
    return F.ceil((at - start) / step - 0.5)


def crossings(regions: DataFrame, grid: Grid) -> DataFrame:
    """(map_id, region_id, iy, x): where edges meet the centre lines of grid rows, lower ends included and upper ones not."""
    edges = ring_edges(regions).where("ay <> by").withColumns({"low": F.least("ay", "by"), "high": F.greatest("ay", "by")})
    first, last = F.greatest(_first(F.col("low"), grid.ymin, grid.dy), F.lit(0)), F.least(_first(F.col("high"), grid.ymin, grid.dy), F.lit(grid.sy)) - 1
    held = edges.withColumns({"first": first, "last": last}).where("first <= last")
    rows = held.withColumn("iy", F.explode(F.sequence(F.col("first").cast("int"), F.col("last").cast("int"))))
    x = F.col("ax") + (grid.ymin + (F.col("iy") + 0.5) * grid.dy - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    return rows.select(*map_keys(regions), "region_id", "iy", x.alias("x"))


def spans(regions: DataFrame, grid: Grid) -> DataFrame:
    """(map_id, region_id, iy, x0, x1): the stretches of each row's centre line inside each region, without their ends."""
    keys = [*map_keys(regions), "region_id", "iy"]
    along = Window.partitionBy(*keys).orderBy("x")
    held = crossings(regions, grid).withColumns({"x1": F.lead("x").over(along), "k": F.row_number().over(along)})
    return held.where("k % 2 = 1 and x1 > x").select(*keys, F.col("x").alias("x0"), "x1")


def _touched(regions: DataFrame, grid: Grid) -> DataFrame:
    """(map_id, region_id, iy, ix) of centres that a horizontal edge, or the upper end of another, lies on; crossings tell all others."""
    keys = [*map_keys(regions), "region_id"]
    edges = ring_edges(regions).select(*keys, F.when(F.col("ay") == F.col("by"), F.least("ax", "bx")).when(F.col("ay") > F.col("by"), F.col("ax")).otherwise(F.col("bx")).alias("x0"),
                                       F.when(F.col("ay") == F.col("by"), F.greatest("ax", "bx")).when(F.col("ay") > F.col("by"), F.col("ax")).otherwise(F.col("bx")).alias("x1"), F.greatest("ay", "by").alias("y"))
    iy = _first(F.col("y"), grid.ymin, grid.dy)
    held = edges.withColumn("iy", iy).where((F.col("iy") >= 0) & (F.col("iy") < grid.sy) & (grid.ymin + (F.col("iy") + 0.5) * grid.dy == F.col("y")))
    return _cells(held, grid, keys, closed=True)


def _cells(held: DataFrame, grid: Grid, keys: list[str], closed: bool = False) -> DataFrame:
    """(keys, iy, ix) of centres between x0 and x1."""
    at = lambda i: grid.xmin + (i + 0.5) * grid.dx
    first = F.greatest(_first(F.col("x0"), grid.xmin, grid.dx), F.lit(0))
    last = F.least(_first(F.col("x1"), grid.xmin, grid.dx), F.lit(grid.sx - 1))
    out = held.withColumns({"first": first, "last": last}).where("first <= last").withColumn("ix", F.explode(F.sequence("first", "last")))
    inside = (at(F.col("ix")) >= F.col("x0")) & (at(F.col("ix")) <= F.col("x1")) if closed else (at(F.col("ix")) > F.col("x0")) & (at(F.col("ix")) < F.col("x1"))
    return out.where(inside).select(*keys, F.col("iy").cast("int").alias("iy"), F.col("ix").cast("int").alias("ix"))


def inside_cells(regions: DataFrame, grid: Grid) -> DataFrame:
    """(map_id, region_id, iy, ix): the cells whose centres each region holds."""
    keys = [*map_keys(regions), "region_id"]
    return _cells(spans(regions, grid), grid, keys).join(_touched(regions, grid), [*keys, "iy", "ix"], "left_anti")


def rasterize(regions: DataFrame, grid: Grid) -> DataFrame:
    """(map_id, iy, ix, region_id): of the regions that hold a cell's centre, the last."""
    return inside_cells(regions, grid).groupBy(*map_keys(regions), "iy", "ix").agg(F.max("region_id").alias("region_id"))


def map_cells(regions: DataFrame, grid: Grid) -> DataFrame:
    """(map_id, iy, ix, x, y): every cell of the grid, for each map."""
    if not map_keys(regions):
        return grid.cells(regions.sparkSession)
    rows = regions.select("map_id").distinct().withColumn("iy", F.explode(F.sequence(F.lit(0), F.lit(grid.sy - 1))))
    held = rows.repartition("map_id", "iy").withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(grid.sx - 1))))
    return held.select("map_id", "iy", "ix", (grid.xmin + (F.col("ix") + 0.5) * grid.dx).alias("x"), (grid.ymin + (F.col("iy") + 0.5) * grid.dy).alias("y"))


def density_field(regions: DataFrame, grid: Grid, value: str = "value", mean_density: float | None = None, zero_is_outside: bool = False) -> DataFrame:
    """(map_id, iy, ix, x, y, rho, geom_idx): a region's value by its area inside it, its map's mean outside (geom_idx -1).

    With ``zero_is_outside`` cells of density 0 count as outside too.  A region without area holds no cell.
    """
    keys = map_keys(regions)
    named = regions.select(*keys, "region_id", F.try_divide(F.col(value).cast("double"), G.area(F.col("geom"))).alias("density"))
    found = rasterize(regions, grid).join(named, [*keys, "region_id"])
    cells = map_cells(regions, grid).join(found, [*keys, "iy", "ix"], "left")
    if mean_density is None:
        means = regions.groupBy(*keys).agg((F.sum(value) / F.sum(G.area(F.col("geom")))).alias("mean"))
        cells = cells.join(means, keys) if keys else cells.join(F.broadcast(means))  # one row where maps have no names
    else:
        cells = cells.withColumn("mean", F.lit(float(mean_density)))
    rho = F.coalesce("density", "mean")
    rho = F.when(rho == 0, F.col("mean")).otherwise(rho) if zero_is_outside else rho
    return cells.select(*keys, "iy", "ix", "x", "y", rho.alias("rho"), F.coalesce("region_id", F.lit(-1)).cast("long").alias("geom_idx"))
