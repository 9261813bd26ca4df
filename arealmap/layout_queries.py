"""More registered queries: grids, modulators, flows, layouts, symbols, Voronoi cells and files, and the same in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fixtures as X
from .functions import geometry as G
from .kernels import circles, flow, raster, voronoi
from .operators import adjacency, fields, frames, grids, isohedral, measure, styling, tilings, vertices
from .plans import cartograms
from .queries import BOX, F3, PART_GRID, QUEEN, L, _overlaps, _part_grid, _series, SERIES, query, r, rounded
from .sources import files


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# Grids.


@query(f"""WITH {PART_GRID} SELECT 'x' AS axis, range AS i, round(-0.05 * w + range * ww / sx, 6) + 0.0 AS "at" FROM range(0, 33), pg WHERE range <= sx
  UNION ALL SELECT 'y', range, round(-0.05 * h + range * hh / sy, 6) + 0.0 FROM range(0, 33), pg WHERE range <= sy""")
def grid_edges(spark, sf_dir):
    return _part_grid(spark, sf_dir).edges(spark).select("axis", "i", r("at", 6).alias("at"))


@query("""SELECT * FROM (VALUES ('bounds', -1.0::DOUBLE, -0.4::DOUBLE, 11.0::DOUBLE, 4.4::DOUBLE, 24, 9, 0.5::DOUBLE, 0.5333::DOUBLE),
  ('size', -1.5, 0.75, 3.5, 3.25, 20, 10, 0.25, 0.25)) t(made_from, xmin, ymin, xmax, ymax, sx, sy, dx, dy)""")
def grid_spacings(spark, sf_dir):
    held = {"bounds": grids.Grid.from_bounds_and_spacing((0.0, 0.0, 10.0, 4.0), 0.5, 0.1), "size": grids.Grid.from_size_and_spacing((20, 10), 0.25, (1.0, 2.0))}
    rows = [(k, *g.bounds, g.sx, g.sy, g.dx, g.dy) for k, g in held.items()]
    found = spark.createDataFrame(rows, "made_from string, xmin double, ymin double, xmax double, ymax double, sx int, sy int, dx double, dy double")
    return found.select("made_from", *(r(c).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")), "sx", "sy", r("dx").alias("dx"), r("dy").alias("dy"))


@query(BOX + """, z AS (SELECT region_id, 2 * sqrt(value) / max(sqrt(value)) OVER () AS cell FROM nm) SELECT region_id, shape, symbol, adapted_to, round(cell * k * 0.95, 4) + 0.0 AS size FROM z, (VALUES ('square', 'circle', '', 0.5), ('square', 'square', '', 0.5), ('square', 'hexagon', '', 0.5),
  ('square', 'hexagon', 'hexagon', 1 / sqrt(3.0)), ('hexagon', 'circle', '', sqrt(3.0) / 2), ('hexagon', 'square', '', 0.75), ('hexagon', 'square', 'square', 1.0), ('hexagon', 'hexagon', '', 1.0)) t(shape, symbol, adapted_to, k)""")
def grid_symbol_sizes(spark, sf_dir):
    """Symbols that fit cells as large as each nation's orders."""
    cases = [("square", "circle", ""), ("square", "square", ""), ("square", "hexagon", ""), ("square", "hexagon", "hexagon"), ("hexagon", "circle", ""), ("hexagon", "square", ""), ("hexagon", "square", "square"), ("hexagon", "hexagon", "")]
    told = F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(("shape", "symbol", "adapted_to", "k"), (a, b, c, grids.symbol_size(a, 1.0, b, adapted_to=c or None)), strict=True))) for a, b, c in cases))
    cells = measure.symbol_sizes(X.nation_map(spark, sf_dir), "value", scale="sqrt", largest=2.0).select("region_id", "size", F.inline(told))
    return cells.select("region_id", "shape", "symbol", "adapted_to", r(F.col("size") * F.col("k")).alias("size"))


@query("""SELECT round(-0.5 + c.range * 0.6, 4) + 0.0 AS x, round(-0.5 + r.range * 1.2 / sqrt(3.0), 4) + 0.0 AS y, round(0.72 / sqrt(3.0), 4) + 0.0 AS area FROM range(0, 10) r, range(0, 11) c""")
def square_grid_for_hexagons(spark, sf_dir):
    held = grids.generate_grid(spark, X.nation_bounds(spark, sf_dir), "square", cell_size=0.6, symbol_shape="hexagon")
    return held.select(r("x").alias("x"), r("y").alias("y"), r(G.area(F.col("geom"))).alias("area"))


@query("""SELECT round(-0.5 + c.range * 0.8 + (r.range % 2) * 0.4, 4) + 0.0 AS x, round(-0.5 + r.range * 0.8, 4) + 0.0 AS y, 0.64::DOUBLE AS area FROM range(0, 9) r, range(0, 9) c WHERE c.range < CASE WHEN r.range % 2 = 0 THEN 9 ELSE 8 END""")
def hex_grid_for_squares(spark, sf_dir):
    held = grids.generate_grid(spark, X.nation_bounds(spark, sf_dir), "hexagon", cell_size=0.4, symbol_shape="square")
    return held.select(r("x").alias("x"), r("y").alias("y"), r(G.area(F.col("geom"))).alias("area"))


@query(L + ", b AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM vx) SELECT 'data' AS spec, x0 AS xmin, y0 AS ymin, x1 AS xmax, y1 AS ymax FROM b UNION ALL SELECT 'margin', x0 - 0.1 * (x1 - x0), y0 - 0.1 * (y1 - y0), x1 + 0.1 * (x1 - x0), y1 + 0.1 * (y1 - y0) FROM b UNION ALL SELECT 'given', 0.0, 1.0, 2.0, 3.0")
def view_bounds(spark, sf_dir):
    data = tuple(vertices.total_bounds(X.nation_lshape(spark, sf_dir)).first())
    rows = [(k, *map(float, grids.view_bounds(data, spec))) for k, spec in (("data", "data"), ("margin", 0.1), ("given", (0.0, 1.0, 2.0, 3.0)))]
    return spark.createDataFrame(rows, "spec string, xmin double, ymin double, xmax double, ymax double")


# Fields and modulators, on a grid whose cells are not square, with a block of cells inside.

M = """WITH c AS (SELECT CAST(range // 24 AS INT) AS iy, CAST(range % 24 AS INT) AS ix FROM range(0, 288)),
  g AS (SELECT *, (ix + 0.5) * 0.25 AS x, (iy + 0.5) / 3 AS y, ix BETWEEN 6 AND 17 AND iy BETWEEN 3 AND 8 AS inside FROM c),
  d AS (SELECT *, greatest(6 - ix, ix - 17, 0) AS ox, greatest(3 - iy, iy - 8, 0) AS oy FROM g),
  """ + X.order_field_sql("d", 24, 12) + """,
  f AS (SELECT *, CASE WHEN inside THEN least(ix - 5, 18 - ix, iy - 2, 9 - iy)::DOUBLE ELSE -sqrt(ox * ox + oy * oy) END AS depth FROM fd)"""
PX = "((0.25 + 1.0 / 3) / 2)"


def _block() -> grids.Grid:
    return grids.Grid.from_bounds((0.0, 0.0, 6.0, 4.0), (24, 12))


def _cells(spark, sf_dir) -> DataFrame:
    inside = F.col("ix").between(6, 17) & F.col("iy").between(3, 8)
    return X.order_field(_block().cells(spark), sf_dir, 24, 12).withColumn("geom_idx", F.when(inside, 0).otherwise(-1))


@query(M + f" SELECT iy, ix, round(vx * (0.2 + 0.8 * least(1, greatest(0, depth / (0.8 / {PX})))), 4) + 0.0 AS vx, round(vy * (0.2 + 0.8 * least(1, greatest(0, depth / (0.8 / {PX})))), 4) + 0.0 AS vy FROM f")
def boundary_decay(spark, sf_dir):
    return rounded(cartograms.modulate(_cells(spark, sf_dir), _block(), raster.BoundaryDecay(0.8, 0.2)), ["iy", "ix"], "vx", "vy")


@query(M + f""", s AS (SELECT *, lag(depth) OVER h AS l, lead(depth) OVER h AS n, lag(depth) OVER v AS u, lead(depth) OVER v AS o FROM f WINDOW h AS (PARTITION BY iy ORDER BY ix), v AS (PARTITION BY ix ORDER BY iy)),
  k AS (SELECT *, (coalesce(n, depth) - coalesce(l, depth)) / CASE WHEN n IS NULL OR l IS NULL THEN 1 ELSE 2 END AS gx, (coalesce(o, depth) - coalesce(u, depth)) / CASE WHEN o IS NULL OR u IS NULL THEN 1 ELSE 2 END AS gy FROM s),
  p AS (SELECT *, CASE WHEN gx * gx + gy * gy > 1e-20 THEN 0.9 * exp(-abs(depth) / (0.8 / {PX})) * (vx * gx + vy * gy) / (gx * gx + gy * gy) ELSE 0 END AS pull FROM k)
  SELECT iy, ix, round(vx - pull * gx, 4) + 0.0 AS vx, round(vy - pull * gy, 4) + 0.0 AS vy FROM p""")
def boundary_normal_decay(spark, sf_dir):
    return rounded(cartograms.modulate(_cells(spark, sf_dir), _block(), raster.BoundaryNormalDecay(0.8, 0.1)), ["iy", "ix"], "vx", "vy")


@query(M + """, t AS (SELECT f.*, i.vx AS held, least(1, greatest(0, (sqrt((f.ox * 0.25) ** 2 + (f.oy / 3.0) ** 2) - 0.5) / 0.6)) AS t FROM f JOIN f i ON i.ix = least(17, greatest(6, f.ix)) AND i.iy = least(8, greatest(3, f.iy)))
  SELECT iy, ix, round(CASE WHEN inside THEN vx ELSE (1 - t) * held + t * 1.2 END, 4) + 0.0 AS rho FROM t""")
def border_extension(spark, sf_dir):
    """Cells outside take the density of the nearest cell inside, and fade into the target."""
    held = _cells(spark, sf_dir).select("iy", "ix", "geom_idx", F.col("vx").alias("rho"), F.lit(1.2).alias("target"))
    return rounded(cartograms.modulate(held, _block(), raster.BorderExtension(0.5, 0.6)), ["iy", "ix"], "rho")


#: Smoothing by hand: a Gaussian along each axis, cut at four widths, the field mirrored about its edges.
GAUSS = """, wx AS (SELECT range AS k, exp(-0.5 * (range / 1.2) ** 2) AS w FROM range(-5, 6)), wy AS (SELECT range AS k, exp(-0.5 * (range / 0.9) ** 2) AS w FROM range(-4, 5)),
  mx AS (SELECT c.range AS ix, w / (SELECT sum(w) FROM wx) AS w, CASE WHEN c.range + k < 0 THEN -1 - c.range - k WHEN c.range + k > 23 THEN 47 - c.range - k ELSE c.range + k END AS jx FROM range(0, 24) c, wx),
  my AS (SELECT c.range AS iy, w / (SELECT sum(w) FROM wy) AS w, CASE WHEN c.range + k < 0 THEN -1 - c.range - k WHEN c.range + k > 11 THEN 23 - c.range - k ELSE c.range + k END AS jy FROM range(0, 12) c, wy),
  b AS (SELECT my.iy, mx.ix, sum(mx.w * my.w * f.vx) AS px, sum(mx.w * my.w * f.vy) AS py FROM mx, my, f WHERE f.ix = mx.jx AND f.iy = my.jy GROUP BY 1, 2)"""


@query(M + GAUSS + " SELECT CAST(iy AS INT) AS iy, CAST(ix AS INT) AS ix, round(px * (SELECT avg(vx) FROM f) / (SELECT avg(px) FROM b), 4) + 0.0 AS rho FROM b")
def density_smooth(spark, sf_dir):
    """Orders' totals smoothed; their mean stays."""
    held = _cells(spark, sf_dir).select("iy", "ix", "geom_idx", F.col("vx").alias("rho"), F.lit(1.0).alias("target"))
    return cartograms.modulate(held, _block(), raster.DensitySmooth(0.3)).select("iy", "ix", r("rho").alias("rho"))


@query(M + GAUSS + " SELECT CAST(iy AS INT) AS iy, CAST(ix AS INT) AS ix, round(px, 4) + 0.0 AS vx, round(py, 4) + 0.0 AS vy FROM b")
def velocity_smooth(spark, sf_dir):
    held = cartograms.modulate(_cells(spark, sf_dir), _block(), raster.Pipeline(raster.VelocitySmooth(0.3)))
    return rounded(held, ["iy", "ix"], "vx", "vy")


#: The levelling flow by a sum over all waves: rho' has the amplitude (a, b) along wave (p, q); its potential is that over the wave number squared.
WAVES = """, n AS (SELECT iy, ix, vx / (SELECT avg(vx) FROM f) - 1 AS z FROM f), wv AS (SELECT p.range AS p, q.range AS q, 2 * pi() * p.range / 6 AS kx, 2 * pi() * CASE WHEN q.range > 6 THEN q.range - 12 ELSE q.range END / 4 AS ky FROM range(-12, 12) p, range(0, 12) q WHERE NOT (p.range = 0 AND q.range = 0)),
  am AS (SELECT p, q, any_value(kx) AS kx, any_value(ky) AS ky, sum(z * cos(2 * pi() * (p * ix / 24.0 + q * iy / 12.0))) / 288 AS a, sum(z * sin(2 * pi() * (p * ix / 24.0 + q * iy / 12.0))) / 288 AS b FROM n, wv GROUP BY p, q),
  vl AS (SELECT iy, ix, -sum(CASE WHEN p = -12 THEN 0 ELSE kx END / (kx * kx / 1.5 + ky * ky) * (b * cos(t) - a * sin(t))) AS ux, -sum(CASE WHEN q = 6 THEN CASE WHEN p IN (0, -12) THEN 0 WHEN p > 0 THEN -ky ELSE ky END ELSE ky END / (kx * kx / 1.5 + ky * ky) * (b * cos(t) - a * sin(t))) AS uy
    FROM (SELECT n.iy, n.ix, am.*, 2 * pi() * (p * ix / 24.0 + q * iy / 12.0) AS t FROM n, am) GROUP BY iy, ix)"""


@query(M + WAVES + " SELECT iy, ix, round(ux, 4) + 0.0 AS vx, round(uy, 4) + 0.0 AS vy FROM vl")
def velocity_of_orders(spark, sf_dir):
    """The flow that levels the orders' totals, stretched along x by the anisotropy, against a sum over all waves; those of two cells' length along one axis alone carry none."""
    held = _cells(spark, sf_dir).withColumn("rho", F.col("vx"))
    return rounded(cartograms.velocity_field(held, _block(), 1.5, 1.0), ["iy", "ix"], "vx", "vy")


@query(M + f", am AS (SELECT avg(l_discount) * 10 AS a FROM lineitem) SELECT iy, ix, round(1.5 * a * sin(2 * pi() * 3 * ix / 24) / pi(), 6) + 0.0 AS vx, 0.0::DOUBLE AS vy FROM g, am")
def velocity_of_a_wave(spark, sf_dir):
    """A density that is one wave, as high as discounts are on average, has a velocity in closed form, stretched along x by the anisotropy."""
    height = X.table(spark, sf_dir, "lineitem").agg((F.avg("l_discount") * 10).alias("a"))
    held = _block().cells(spark).join(F.broadcast(height)).withColumn("rho", 2 + 2 * F.col("a") * F.cos(2 * 3.141592653589793 * 3 * F.col("ix") / 24))  # one row
    return cartograms.velocity_field(held, _block(), 1.5, 1.0).select("iy", "ix", r("vx", 6).alias("vx"), r("vy", 6).alias("vy"))


@query(M + ", a AS (SELECT * FROM f WHERE ix % 4 = 0 AND iy % 4 = 0) SELECT iy, ix, round(vx * 0.9 * 4 * 0.25 / max(sqrt(vx * vx + vy * vy)) OVER (), 4) + 0.0 AS ux, round(vy * 0.9 * 4 * 0.25 / max(sqrt(vx * vx + vy * vy)) OVER (), 4) + 0.0 AS uy FROM a")
def velocity_arrows(spark, sf_dir):
    return rounded(fields.arrows(_cells(spark, sf_dir), 0.25, 4, 0.9), ["iy", "ix"], "ux", "uy")


ZERO = BOX + """, z AS (SELECT * REPLACE (CASE WHEN region_id % 4 = 0 THEN 0.0 ELSE value END AS value) FROM nm), gc AS (SELECT CAST(range // 20 AS INT) AS iy, CAST(range % 20 AS INT) AS ix, -1.25 + (range % 20 + 0.5) * 0.375 AS x, -1.25 + (range // 20 + 0.5) * 0.375 AS y FROM range(0, 400))"""


@query(ZERO + " SELECT iy, ix, round(coalesce(nullif(value, 0), (SELECT sum(value) / 25 FROM z)), 4) + 0.0 AS rho FROM gc LEFT JOIN z ON x >= x0 AND x < x0 + 1 AND y >= y0 AND y < y0 + 1")
def density_zero_outside(spark, sf_dir):
    regions = X.nation_map(spark, sf_dir).withColumn("value", F.when(F.col("region_id") % 4 == 0, 0.0).otherwise(F.col("value")))
    return rounded(fields.density_field(regions, grids.Grid.from_bounds((0.0, 0.0, 5.0, 5.0), 20, 0.25), zero_is_outside=True), ["iy", "ix"], "rho")


@query(L + """ SELECT region_id, source, target, round(area * factor * 1000, 4) + 0.0 AS area FROM ar, (VALUES ('m2', 'km2', 0.000001::DOUBLE), ('km2', 'm2', 1000000.0), ('ha', 'm2', 10000.0), ('sqmi', 'km2', 2.589988110336), ('sqft', 'm2', 0.09290304)) t(source, target, factor)""")
def area_scales(spark, sf_dir):
    """Areas of regions in other units."""
    units, area = (("m2", "km2"), ("km2", "m2"), ("ha", "m2"), ("sqmi", "km2"), ("sqft", "m2")), G.area(F.col("geom"))
    regions = X.nation_lshape(spark, sf_dir)
    return _union([regions.select("region_id", F.lit(a).alias("source"), F.lit(b).alias("target"), r(area * measure.area_scale(a, b) * 1000).alias("area")) for a, b in units])


# Flows: where values are even nothing may move, and everything a result tells is known.


def _even(spark, sf_dir) -> DataFrame:
    return X.nation_map(spark, sf_dir).withColumn("value", F.lit(2.0))


STILL = flow.Options(grid_size=64, snapshot_every=1, save_internals=True)


@query(BOX + " SELECT CAST(region_id AS BIGINT) AS region_id, 1 AS iteration, 'converged' AS status, 1.0::DOUBLE AS area, x0 + 0.5 AS cx, y0 + 0.5 AS cy, 0.0::DOUBLE AS error_pct, 2.0::DOUBLE AS density FROM nm")
def flow_of_an_even_map(spark, sf_dir):
    found = cartograms.flow(_even(spark, sf_dir), options=STILL)
    shapes = found.regions.withColumn("c", G.centroid(F.col("geom")))
    held = shapes.join(found.density(_even(spark, sf_dir)).select("region_id", "iteration", "density"), ["region_id", "iteration"]).join(found.convergence.select("iteration", "status"), "iteration")
    return held.select("region_id", "iteration", "status", r(G.area(F.col("geom"))).alias("area"), r("c.x").alias("cx"), r("c.y").alias("cy"), r("_morph_error_pct").alias("error_pct"), r("density").alias("density"))


@query(f"WITH {X.POINTS} SELECT CAST(point_id AS BIGINT) AS point_id, 1 AS iteration, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, TRUE AS ended_there FROM pt")
def flow_points(spark, sf_dir):
    """Points carried along an even map stay, at every snapshot and in the end."""
    found = cartograms.flow(_even(spark, sf_dir), options=STILL, points=X.user_points(spark, sf_dir))
    ends = found.points.select("point_id", F.col("x").alias("ex"), F.col("y").alias("ey"))
    return found.point_snapshots.join(ends, "point_id").select("point_id", "iteration", r("x").alias("x"), r("y").alias("y"), ((F.col("x") == F.col("ex")) & (F.col("y") == F.col("ey"))).alias("ended_there"))


@query("""WITH c AS (SELECT range // 64 AS iy, range % 64 AS ix, -2.5 + (range % 64 + 0.5) * 10 / 64 AS x, -2.5 + (range // 64 + 0.5) * 10 / 64 AS y FROM range(0, 4096))
  SELECT CAST(iy AS INT) AS iy, CAST(ix AS INT) AS ix, 2.0::DOUBLE AS rho, 0.0::DOUBLE AS vx, 0.0::DOUBLE AS vy, CASE WHEN x BETWEEN 0 AND 5 AND y BETWEEN 0 AND 5 THEN CAST(floor(y) * 5 + floor(x) AS INT) ELSE -1 END AS geom_idx FROM c""")
def flow_fields(spark, sf_dir):
    """Density, velocity and regions of every cell at the snapshot."""
    return cartograms.flow(_even(spark, sf_dir), options=STILL).fields.select("iy", "ix", r("rho").alias("rho"), r("vx").alias("vx"), r("vy").alias("vy"), "geom_idx")


@query("SELECT * FROM (VALUES ('areas'), ('density'), ('displacement'), ('total'), ('velocity')) t(phase)")
def flow_timings(spark, sf_dir):
    return cartograms.flow(_even(spark, sf_dir), options=STILL).timings.where("seconds >= 0").select("phase")


@query(BOX + " SELECT CAST(region_id AS BIGINT) AS region_id, TRUE AS within, TRUE AS right_way FROM nm")
def flow_by_region(spark, sf_dir):
    """Every region ends within a tenth of its target, and those that must grow have grown."""
    found = cartograms.flow(X.nation_map(spark, sf_dir), options=flow.Options(grid_size=128)).regions
    wanted = measure.original_state(X.nation_map(spark, sf_dir)).select(F.col("region_id").cast("long").alias("region_id"), "target_area")
    area = G.area(F.col("geom"))
    near = F.abs(area / F.col("target_area") - 1) < 0.101
    return found.join(wanted, "region_id").select("region_id", near.alias("within"), ((F.signum(area - 1) == F.signum(F.col("target_area") - 1)) | near).alias("right_way"))


@query(BOX + " SELECT CAST(region_id AS BIGINT) AS region_id, 1 AS runs, 1.0::DOUBLE AS area, 0.0::DOUBLE AS error_pct, 0.5::DOUBLE AS density FROM nm")
def workflow_states(spark, sf_dir):
    """Three runs, the last two taken back; the table joins the source's columns."""
    work = cartograms.Workflow(_even(spark, sf_dir), scale=4.0)
    for _ in range(3):
        work.morph(STILL)
    work.pop(2)
    runs = work.convergence().select("run_id").distinct().count()
    return work.table().select("region_id", F.lit(runs).alias("runs"), r("area").alias("area"), r("_morph_error_pct").alias("error_pct"), r("_morph_density").alias("density"))


@query("SELECT 'converged' AS status, TRUE AS within, 0 AS left_after_reset")
def workflow_multiresolution(spark, sf_dir):
    work = cartograms.Workflow(X.nation_map(spark, sf_dir))
    work.morph_multiresolution(64, 2)
    last = work.convergence().orderBy(F.desc("run_id"), F.desc("iteration")).limit(1).select("status", (F.col("max_error_pct") < 10).alias("within"))
    work.reset()
    return last.withColumn("left_after_reset", F.lit(len(work.results)))


STATE_ROWS = BOX + """, e AS (SELECT grp, abs(log2(1.0 / (value / (sum(value) OVER () / 25)))) AS le FROM nm)"""


@query(STATE_ROWS + """, s AS (SELECT grp, (pow(2.0, max(le)) - 1) * 100 AS p FROM e GROUP BY 1)
  SELECT grp, concat_ws('; ', CASE WHEN p > 10 THEN 'max error above 10%' END, CASE WHEN grp % 2 = 1 THEN 'stalled' END, 'invalid geometries') AS warnings, FALSE AS is_valid FROM s""")
def quality_report(spark, sf_dir):
    held = measure.error_summary(measure.original_state(X.nation_map(spark, sf_dir)), ["grp"]).withColumn("status", F.when(F.col("grp") % 2 == 1, "stalled").otherwise("converged"))
    broken = X.nation_map(spark, sf_dir).where("region_id < 2").select("region_id")
    return measure.validate(held, broken).select("grp", F.array_join("warnings", "; ").alias("warnings"), "is_valid")


@query("SELECT * FROM (VALUES ('fast', 128, 30, 0.3::DOUBLE, 0.15::DOUBLE, 0.25::DOUBLE), ('balanced', 256, 100, 0.2, 0.05, 0.1), ('high_quality', 512, 300, 0.1, 0.01, 0.03)) t(preset, grid_size, n_iter, dt, mean_tol, max_tol)")
def flow_presets(spark, sf_dir):
    rows = [(k, o.grid_size, o.n_iter, o.dt, o.mean_tol, o.max_tol) for k, o in flow.PRESETS.items()]
    return spark.createDataFrame(rows, "preset string, grid_size int, n_iter int, dt double, mean_tol double, max_tol double")


@query("SELECT what, TRUE AS refused FROM (VALUES ('dt'), ('mean_tol'), ('n_iter'), ('recompute_every'), ('area_scale'), ('spacing'), ('compactness'), ('force_mode'), ('resolution'), ('repair_every'), ('exact')) t(what)")
def refused_options(spark, sf_dir):
    """Options that make no sense are refused when they are made."""
    cases = [(flow.Options, {"dt": 0.0}), (flow.Options, {"mean_tol": -1.0}), (flow.Options, {"n_iter": 0}), (flow.Options, {"recompute_every": 0}), (flow.Options, {"area_scale": 0.0}), (circles.PhysicsOptions, {"spacing": -1.0}), (circles.PackingOptions, {"compactness": 2.0}), (circles.PackingOptions, {"force_mode": "none"}), (voronoi.Options, {"resolution": 0}), (voronoi.Options, {"repair_every": 0}), (voronoi.Options, {"exact": True, "geodesic": True})]

    def refused(make, told) -> bool:
        try:
            make(**told)
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(next(iter(told)), refused(make, told)) for make, told in cases], "what string, refused boolean")


# Partitions.


def _flagged(spark, sf_dir) -> DataFrame:
    return X.nation_map(spark, sf_dir).select("region_id", "geom").join(X.nation_flags(spark, sf_dir), "region_id")


@query(F3 + " SELECT region_id, round(c1 / rs, 4) + 0.0 AS a_c1, round(c2 / rs, 4) + 0.0 AS a_c2, round(c3 / rs, 4) + 0.0 AS a_c3 FROM s")
def partition_fixed_tree(spark, sf_dir):
    """A treemap whose tree another list of shares fixes."""
    held = cartograms.partition(_flagged(spark, sf_dir), ["c1", "c2", "c3"], "split", "row", strategy="treemap", reference=[1.0, 1.0, 5.0])
    return held.select("region_id", *(r(F.coalesce(G.area(F.col(f"geometry_{c}")), F.lit(0.0))).alias(f"a_{c}") for c in ("c1", "c2", "c3")))


@query(F3 + """ SELECT region_id, u.category, round(u.v / rs, 4) + 0.0 AS area, round(u.v / rs, 4) + 0.0 AS color_value, FALSE AS is_complement
  FROM s, (SELECT unnest(['c1', 'c2', 'c3']) AS category) k, LATERAL (SELECT k.category, CASE k.category WHEN 'c1' THEN c1 WHEN 'c2' THEN c2 ELSE c3 END AS v) u WHERE u.v > 0""")
def partitions_as_rows(spark, sf_dir):
    held = cartograms.partition(_flagged(spark, sf_dir), ["c1", "c2", "c3"], "split", "row")
    return measure.long_partitions(held, ["c1", "c2", "c3"]).select("region_id", "category", r(G.area(F.col("geom"))).alias("area"), r("color_value").alias("color_value"), "is_complement")


# Layouts and symbols.

SIZES = BOX + ", z AS (SELECT region_id, x0 + 0.5 AS x, y0 + 0.5 AS y, sqrt(value) / max(sqrt(value)) OVER () * sqrt(1.0 / pi()) AS size FROM nm)"


@query(SIZES + " SELECT CAST(region_id AS BIGINT) AS region_id, x, y, round(size, 4) + 0.0 AS size, round(size / avg(size) OVER (), 4) + 0.0 AS scale FROM z")
def centroid_layout(spark, sf_dir):
    held = cartograms.layout(X.nation_map(spark, sf_dir), "value", "centroid")
    return held.select("region_id", "x", "y", r("size").alias("size"), r("scale").alias("scale"))


@query("SELECT CAST(0 AS BIGINT) AS overlaps, CAST(25 AS BIGINT) AS symbols")
def centroid_layout_without_overlaps(spark, sf_dir):
    regions = X.nation_map(spark, sf_dir).withColumn("geom", G.map_points(F.col("geom"), lambda p: G.point_of(p["x"] * 0.9, p["y"])))
    return _overlaps(cartograms.layout(regions, "value", "centroid", options={"remove_overlap": True}))


@query("SELECT 'converged' AS status, CAST(0 AS BIGINT) AS overlaps, TRUE AS counted, TRUE AS moved")
def layout_history(spark, sf_dir):
    """A packing's own numbers: a row for each step, and places that have moved."""
    found = cartograms.layout_result(X.nation_map(spark, sf_dir), "value", "packing")
    steps = found.history.agg(F.count("*").alias("n"), F.max("iteration").alias("last"))
    moved = found.places.agg((F.max(F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0"))) > 0.01).alias("moved"))
    return found.status.join(steps).join(moved).join(_overlaps(found.places).select("overlaps")).select("status", "overlaps", ((F.col("n") == F.col("iterations")) & (F.col("last") == F.col("n"))).alias("counted"), "moved")


@query("SELECT * FROM (VALUES ('demers', 'square', CAST(25 AS BIGINT), CAST(25 AS BIGINT)), ('dorling', 'circle', 25, 25), ('tile_map', 'hexagon', 25, 25), ('fast', 'circle', 25, 25)) t(preset, symbol, symbols, places)")
def symbol_presets(spark, sf_dir):
    parts = []
    for name in ("demers", "dorling", "tile_map", "fast"):
        made = cartograms.symbol_cartogram(X.nation_map(spark, sf_dir), "value", name)
        parts.append(made.symbols.groupBy("symbol").agg(F.count("*").alias("symbols"), F.countDistinct(r("_symbol_x", 3), r("_symbol_y", 3)).alias("places")).select(F.lit(name).alias("preset"), "symbol", "symbols", "places"))
    return _union(parts)


@query(SIZES + """ SELECT CAST(region_id AS BIGINT) AS region_id, name, round(CASE WHEN region_id % 4 = 1 THEN 2.0 ELSE 4.0 END * (size * sqrt(pi() / 4)) ** 2, 3) + 0.0 AS area, 0.0::DOUBLE AS dx, 0.0::DOUBLE AS dy FROM z JOIN nm USING (region_id)""")
def symbol_cartogram_restyled(spark, sf_dir):
    """Squares at the centres, then every fourth one a diamond; the layout stays, and the source's columns come along."""
    made = cartograms.symbol_cartogram(X.nation_map(spark, sf_dir), "value", layout="centroid", symbol="square", canonical="square")
    rules = made.places.where("region_id % 4 = 1").select("region_id", F.lit(0).alias("seq"), F.lit("diamond").alias("symbol"), F.lit(None).cast("double").alias("scale"), F.lit(None).cast("double").alias("rotation"), F.lit(None).cast("boolean").alias("reflection"), F.lit(None).cast("map<string,string>").alias("params"))
    again = made.restyle(rules, "square", canonical="square")
    held = again.table().join(again.displacements(), "region_id")
    return held.select("region_id", "name", r(G.area(F.col("geom")), 3).alias("area"), r("dx").alias("dx"), r("dy").alias("dy"))


@query(BOX + " SELECT region_id, round(region_id * 0.1 + 1, 4) + 0.0 AS x, round(2.0 - region_id, 4) + 0.0 AS y, round(0.3 + 0.01 * region_id, 4) + 0.0 AS rotation, round(1.5 * (1 + region_id), 4) + 0.0 AS scale, region_id % 2 = 1 AS reflection FROM nm")
def transforms_composed(spark, sf_dir):
    n = F.col("region_id")
    one = {"x": n * 0.1, "y": F.lit(2.0), "rotation": F.lit(0.3), "scale": F.lit(1.5), "reflection": F.lit(True)}
    two = {"x": F.lit(1.0), "y": -n.cast("double"), "rotation": 0.01 * n, "scale": (1 + n).cast("double"), "reflection": n % 2 == 0}
    held = styling.compose(one, two)
    return X.nation_values(spark, sf_dir).select("region_id", *(r(held[c]).alias(c) for c in ("x", "y", "rotation", "scale")), held["reflection"].alias("reflection"))


NAMES = ("circle", "square", "hexagon", "hexagon_flat", "triangle", "triangle_down", "diamond", "pentagon", "pentagon_down", "star")


@query(SIZES + """, sy(k, symbol, area, outer_r, inner_r) AS (VALUES (0, 'circle', 4 * sin(pi() / 16), 0.5, 0.5 * cos(pi() / 32)), (1, 'square', 1.0, sqrt(0.5), 0.5),
  (2, 'hexagon', 0.375 * sqrt(3.0), 0.5, sqrt(3.0) / 4), (3, 'hexagon_flat', 0.375 * sqrt(3.0), 0.5, sqrt(3.0) / 4), (4, 'triangle', 0.1875 * sqrt(3.0), 0.5, 0.25), (5, 'triangle_down', 0.1875 * sqrt(3.0), 0.5, 0.25), (6, 'diamond', 0.5, 0.5, sqrt(0.125)),
  (7, 'pentagon', 0.625 * sin(radians(72)), 0.5, 0.5 * cos(radians(36))), (8, 'pentagon_down', 0.625 * sin(radians(72)), 0.5, 0.5 * cos(radians(36))), (9, 'star', 0.5 * sin(radians(36)), 0.5, 0.2))
  SELECT region_id, symbol, round(area * size * size, 4) + 0.0 AS area, round(outer_r * size, 4) + 0.0 AS bounding_radius, round(inner_r * size, 4) + 0.0 AS inscribed_radius FROM z, sy""")
def symbol_shapes(spark, sf_dir):
    """Every symbol at every nation, as large as its orders, turned and mirrored: areas and radii follow the size."""
    places = measure.symbol_sizes(X.nation_map(spark, sf_dir), "value", scale="sqrt", largest=0.5641895835477563).select("region_id", "size")
    parts = []
    for k, name in enumerate(NAMES):
        pts = G.place(G.symbol_points(name), F.col("region_id").cast("double"), F.lit(-1.0), F.col("size"), 0.1 * k, k % 2 == 1)
        parts.append(places.select("region_id", F.lit(name).alias("symbol"), r(G.ring_area(pts)).alias("area"), r(F.col("size") * G.bounding_radius(name)).alias("bounding_radius"), r(F.col("size") * G.inscribed_radius(name)).alias("inscribed_radius")))
    return _union(parts)


@query(SIZES + """ SELECT region_id, canonical, styled, mode, round(v * size, 4) + 0.0 AS size FROM z, (VALUES ('circle', 'square', 'inside', sqrt(0.5)), ('square', 'circle', 'inside', 1.0), ('square', 'diamond', 'inside', 1.0), ('square', 'diamond', 'fill', sqrt(2.0)),
  ('circle', 'square', 'area', sqrt(pi() / 4)), ('square', 'diamond', 'area', sqrt(2.0)), ('hexagon', 'hexagon', 'inside', 1.0), ('hexagon', 'hexagon_flat', 'inside', sqrt(3.0) / 2), ('hexagon', 'hexagon_flat', 'fill', 1.0)) t(canonical, styled, mode, v)""")
def symbol_fits(spark, sf_dir):
    """Each nation's symbol fitted into others' shapes."""
    cases = [("circle", "square", "inside"), ("square", "circle", "inside"), ("square", "diamond", "inside"), ("square", "diamond", "fill"), ("circle", "square", "area"), ("square", "diamond", "area"), ("hexagon", "hexagon", "inside"), ("hexagon", "hexagon_flat", "inside"), ("hexagon", "hexagon_flat", "fill")]
    told = F.array(*(F.struct(F.lit(a).alias("canonical"), F.lit(b).alias("styled"), F.lit(m).alias("mode"), F.lit(float(styling.fit_scale(a, b, m))).alias("scale")) for a, b, m in cases))
    places = measure.symbol_sizes(X.nation_map(spark, sf_dir), "value", scale="sqrt", largest=0.5641895835477563).select("region_id", "size", F.inline(told))
    return places.select("region_id", "canonical", "styled", "mode", r(F.col("size") * F.col("scale")).alias("size"))


@query("SELECT symbol, round(a, 4) + 0.0 AS area, round(b, 4) + 0.0 AS bounding_radius FROM (VALUES ('rectangle', 2 * 0.25 / 1.25, 0.5), ('turned_square', 1.0, sqrt(0.5)), ('mirrored_star', 0.5 * sin(radians(36)), 0.5), ('ih41', 1.0 / 4 / (0.65 ** 2 + 0.25), 0.5)) t(symbol, a, b)")
def tile_symbols(spark, sf_dir):
    """Symbols made of outlines, of transformed symbols and of an isohedral tile."""
    made = {"rectangle": G.tile_symbol([(0, 0), (2, 0), (2, 1), (0, 1)]), "turned_square": G.transformed_symbol("square", 45.0), "mirrored_star": G.transformed_symbol("star", 10.0, True), "ih41": G.tile_symbol(isohedral.Isohedral("ih41").tile().tolist())}
    names = [G.add_symbol(f"query_{k}", v) for k, v in made.items()]
    rows = [(k, G.unit_area(n), G.bounding_radius(n)) for k, n in zip(made, names, strict=True)]
    return rounded(spark.createDataFrame(rows, "symbol string, area double, bounding_radius double"), ["symbol"], "area", "bounding_radius")


@query(BOX + ", m AS (SELECT region_id, sqrt((region_id * 0.01) ** 2 + 0.04) AS d FROM nm) SELECT round(avg(d), 4) + 0.0 AS displacement_mean, round(max(d), 4) + 0.0 AS displacement_max, round(stddev_pop(d), 4) + 0.0 AS displacement_std FROM m")
def displacement_summary(spark, sf_dir):
    held = X.nation_values(spark, sf_dir).withColumn("_displacement", F.hypot(F.col("region_id") * 0.01, F.lit(0.2)))
    return rounded(styling.displacement_metrics(held), [], "displacement_mean", "displacement_max", "displacement_std")


@query(BOX + " SELECT region_id, CASE WHEN region_id % 2 = 0 THEN value ELSE value END AS value FROM nm")
def shown_column(spark, sf_dir):
    """A column to show comes from the source before the symbols' own."""
    symbols = X.nation_values(spark, sf_dir).select("region_id", F.lit(-1.0).alias("value"))
    return measure.with_column(symbols, "value", X.nation_values(spark, sf_dir)).select("region_id", "value")


# Tiles.


@query(BOX + """, t AS (SELECT s_suppkey AS j, 5.0::DOUBLE * ((37 * s_suppkey) % 101) / 101 AS x, 5.0::DOUBLE * ((53 * s_suppkey) % 103) / 103 AS y FROM supplier ORDER BY s_suppkey LIMIT 5),
  c AS (SELECT region_id AS i, j, (x0 + 0.5 - x) ** 2 + (y0 + 0.5 - y) ** 2 AS cost FROM nm, t WHERE region_id < 5)
  SELECT round(min(a.cost + b.cost + c.cost + d.cost + e.cost), 4) + 0.0 AS cost, CAST(5 AS BIGINT) AS tiles FROM c a, c b, c c, c d, c e WHERE a.i = 0 AND b.i = 1 AND c.i = 2 AND d.i = 3 AND e.i = 4
    AND a.j <> b.j AND a.j <> c.j AND a.j <> d.j AND a.j <> e.j AND b.j <> c.j AND b.j <> d.j AND b.j <> e.j AND c.j <> d.j AND c.j <> e.j AND d.j <> e.j""")
def least_cost_assignment(spark, sf_dir):
    """Five regions to five places: the cost is the least over all permutations."""
    n = F.col("region_id")
    sites = X.seed_sites(spark, sf_dir, 5).select(F.col("site_id").cast("long").alias("j"), "x", "y")
    costs = X.nation_values(spark, sf_dir).where("region_id < 5").crossJoin(F.broadcast(sites)).select(n.cast("long").alias("i"), "j", (F.pow(n % 5 + 0.5 - F.col("x"), 2) + F.pow(F.floor(n / 5) + 0.5 - F.col("y"), 2)).alias("cost"))
    found = cartograms.assign(costs).join(costs, ["i", "j"])
    return found.agg(r(F.sum("cost")).alias("cost"), F.countDistinct("j").alias("tiles"))


@query(BOX + " SELECT CAST(a.region_id AS BIGINT) AS i, CAST(b.region_id AS BIGINT) AS j, CAST(abs(a.x0 - b.x0) + abs(a.y0 - b.y0) AS INT) AS hops FROM nm a, nm b")
def tile_hops(spark, sf_dir):
    """Steps across edges between the nations' squares."""
    edges = adjacency.box_pairs(X.nation_map(spark, sf_dir), min_shared=0.5)
    return cartograms.tile_hops(edges.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))).select("i", "j", "hops")


@query("SELECT CAST(8 AS BIGINT) AS tiles, TRUE AS middle_taken")
def tile_holes_filled(spark, sf_dir):
    """Eight regions round an empty tile: one of them moves in."""
    n = F.col("region_id").cast("long")
    square = X.nation_map(spark, sf_dir).where("region_id % 5 < 3 and region_id < 15").withColumn("region_id", F.expr("region_id div 5 * 3 + region_id % 5"))
    edges = adjacency.box_pairs(square, min_shared=0.5).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))
    placed = square.where("region_id < 8").select(n.alias("region_id"), F.when(n < 4, n).otherwise(n + 1).alias("tile_id"))
    held = cartograms.tile_repairs(placed, edges)
    return held.agg(F.countDistinct("tile_id").alias("tiles"), (F.count_if(F.col("tile_id") == 4) == 1).alias("middle_taken"))


@query(f"""WITH {SERIES}, s AS (SELECT iteration, mean_log_error AS v FROM sr WHERE iteration <= 10)
  SELECT iteration, round(avg(v) OVER w, 6) + 0.0 AS mean, round(var_pop(v) OVER w, 6) + 0.0 AS variance FROM s WINDOW w AS (ORDER BY iteration)""")
def moving_stats(spark, sf_dir):
    """The first steps of an adaptive moving mean and variance are the plain ones."""
    held = cartograms.moving_stats(_series(spark, sf_dir).where("iteration <= 10").select("iteration", F.col("mean_log_error").alias("v")))
    return held.select("iteration", r("mean", 6).alias("mean"), r("variance", 6).alias("variance"))


@query(BOX + " SELECT CAST(region_id AS BIGINT) AS tile_id, round(-(region_id // 5 + 0.5), 4) + 0.0 AS cx, round(region_id % 5 + 0.5, 4) + 0.0 AS cy, 90.0::DOUBLE AS rotation, 1.0::DOUBLE AS area FROM nm")
def rotated_tiles(spark, sf_dir):
    held = tilings.rotated(tilings.SQUARE.tiles(spark, X.nation_bounds(spark, sf_dir), tile_size=1.0, margin=0.0), 90.0)
    return held.select("tile_id", r("cx").alias("cx"), r("cy").alias("cy"), "rotation", r(G.area(F.col("geom"))).alias("area"))


@query("SELECT spec, 0.09::DOUBLE AS area, tall FROM (VALUES ('rectangle', 1.0::DOUBLE), ('rectangle_2', 2.0), ('bricks', 1.0), ('ih41', 1.0)) t(spec, tall)")
def named_tilings(spark, sf_dir):
    """Tilings by name, among them presets and types, and rectangles by height over width."""
    bounds = X.nation_bounds(spark, sf_dir)
    held = {"rectangle": tilings.quadrilateral("rectangle"), "rectangle_2": tilings.quadrilateral("rectangle", ratio=2.0), "bricks": tilings.resolve("bricks"), "ih41": tilings.resolve("ih41")}
    parts = []
    for name, tiling in held.items():
        b = G.bounds(F.col("geom"))
        tall = (b["ymax"] - b["ymin"]) / (b["xmax"] - b["xmin"]) if name.startswith("rect") else F.lit(1.0)
        parts.append(tiling.tiles(spark, bounds, tile_size=0.3).agg(r(F.avg(G.area(F.col("geom")))).alias("area"), r(F.avg(tall)).alias("tall")).select(F.lit(name).alias("spec"), "area", "tall"))
    return _union(parts)


@query("SELECT * FROM (VALUES ('ih1', 6, 'TTTTTT', 1), ('ih4', 6, 'TCCTCC', 2), ('ih41', 4, 'TTTT', 1), ('ih46', 4, 'CCCC', 2), ('ih47', 4, 'TCTC', 2), ('ih84', 3, 'CCC', 2)) t(type, corners, edges, aspects)")
def isohedral_types(spark, sf_dir):
    """What the types tell of themselves, after a way through their documents."""
    rows = []
    for name in isohedral.find_types():
        info = isohedral.Isohedral.from_dict(isohedral.Isohedral(name, curves={0: ((0.3, 0.1),)}).to_dict()).info()
        rows.append((name, info["num_vertices"], info["edges"], info["num_aspects"]))
    return spark.createDataFrame(rows, "type string, corners int, edges string, aspects int")


# Voronoi cells.


@query(BOX + " SELECT CAST(region_id AS BIGINT) AS region_id, x0 + 0.5 AS x, y0 + 0.5 AS y, 1.0::DOUBLE AS area FROM nm")
def voronoi_exact(spark, sf_dir):
    """Exact Lloyd steps leave a square lattice as it is."""
    found = cartograms.voronoi_result(X.nation_map(spark, sf_dir), voronoi.Options(n_iter=8, exact=True))
    return found.cells.select("region_id", r("x").alias("x"), r("y").alias("y"), r(G.area(F.col("geom"))).alias("area"))


@query(BOX + " SELECT CAST(region_id AS BIGINT) AS region_id, 1.0::DOUBLE AS area, 0.0::DOUBLE AS area_error_pct FROM nm")
def voronoi_geodesic(spark, sf_dir):
    """Cells by steps inside the map, made of pixels."""
    regions = X.nation_map(spark, sf_dir)
    found = cartograms.voronoi_result(regions, voronoi.Options(n_iter=5, resolution=50, geodesic=True))
    return found.errors(regions).select("region_id", r("area").alias("area"), r("area_error_pct").alias("area_error_pct"))


@query("SELECT CAST(25 AS BIGINT) AS cells, 25.0::DOUBLE AS area, 2.0::DOUBLE AS double_by_single, 3.0::DOUBLE AS triple_by_single, TRUE AS close")
def voronoi_weighted(spark, sf_dir):
    """Weights 1, 2 and 3: the returned cells have areas in that proportion."""
    regions = X.nation_map(spark, sf_dir).withColumn("w", (1 + F.col("region_id") % 3).cast("double"))
    found = cartograms.voronoi_result(regions, voronoi.Options(n_iter=60, resolution=100, final_resolution=300), weight="w").errors(regions)
    mean = lambda k: F.avg(F.when(F.col("w") == k, F.col("area")))
    return found.agg(F.count("*").alias("cells"), r(F.sum("area"), 2).alias("area"), r(mean(2) / mean(1), 0).alias("double_by_single"), r(mean(3) / mean(1), 0).alias("triple_by_single"), (F.max(F.abs("area_error_pct")) < 25).alias("close"))


@query("SELECT iteration, CAST(25 AS BIGINT) AS seeds, 25.0::DOUBLE AS area FROM (VALUES (1), (6), (11)) t(iteration)")
def voronoi_snapshots(spark, sf_dir):
    found = cartograms.voronoi_result(X.nation_map(spark, sf_dir), voronoi.Options(n_iter=12, resolution=60, snapshot_every=5, snapshot_cells=True))
    return found.snapshots.groupBy("iteration").agg(F.count("*").alias("seeds"), r(F.sum(G.area(F.col("geom")))).alias("area"))


@query("SELECT CAST(range AS INT) AS i, round(greatest(1.0, 1.9 * 0.98 ** range), 6) + 0.0 AS overrelax, 1.0::DOUBLE AS lloyd, round(greatest(0.5, 1.2 * 0.9 ** range), 6) + 0.0 AS own FROM range(0, 50)")
def relaxation_schedules(spark, sf_dir):
    held = [voronoi.relaxation_of(x) for x in ("overrelax", "lloyd", voronoi.Relaxation(1.2, 0.9, 0.5))]
    rows = spark.createDataFrame([(i, *(float(f(i)) for f in held)) for i in range(50)], "i int, overrelax double, lloyd double, own double")
    return rows.select("i", *(r(c, 6).alias(c) for c in ("overrelax", "lloyd", "own")))


@query("SELECT spec, round(a, 4) + 0.0 AS area FROM (VALUES ('union', 25.0), ('bbox', 25.0), ('convex_hull', 25.0), ('circle', 64 * 25 / pi() * sin(2 * pi() / 128))) t(spec, a)")
def outer_boundaries(spark, sf_dir):
    parts = [cartograms.outline(X.nation_map(spark, sf_dir), s).select(F.lit(s).alias("spec"), r(G.area(F.col("geom"))).alias("area")) for s in ("union", "bbox", "convex_hull", "circle")]
    return _union(parts)


@query(L + " SELECT round(sum(area), 4) + 0.0 AS area FROM ar WHERE region_id % 3 = 0")
def outer_boundary_of_scattered_regions(spark, sf_dir):
    """The union of regions that hardly touch keeps their area."""
    held = cartograms.outline(X.nation_lshape(spark, sf_dir).where("region_id % 3 = 0"))
    return held.select(r(G.area(F.col("geom"))).alias("area"))


@query("SELECT TRUE AS repaired, TRUE AS fewer_broken, CAST(25 AS BIGINT) AS cells")
def voronoi_repairs(spark, sf_dir):
    """A strip of regions crowded into a circle loses most of its neighbourhoods; repairs on the way bring some back, at the steps that say so."""
    x = F.col("region_id").cast("double")
    strip = X.nation_map(spark, sf_dir).withColumn("geom", G.box(x, F.lit(0.0), x + 1, F.lit(1.0)))
    plain = cartograms.voronoi_result(strip, voronoi.Options(n_iter=10, resolution=60), boundary="circle")
    mended = cartograms.voronoi_result(strip, voronoi.Options(n_iter=10, resolution=60, repair_every=5), boundary="circle")
    report = mended.repair_report(strip, plain.cells).where("what = 'violated'")
    steps = mended.convergence.agg((F.sum("repaired") > 0).alias("repaired"))
    return report.select((F.col("after") < F.col("before")).alias("fewer_broken")).join(steps).join(mended.cells.agg(F.count("*").alias("cells"))).select("repaired", "fewer_broken", "cells")


# Files.


@query(L + " SELECT CAST(region_id AS BIGINT) AS region_id, round(value, 2) + 0.0 AS value, round(area, 4) + 0.0 AS area FROM ar JOIN nm USING (region_id)")
def geojson_documents(spark, sf_dir):
    """One whole GeoJSON document, written and read."""
    path = files.scratch(spark)
    lines = files.features(X.nation_lshape(spark, sf_dir).select(F.col("region_id").alias("n"), "value", "geom"))
    doc = lines.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("feature"), ","), F.lit("]}")).alias("value"))
    doc.coalesce(1).write.text(path)
    held = files.read_geojson(spark, path, "n long, value double", "place")
    return held.select(F.col("n").alias("region_id"), r("value", 2).alias("value"), r(G.area(F.col("geom"))).alias("area"))


@query(L + " SELECT CAST(region_id AS BIGINT) AS region_id, round(area, 4) + 0.0 AS area FROM ar")
def feature_lines(spark, sf_dir):
    path = files.scratch(spark)
    files.write_geojson(X.nation_lshape(spark, sf_dir).select("region_id", "geom"), path)
    return files.read_feature_lines(spark, path, "region_id long").select("region_id", r(G.area(F.col("geom"))).alias("area"))


@query("SELECT CAST(1990 + n_nationkey AS INT) AS year, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS state_fips, n_name AS state_name, upper(substr(n_name, 1, 2)) AS state_abbr, CAST(1000 * n_nationkey + 7 AS BIGINT) AS population FROM nation")
def population_file(spark, sf_dir):
    path, n = files.scratch(spark), F.col("n_nationkey")
    rows = X.table(spark, sf_dir, "nation").select((1990 + n).alias("year"), F.lpad(n.cast("string"), 2, "0").alias("state_fips"), F.col("n_name").alias("state_name"), F.upper(F.substring("n_name", 1, 2)).alias("state_abbr"), (1000 * n + 7).alias("population"))
    rows.write.csv(path, header=True)
    return files.read_population(spark, path)


@query("""WITH c AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS state_fips, 1000000 * (n_nationkey + 1) AS population, 2e9 * (1 + n_nationkey) / (1 + n_nationkey % 3) AS land, 50000 * n_nationkey AS poor FROM nation)
  SELECT state_fips, round(population / 1e6, 4) + 0.0 AS millions, round(population / (land / 1e6), 4) + 0.0 AS density, round(100.0 * poor / population, 4) + 0.0 AS poor_pct FROM c WHERE state_fips NOT IN ('02', '15', '60', '66', '69', '72', '78')""")
def census_columns(spark, sf_dir):
    n = F.col("n_nationkey")
    raw = X.table(spark, sf_dir, "nation").select(F.lpad(n.cast("string"), 2, "0").alias("state_fips"), (1_000_000 * (n + 1)).alias("population"), (2e9 * (1 + n) / (1 + n % 3)).alias("land_area_m2"), (50_000 * n).alias("poor"))
    held = files.census_columns(raw, poverty="poor")
    return held.select("state_fips", r("Population (Millions)").alias("millions"), r("Population Density").alias("density"), r("poor %").alias("poor_pct"))


@query(BOX + " SELECT CAST(region_id AS BIGINT) AS region_id, 'converged' AS status, 1.0::DOUBLE AS area, CAST(1 AS BIGINT) AS steps FROM nm")
def saved_cartogram(spark, sf_dir):
    """A finished cartogram as one document, and back: facts, regions and convergence."""
    path = files.scratch(spark)
    found = cartograms.flow(_even(spark, sf_dir), options=STILL)
    files.save_document(found.regions.select("region_id", "geom"), found.convergence.select("iteration", "mean_log_error"), path, status="converged")
    facts, regions, steps = files.load_document(spark, path, "region_id long", "iteration int, mean_log_error double")
    return regions.join(facts).join(steps.agg(F.count("*").alias("steps"))).select("region_id", "status", r(G.area(F.col("geom"))).alias("area"), "steps")


@query(SIZES + " SELECT CAST(region_id AS BIGINT) AS region_id, 'square' AS symbol, round(4 * (size * sqrt(pi() / 4)) ** 2, 3) + 0.0 AS area, 'centroid' AS layout FROM z")
def saved_symbol_cartogram(spark, sf_dir):
    path = files.scratch(spark)
    made = cartograms.symbol_cartogram(X.nation_map(spark, sf_dir), "value", layout="centroid").restyle(symbol="square", canonical="square")
    files.save_document(made.symbols.select("region_id", "symbol", "geom"), made.history.select("iteration", "a"), path, layout="centroid")
    facts, symbols, _ = files.load_document(spark, path, "region_id long, symbol string", "iteration int, a double", "layout string")
    return symbols.join(facts).select("region_id", "symbol", r(G.area(F.col("geom")), 3).alias("area"), "layout")


@query("SELECT run, CAST(25 AS BIGINT) AS regions, 25.0::DOUBLE AS area FROM (VALUES ('a'), ('b')) t(run)")
def saved_workflow(spark, sf_dir):
    """The tables of two runs in one place, read one by one."""
    path = files.scratch(spark)
    for run in ("a", "b"):
        found = cartograms.flow(_even(spark, sf_dir), options=STILL)
        files.save_tables({"regions": found.regions.select("region_id", "geom"), "steps": found.convergence}, path, run)
    parts = [files.load_table(spark, path, "regions", run).agg(F.count("*").alias("regions"), r(F.sum(G.area(F.col("geom")))).alias("area")).select(F.lit(run).alias("run"), "regions", "area") for run in ("a", "b")]
    return _union(parts)


@query(f"WITH {SERIES} SELECT kind, iteration, round(mean_log_error, 4) + 0.0 AS mean_log_error FROM sr, (VALUES ('csv'), ('json')) t(kind)")
def exported_history(spark, sf_dir):
    series = _series(spark, sf_dir).select("iteration", "mean_log_error")
    path, shape = files.scratch(spark), "iteration int, mean_log_error double"
    for kind in ("csv", "json"):
        files.export_history(series, f"{path}/{kind}", kind)
    held = {"csv": spark.read.csv(f"{path}/csv", header=True, schema=shape), "json": spark.read.schema(shape).json(f"{path}/json")}
    return _union([df.select(F.lit(k).alias("kind"), "iteration", r("mean_log_error").alias("mean_log_error")) for k, df in held.items()])


# Frames and shapes.


@query(L + ", f AS (SELECT range AS frame, range / 4.0 AS p FROM range(0, 9)) SELECT frame, region_id, round(area * (1 + 0.3 * p) ** 2, 4) + 0.0 AS area FROM ar, f")
def region_frames(spark, sf_dir):
    """Regions that grow about their centres from snapshot to snapshot, at every frame between."""
    base = X.nation_lshape(spark, sf_dir).select("region_id", "geom").withColumn("c", G.centroid(F.col("geom")))
    snaps = base.withColumn("idx", F.explode(F.array(*map(F.lit, range(3))))).select("idx", "region_id", G.scale_about(F.col("geom"), 1 + 0.3 * F.col("idx"), F.col("c.x"), F.col("c.y")).alias("geom"))
    held = frames.region_frames(spark.range(9).select(F.col("id").alias("frame"), (F.col("id") / 4.0).alias("position")), snaps)
    return held.select("frame", "region_id", r(G.area(F.col("geom"))).alias("area"))


@query("""WITH p AS (SELECT range AS frame, range % 7 AS inside, range // 7 AS k FROM range(0, 17)) SELECT frame, round(least(2.0, k + greatest(0.0, (inside - 3 + 1) / 5.0)), 4) + 0.0 AS position FROM p""")
def held_keyframes(spark, sf_dir):
    """Three keyframes held for three frames, with four frames between them."""
    return rounded(frames.hold(frames.progress(spark, 17), 3, 3), ["frame"], "position")


@query(L + " SELECT region_id, CAST(ring AS INT) AS k, CAST(any_value(sign) AS INT) AS sign, CAST(count(*) AS INT) AS points FROM vx GROUP BY 1, 2")
def ring_order(spark, sf_dir):
    held = vertices.ring_table(vertices.geometries_of(X.nation_lshape(spark, sf_dir)))
    return held.select("region_id", "k", "sign", F.size("pts").alias("points"))


@query(BOX + " SELECT region_id, 2 AS rings, 1.75::DOUBLE AS area FROM nm")
def small_parts_dropped(spark, sf_dir):
    """Of a big part with two holes and a tiny island, the island and the tiny hole go."""
    n = F.col("region_id").cast("double")
    at = lambda x0, y0, x1, y1: G.box_points(n + x0, F.lit(y0), n + x1, F.lit(y1))
    geom = G.geom("MultiPolygon", G.ring(at(0.0, 0.0, 2.0, 1.0)), G.ring(at(0.2, 0.2, 0.7, 0.7), 0, -1), G.ring(at(1.5, 0.5, 1.6, 0.6), 0, -1), G.ring(at(5.0, 5.0, 5.1, 5.1), 1))
    held = X.nation_values(spark, sf_dir).withColumn("geom", geom).select("region_id", G.drop_small(F.col("geom"), 0.05, 0.05).alias("geom"))
    return held.select("region_id", F.size("geom.rings").alias("rings"), r(G.area(F.col("geom"))).alias("area"))


@query("SELECT round(sqrt(1 / 4.0), 4) + 0.0 AS width, round(1 / 4.0, 4) + 0.0 AS along, round(1.0, 4) + 0.0 AS across, round(0.0, 4) + 0.0 AS mixed")
def gaussian_precisions(spark, sf_dir):
    """One width, widths along and across a direction, and a covariance say the same of a Gaussian."""
    a, b, c = fields.precision(2.0, 0.3), fields.precision((2.0, 1.0), 0.0), fields.precision([[4.0, 0.0], [0.0, 1.0]], 0.0)
    assert b == c
    row = [(a[0] ** 0.5, b[0], b[2], b[1])]
    return rounded(spark.createDataFrame(row, "width double, along double, across double, mixed double"), [], "width", "along", "across", "mixed")


@query(QUEEN + " SELECT i, j, round(shared_len, 4) + 0.0 AS shared_len FROM pr WHERE shared_len > 0.5")
def adjacency_by_edges(spark, sf_dir):
    """Only neighbours across more than a corner."""
    return rounded(adjacency.box_pairs(X.nation_map(spark, sf_dir), min_shared=0.5), ["i", "j"], "shared_len")
