"""Registered queries over maps derived from the test tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fixtures as X
from .functions import geometry as G
from .kernels import flow, voronoi
from .operators import adjacency, fields, frames, grids, isohedral, measure, styling, tilings, topology, vertices
from .plans import cartograms
from .sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def r(c: str | Column, digits: int = 4) -> Column:
    """Rounded, without negative zero; so that sums in another order agree."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, ids: list[str], *values: str) -> DataFrame:
    return df.select(*ids, *(r(v).alias(v) for v in values))


BOX = f"WITH {X.NATION}"
STATE = BOX + """, t AS (SELECT *, sum(value) OVER () / 25.0 AS rho FROM nm), e AS (SELECT *, value / rho AS target, log2(1.0 / (value / rho)) AS le FROM t)"""


@query(STATE + """ SELECT region_id, round(target, 4) + 0.0 AS target_area, round(le, 4) + 0.0 AS log_error,
  round(sign(le) * (pow(2.0, abs(le)) - 1) * 100, 4) + 0.0 AS error_pct, round(value, 4) + 0.0 AS density FROM e""")
def original_state_errors(spark, sf_dir):
    held = measure.original_state(X.nation_map(spark, sf_dir))
    return rounded(held, ["region_id"], "target_area", "log_error", "error_pct", "density")


@query(STATE + """ SELECT round(avg(abs(le)), 4) + 0.0 AS mean_log_error, round(max(abs(le)), 4) + 0.0 AS max_log_error,
  round((pow(2.0, avg(abs(le))) - 1) * 100, 4) + 0.0 AS mean_error_pct, round((pow(2.0, max(abs(le))) - 1) * 100, 4) + 0.0 AS max_error_pct FROM e""")
def error_summary(spark, sf_dir):
    held = measure.error_summary(measure.original_state(X.nation_map(spark, sf_dir)))
    return rounded(held, [], "mean_log_error", "max_log_error", "mean_error_pct", "max_error_pct")


L = f"WITH {X.LSHAPE}"


@query(L + " SELECT region_id, round(area, 4) + 0.0 AS area, round(perimeter, 4) + 0.0 AS perimeter FROM ar")
def region_area_shoelace(spark, sf_dir):
    g = F.col("geom")
    return X.nation_lshape(spark, sf_dir).select("region_id", r(G.area(g)).alias("area"), r(G.perimeter(g)).alias("perimeter"))


@query(L + " SELECT region_id, round(cx, 4) + 0.0 AS cx, round(cy, 4) + 0.0 AS cy FROM ar")
def region_centroid(spark, sf_dir):
    held = X.nation_lshape(spark, sf_dir).select("region_id", G.centroid(F.col("geom")).alias("c"))
    return held.select("region_id", r("c.x").alias("cx"), r("c.y").alias("cy"))


@query(L + " SELECT region_id, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM vx GROUP BY 1")
def region_bounds(spark, sf_dir):
    held = X.nation_lshape(spark, sf_dir).select("region_id", G.bounds(F.col("geom")).alias("b"))
    return held.select("region_id", "b.xmin", "b.ymin", "b.xmax", "b.ymax")


@query(L + " SELECT min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM vx")
def total_bounds(spark, sf_dir):
    return vertices.total_bounds(X.nation_lshape(spark, sf_dir))


@query(L + " SELECT region_id, CAST(ring AS INT) AS ring, CAST(sign AS INT) AS sign, CAST(seq AS INT) AS seq, x, y FROM vx")
def vertex_table(spark, sf_dir):
    held = vertices.explode_vertices(X.nation_lshape(spark, sf_dir).select("region_id", "geom"))
    return held.select("region_id", "ring", F.col("sign").cast("int").alias("sign"), "seq", "x", "y")


@query(L + " SELECT region_id, round(area, 4) + 0.0 AS area, CAST((SELECT count(*) FROM vx WHERE vx.region_id = ar.region_id) AS INT) AS points FROM ar")
def rebuilt_geometry(spark, sf_dir):
    """Geometries taken apart into vertices and put together again."""
    held = vertices.rebuild(vertices.explode_vertices(X.nation_lshape(spark, sf_dir).select("region_id", "geom")), ["region_id"])
    return held.select("region_id", r(G.area(F.col("geom"))).alias("area"), G.n_points(F.col("geom")).alias("points"))


@query(L + """ SELECT 'Polygon' AS kind, count(DISTINCT region_id) AS n_geometries, count(*) AS n_points, count(DISTINCT region_id * 10 + ring) AS n_rings, count(DISTINCT region_id) AS n_polygons FROM vx""")
def geometry_statistics(spark, sf_dir):
    return vertices.statistics(X.nation_lshape(spark, sf_dir))


F3 = f"WITH {X.FLAGS}, s AS (SELECT *, c1 + c2 + c3 AS rs FROM fl)"


def _fractions(spark, sf_dir, normalization, invert=False):
    held = measure.fractions(X.nation_flags(spark, sf_dir), ["c1", "c2", "c3"], normalization, invert, check=not invert)
    return rounded(held, ["region_id"], "f_c1", "f_c2", "f_c3", "f_complement")


def _fraction_sql(by: str) -> str:
    share = lambda c: f"round({c} / {by}, 4) + 0.0 AS f_{c}"
    return F3 + f" SELECT region_id, {', '.join(map(share, ('c1', 'c2', 'c3')))}, round(greatest(0.0, least(1.0, 1 - (c1 / {by} + c2 / {by} + c3 / {by}))), 4) + 0.0 AS f_complement FROM s"


@query(_fraction_sql("(sum(rs) OVER ())"))
def fractions_sum(spark, sf_dir):
    return _fractions(spark, sf_dir, "sum")


@query(_fraction_sql("(max(rs) OVER ())"))
def fractions_maximum(spark, sf_dir):
    return _fractions(spark, sf_dir, "maximum")


@query(_fraction_sql("rs"))
def fractions_row(spark, sf_dir):
    return _fractions(spark, sf_dir, "row")


@query(F3 + """, i AS (SELECT region_id, 1 - c1 / sum(rs) OVER () AS a, 1 - c2 / sum(rs) OVER () AS b, 1 - c3 / sum(rs) OVER () AS c FROM s)
  SELECT region_id, round(a, 4) + 0.0 AS f_c1, round(b, 4) + 0.0 AS f_c2, round(c, 4) + 0.0 AS f_c3, round(greatest(0.0, least(1.0, 1 - (a + b + c))), 4) + 0.0 AS f_complement FROM i""")
def fractions_invert_complement(spark, sf_dir):
    return _fractions(spark, sf_dir, "sum", invert=True)


@query(F3 + """ SELECT region_id, u.category, CAST(round_even(u.v / max(rs) OVER () * 100, 0) AS BIGINT) AS dots
  FROM s, (SELECT unnest(['c1', 'c2', 'c3']) AS category) k, LATERAL (SELECT k.category, CASE k.category WHEN 'c1' THEN c1 WHEN 'c2' THEN c2 ELSE c3 END AS v) u""")
def dot_counts(spark, sf_dir):
    return measure.dot_counts(X.nation_flags(spark, sf_dir), ["c1", "c2", "c3"], 100, "maximum").select("region_id", "category", "dots")


def _sizes(spark, sf_dir, **kw):
    return rounded(measure.symbol_sizes(X.nation_map(spark, sf_dir), "value", **kw), ["region_id"], "size")


@query(BOX + " SELECT region_id, round(sqrt(value) / max(sqrt(value)) OVER () * 0.5, 4) + 0.0 AS size FROM nm")
def symbol_size_sqrt(spark, sf_dir):
    return _sizes(spark, sf_dir, scale="sqrt", largest=0.5)


@query(BOX + " SELECT region_id, round(value / max(value) OVER () * 0.5, 4) + 0.0 AS size FROM nm")
def symbol_size_linear(spark, sf_dir):
    return _sizes(spark, sf_dir, scale="linear", largest=0.5)


@query(BOX + " SELECT region_id, round(ln(1 + value) / max(ln(1 + value)) OVER () * 0.5, 4) + 0.0 AS size FROM nm")
def symbol_size_log(spark, sf_dir):
    return _sizes(spark, sf_dir, scale="log", largest=0.5)


@query(BOX + " SELECT region_id, round(least(1.0, sqrt(value) / sqrt(1000000.0)) * 0.5, 4) + 0.0 AS size FROM nm")
def symbol_size_clipped(spark, sf_dir):
    return _sizes(spark, sf_dir, scale="sqrt", largest=0.5, size_max_value=1_000_000.0)


@query(BOX + """, s AS (SELECT region_id, sqrt(value) / max(sqrt(value)) OVER () * sqrt(1.0 / pi()) AS z FROM nm)
  SELECT region_id, CAST(region_id % 5 + 0.5 AS DOUBLE) AS x, CAST(region_id // 5 + 0.5 AS DOUBLE) AS y, round(z * sqrt(25.0 / sum(pi() * z * z) OVER ()), 4) + 0.0 AS size FROM s""")
def layout_input_total(spark, sf_dir):
    held = measure.layout_input(X.nation_map(spark, sf_dir), "value", normalization="total")
    return rounded(held, ["region_id"], "x", "y", "size")


#: A grid of 32 cells along the longer side of the part map, with a margin of a twentieth.
PART_GRID = f"""{X.PART_BOUNDS}, pg AS (SELECT *, w * 1.1 AS ww, h * 1.1 AS hh, CASE WHEN w >= h THEN 32 ELSE greatest(1, CAST(floor(w * 1.1 * 32 / (h * 1.1)) AS INT)) END AS sx, CASE WHEN w >= h THEN greatest(1, CAST(floor(h * 1.1 * 32 / (w * 1.1)) AS INT)) ELSE 32 END AS sy FROM pb)"""


def _part_grid(spark, sf_dir) -> grids.Grid:
    return grids.Grid.from_bounds(X.part_bounds(spark, sf_dir), 32, 0.05)


@query(f"""WITH {PART_GRID}, g AS (SELECT i.range AS ix, j.range AS iy FROM range(0, 32) i, range(0, 32) j)
  SELECT CAST(iy AS INT) AS iy, CAST(ix AS INT) AS ix, round(-0.05 * w + (ix + 0.5) * (ww / sx), 4) + 0.0 AS x, round(-0.05 * h + (iy + 0.5) * (hh / sy), 4) + 0.0 AS y FROM g, pg WHERE ix < sx AND iy < sy""")
def grid_cells(spark, sf_dir):
    return rounded(_part_grid(spark, sf_dir).cells(spark), ["iy", "ix"], "x", "y")


@query(f"""WITH {X.PART_BOUNDS}, v AS (SELECT w, h, w >= h AS wide, round_even(64 * CASE WHEN w >= h THEN h / w ELSE w / h END, 0) AS near FROM pb),
  k AS (SELECT *, near + d.range AS other FROM v, range(-4, 5) d WHERE near + d.range > 4),
  o AS (SELECT wide, CAST(arg_min(other, (abs(CASE WHEN wide THEN (w / 64) / (h / other) ELSE (w / other) / (h / 64) END - 1), other)) AS INT) AS other FROM k GROUP BY wide)
  SELECT CAST(range AS INT) AS level, CAST(CASE WHEN wide THEN 64 ELSE other END * 2 ** range AS INT) AS sx, CAST(CASE WHEN wide THEN other ELSE 64 END * 2 ** range AS INT) AS sy FROM o, range(0, 3)""")
def multilevel_grid_sizes(spark, sf_dir):
    held = grids.multilevel(X.part_bounds(spark, sf_dir), 64, 3)
    return spark.createDataFrame([(k, g.sx, g.sy) for k, g in enumerate(held)], "level int, sx int, sy int")


@query("""WITH c AS (SELECT i.range AS i, j.range AS j FROM range(0, 10) i, range(0, 10) j) SELECT CAST(i * 10 + j AS BIGINT) AS cell_id,
  CAST(round(-0.5 + 0.3 + i * 0.6, 4) AS DOUBLE) AS x, CAST(round(-0.5 + 0.3 + j * 0.6, 4) AS DOUBLE) AS y, 0.36::DOUBLE AS area FROM c""")
def square_grid(spark, sf_dir):
    held = grids.generate_grid(spark, X.nation_bounds(spark, sf_dir), "square", cell_size=0.6, margin=0.1)
    return held.select("cell_id", r("x").alias("x"), r("y").alias("y"), r(G.area(F.col("geom"))).alias("area"))


@query("""WITH k AS (SELECT r.range AS r, c.range AS c FROM range(0, 11) r, range(0, 10) c WHERE c.range < CASE WHEN r.range % 2 = 0 THEN ceil(6.0 / (sqrt(3.0) * 0.4) + 1) ELSE ceil(6.0 / (sqrt(3.0) * 0.4) + 0.5) END)
  SELECT round(-0.5 + c * sqrt(3.0) * 0.4 + (r % 2) * sqrt(3.0) * 0.2, 4) + 0.0 AS x, CAST(round(-0.5 + r * 0.6, 4) AS DOUBLE) AS y, round(1.5 * sqrt(3.0) * 0.16, 4) + 0.0 AS area FROM k""")
def hex_grid(spark, sf_dir):
    held = grids.generate_grid(spark, X.nation_bounds(spark, sf_dir), "hexagon", cell_size=0.4, margin=0.1)
    return held.select(r("x").alias("x"), r("y").alias("y"), r(G.area(F.col("geom"))).alias("area"))


@query(f"""WITH {X.PART_BOUNDS}, t AS (SELECT i.range * 50 + j.range AS id, i.range AS i, j.range AS j, (SELECT CAST(h AS BIGINT) FROM pb) AS h FROM range(0, 400) i, range(0, 50) j WHERE i.range < (SELECT h FROM pb)),
  e AS (SELECT i, j, i + 1 AS i2, j AS j2 FROM t UNION ALL SELECT i, j, i, j + 1 FROM t), ok AS (SELECT * FROM e WHERE i2 < (SELECT h FROM pb) AND j2 < 50)
  SELECT CAST(j + 0.5 AS DOUBLE) AS x, CAST(i + 0.5 AS DOUBLE) AS y, CAST(j2 + 0.5 AS DOUBLE) AS x2, CAST(i2 + 0.5 AS DOUBLE) AS y2 FROM ok UNION ALL SELECT j2 + 0.5, i2 + 0.5, j + 0.5, i + 0.5 FROM ok""")
def square_tiling_edges(spark, sf_dir):
    """Neighbours across edges among unit tiles over the part map, both ways, by their centres."""
    tiles = tilings.SQUARE.tiles(spark, X.part_bounds(spark, sf_dir), tile_size=1.0, margin=0.0)
    at = lambda k, x, y: tiles.select(F.col("tile_id").alias(k), r("cx").alias(x), r("cy").alias(y))
    return tilings.SQUARE.lattice_edges(tiles).join(at("src", "x", "y"), "src").join(at("dst", "x2", "y2"), "dst").select("x", "y", "x2", "y2")


@query("""SELECT CAST(6 AS BIGINT) AS most, 0.0::DOUBLE AS area_off""")
def hexagon_tiling_edges(spark, sf_dir):
    """Inner hexagons have six neighbours, and all have one area."""
    held = tilings.HEXAGON.tiles(spark, X.nation_bounds(spark, sf_dir), n_tiles=64)
    most = tilings.HEXAGON.lattice_edges(held).groupBy("src").count().agg(F.max("count").alias("most"))
    return most.join(held.agg(r(F.max(G.area(F.col("geom"))) - F.min(G.area(F.col("geom")))).alias("area_off")))


def _lattice_sql(s: str, two: str, v1: tuple[str, str], v2: tuple[str, str], off: tuple[str, str]) -> str:
    return f"""WITH k AS (SELECT i.range AS i, j.range AS j, a.range AS a FROM range(-30, 31) i, range(-30, 31) j, range(0, 2) a),
  c AS (SELECT a, i * ({v1[0]}) + j * ({v2[0]}) + a * ({off[0]}) AS x, i * ({v1[1]}) + j * ({v2[1]}) + a * ({off[1]}) AS y FROM k)
  SELECT CAST(a AS INT) AS aspect, round(x, 4) + 0.0 AS cx, round(y, 4) + 0.0 AS cy FROM c WHERE x BETWEEN -0.5 - {s} AND 5.5 + {s} AND y BETWEEN -0.5 - {s} AND 5.5 + {s}"""


@query(_lattice_sql("0.3", "", ("0.0", "-0.3 * sqrt(2.0)"), ("0.3 * sqrt(2.0)", "0.0"), ("0.1 * sqrt(2.0)", "0.1 * sqrt(2.0)")))
def triangle_tiling_centers(spark, sf_dir):
    """Right isosceles triangles: pairs of them make a square lattice."""
    return rounded(tilings.triangle("right_isosceles").tiles(spark, X.nation_bounds(spark, sf_dir), tile_size=0.3), ["aspect"], "cx", "cy")


@query("""SELECT 1.0::DOUBLE AS unit_area, 12.0::DOUBLE AS most_touching, 3.0::DOUBLE AS most_edges""")
def triangle_tiling_adjacency(spark, sf_dir):
    """Equilateral triangles have three neighbours across edges and touch twelve."""
    held = tilings.triangle().tiles(spark, X.nation_bounds(spark, sf_dir), tile_size=0.3)
    edges = tilings.vertex_edges(held, 0.003)
    both = edges.select("src", "shared").unionByName(edges.select(F.col("dst").alias("src"), "shared"))
    by = both.groupBy("src").agg(F.count("*").alias("n"), F.count_if(F.col("shared") >= 2).alias("e"))
    most = by.agg(F.max("n").cast("double").alias("most_touching"), F.max("e").cast("double").alias("most_edges"))
    return most.join(held.agg(r(F.avg(G.area(F.col("geom"))) / 0.09).alias("unit_area"))).select("unit_area", "most_touching", "most_edges")


@query("""SELECT 1.0::DOUBLE AS unit_area, 4.0::DOUBLE AS most_edges""")
def quadrilateral_tiling_adjacency(spark, sf_dir):
    held = tilings.quadrilateral("trapezoid", top_ratio=0.6).tiles(spark, X.nation_bounds(spark, sf_dir), tile_size=0.3)
    edges = tilings.adjacency(held, "edge", 0.003)
    both = edges.select("src").unionByName(edges.select(F.col("dst").alias("src")))
    most = both.groupBy("src").count().agg(F.max("count").cast("double").alias("most_edges"))
    return most.join(held.agg(r(F.avg(G.area(F.col("geom"))) / 0.09).alias("unit_area"))).select("unit_area", "most_edges")


QUEEN = BOX + """, pr AS (SELECT a.region_id AS i, b.region_id AS j, CASE WHEN abs(a.x0 - b.x0) + abs(a.y0 - b.y0) = 1 THEN 1.001 ELSE 0.001 END::DOUBLE AS shared_len
  FROM nm a JOIN nm b ON a.region_id < b.region_id AND abs(a.x0 - b.x0) <= 1 AND abs(a.y0 - b.y0) <= 1),
  bw AS (SELECT i AS src, j AS dst, shared_len FROM pr UNION ALL SELECT j, i, shared_len FROM pr)"""


@query(QUEEN + " SELECT i, j, round(shared_len, 4) + 0.0 AS shared_len FROM pr")
def adjacency_pairs(spark, sf_dir):
    return rounded(adjacency.box_pairs(X.nation_map(spark, sf_dir)), ["i", "j"], "shared_len")


@query(QUEEN + " SELECT src, dst, 1.0::DOUBLE AS weight FROM bw")
def adjacency_binary(spark, sf_dir):
    regions = X.nation_map(spark, sf_dir)
    return adjacency.weights(regions, adjacency.box_pairs(regions), "binary")


@query(QUEEN + " SELECT src, dst, round(shared_len / 4.0, 6) + 0.0 AS weight FROM bw")
def adjacency_weighted(spark, sf_dir):
    regions = X.nation_map(spark, sf_dir)
    return adjacency.weights(regions, adjacency.box_pairs(regions), "weighted").select("src", "dst", r("weight", 6).alias("weight"))


@query(QUEEN + " SELECT src, dst, round(1.0 / count(*) OVER (PARTITION BY src), 4) + 0.0 AS weight FROM bw")
def adjacency_area_weighted(spark, sf_dir):
    regions = X.nation_map(spark, sf_dir)
    return rounded(adjacency.weights(regions, adjacency.box_pairs(regions), "area_weighted"), ["src", "dst"], "weight")


SAME = QUEEN + """, inr AS (SELECT i, j FROM pr JOIN nm a ON a.region_id = i JOIN nm b ON b.region_id = j WHERE a.grp = b.grp)"""
COMPONENTS = SAME.replace("WITH", "WITH RECURSIVE", 1) + """, ln AS (SELECT i AS a, j AS b FROM inr UNION ALL SELECT j, i FROM inr), reach(region_id, r) AS (SELECT region_id, region_id FROM nm
  UNION SELECT reach.region_id, ln.b FROM reach JOIN ln ON reach.r = ln.a), cp AS (SELECT region_id, min(r) AS component FROM reach GROUP BY 1)"""


def _grouped(spark, sf_dir):
    regions = X.nation_map(spark, sf_dir)
    names = regions.select("region_id", "grp")
    edges = adjacency.box_pairs(regions).join(names.select(F.col("region_id").alias("i"), F.col("grp").alias("gi")), "i").join(names.select(F.col("region_id").alias("j"), F.col("grp").alias("gj")), "j")
    return regions, edges.where("gi = gj").select("i", "j")


@query(COMPONENTS + " SELECT region_id, component FROM cp")
def connected_components(spark, sf_dir):
    regions, edges = _grouped(spark, sf_dir)
    return adjacency.components(regions, edges)


@query(COMPONENTS + """, sm AS (SELECT component, sum(value) AS v, count(*) AS a FROM cp JOIN nm USING (region_id) GROUP BY 1)
  SELECT region_id, component, round(sqrt(v / ((SELECT sum(value) FROM nm) / 25.0) / a), 4) + 0.0 AS scale FROM cp JOIN sm USING (component)""")
def prescale_scale_factor(spark, sf_dir):
    regions, edges = _grouped(spark, sf_dir)
    return rounded(adjacency.prescale(regions, adjacency.components(regions, edges)), ["region_id", "component"], "scale")


THIRDS = COMPONENTS.replace("n.n_regionkey AS grp", "n.n_nationkey % 3 AS grp")


@query(THIRDS + """, sz AS (SELECT grp, component, count(*) AS n FROM cp JOIN nm USING (region_id) GROUP BY 1, 2),
  mn AS (SELECT grp, component AS main FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, component) AS k FROM sz) WHERE k = 1)
  SELECT region_id, grp, component FROM cp JOIN nm USING (region_id) JOIN mn USING (grp) WHERE component <> main""")
def group_satellites(spark, sf_dir):
    """Groups (n % 3) lie in stripes across the map; what only meets its group across edges is apart from it."""
    regions = X.nation_map(spark, sf_dir).withColumn("grp", F.col("region_id") % 3)
    return topology.satellites(regions, adjacency.box_pairs(regions))


CELLS = """gc AS (SELECT CAST(id // 20 AS INT) AS iy, CAST(id % 20 AS INT) AS ix, CAST(-1.25 + (id % 20 + 0.5) * 0.375 AS DOUBLE) AS x, CAST(-1.25 + (id // 20 + 0.5) * 0.375 AS DOUBLE) AS y FROM (SELECT range AS id FROM range(0, 400)))"""


def _grid() -> grids.Grid:
    return grids.Grid.from_bounds((0.0, 0.0, 5.0, 5.0), 20, 0.25)


@query(BOX + f", {CELLS} SELECT iy, ix, round(coalesce(value, (SELECT sum(value) / 25 FROM nm)), 4) + 0.0 AS rho, CAST(coalesce(region_id, -1) AS BIGINT) AS geom_idx FROM gc LEFT JOIN nm ON x >= x0 AND x < x0 + 1 AND y >= y0 AND y < y0 + 1")
def density_field_boxes(spark, sf_dir):
    return fields.density_field(X.nation_map(spark, sf_dir), _grid()).select("iy", "ix", r("rho").alias("rho"), "geom_idx")


@query(BOX + f""", {CELLS}, d AS (SELECT iy, ix, coalesce(value, (SELECT sum(value) / 25 FROM nm)) / (SELECT sum(value) / 25 FROM nm) AS q FROM gc LEFT JOIN nm ON x >= x0 AND x < x0 + 1 AND y >= y0 AND y < y0 + 1)
  SELECT iy, ix, round(log2(greatest(q, 1e-6)), 4) + 0.0 AS shown FROM d""")
def density_display_ratio(spark, sf_dir):
    regions = X.nation_map(spark, sf_dir)
    mean = regions.agg(F.sum("value") / 25).first()[0]
    return fields.density_display(fields.density_field(regions, _grid(), mean_density=mean), mean).select("iy", "ix", r("shown").alias("shown"))


FIELD = f"WITH {CELLS}, {X.order_field_sql('gc', 20, 20)}"


def _field(spark, sf_dir) -> DataFrame:
    return X.order_field(_grid().cells(spark), sf_dir, 20, 20)


@query(FIELD + " SELECT round(max(sqrt(vx * vx + vy * vy)), 4) + 0.0 AS max_speed, round(greatest(max(abs(vx)), max(abs(vy))), 4) + 0.0 AS max_component FROM fd")
def field_maxima(spark, sf_dir):
    return rounded(vertices.field_maxima(_field(spark, sf_dir)), [], "max_speed", "max_component")


@query(f"WITH {X.POINTS} SELECT point_id, round(x + 0.5 * (0.3 * x - 0.1 * y), 4) + 0.0 AS x, round(y + 0.5 * 0.05 * x * y, 4) + 0.0 AS y FROM pt")
def displacement_step(spark, sf_dir):
    """The field is bilinear, so interpolation is exact and the oracle needs no grid."""
    field = _grid().cells(spark).withColumns({"vx": 0.3 * F.col("x") - 0.1 * F.col("y"), "vy": 0.05 * F.col("x") * F.col("y")})
    return rounded(vertices.displace(X.user_points(spark, sf_dir), field, _grid(), 0.5), ["point_id"], "x", "y")


@query(FIELD + """, th AS (SELECT *, atan2(y - 2.5, x - 2.5) AS t FROM fd)
  SELECT iy, ix, round((2 * cos(t) ** 2 + sin(t) ** 2) * vx + cos(t) * sin(t) * vy, 4) + 0.0 AS vx, round(cos(t) * sin(t) * vx + (2 * sin(t) ** 2 + cos(t) ** 2) * vy, 4) + 0.0 AS vy FROM th""")
def directional_tensor_radial(spark, sf_dir):
    return rounded(fields.directional(_field(spark, sf_dir), fields.radial(_grid())), ["iy", "ix"], "vx", "vy")


@query(FIELD + """, th AS (SELECT *, atan2(y - 2.5, x - 2.5) + pi() / 2 AS t FROM fd)
  SELECT iy, ix, round((3 * cos(t) ** 2 + 0.5 * sin(t) ** 2) * vx + 2.5 * cos(t) * sin(t) * vy, 4) + 0.0 AS vx, round(2.5 * cos(t) * sin(t) * vx + (3 * sin(t) ** 2 + 0.5 * cos(t) ** 2) * vy, 4) + 0.0 AS vy FROM th""")
def directional_tensor_tangential(spark, sf_dir):
    return rounded(fields.directional(_field(spark, sf_dir), fields.tangential(_grid()), 3.0, 0.5), ["iy", "ix"], "vx", "vy")


@query(FIELD + """, w AS (SELECT iy, ix, 1 / ((x - 0.1) ** 2 + (y - 0.2) ** 2) AS a, 1 / ((x - 4) ** 2 + (y - 3) ** 2) AS b FROM fd)
  SELECT iy, ix, round(atan2(a * sin(0.3) + b * sin(1.2), a * cos(0.3) + b * cos(1.2)), 4) + 0.0 AS theta FROM w""")
def idw_direction_field(spark, sf_dir):
    held = fields.seeded_direction(_field(spark, sf_dir), [(0.1, 0.2, 0.3), (4.0, 3.0, 1.2)])
    return rounded(held, ["iy", "ix"], "theta")


@query(FIELD + """, w AS (SELECT *, exp(-0.5 * ((x - 1) ** 2 + (y - 1) ** 2) / 0.64) AS a FROM fd)
  SELECT iy, ix, round((2 * a + (1 - a)) * vx, 4) + 0.0 AS vx, round((a + (1 - a)) * vy, 4) + 0.0 AS vy FROM w""")
def localized_tensor(spark, sf_dir):
    return rounded(fields.localized(_field(spark, sf_dir), [(1.0, 1.0, 0.0, 0.8)]), ["iy", "ix"], "vx", "vy")


@query(FIELD + " SELECT iy, ix, round(vx * 2, 4) + 0.0 AS vx, round(vy * x, 4) + 0.0 AS vy FROM fd")
def multiplicative_modulator(spark, sf_dir):
    return rounded(fields.multiply(_field(spark, sf_dir), 2.0, F.col("x")), ["iy", "ix"], "vx", "vy")


@query(FIELD + " SELECT iy, ix, round(vx * 1.37, 6) + 0.0 AS vx, round(vy * 0.61, 6) + 0.0 AS vy FROM fd")
def axis_aligned_tensor(spark, sf_dir):
    held = fields.axis_aligned(_field(spark, sf_dir), 1.37, 0.61)
    return held.select("iy", "ix", r("vx", 6).alias("vx"), r("vy", 6).alias("vy"))


@query(FIELD + """, m AS (SELECT max(sqrt(vx ** 2 + vy ** 2)) AS top FROM fd) SELECT iy, ix, round(sqrt(vx ** 2 + vy ** 2) / top, 4) + 0.0 AS magnitude, round((atan2(vy, vx) + pi()) / (2 * pi()), 4) + 0.0 AS direction FROM fd, m WHERE ix % 4 = 0 AND iy % 4 = 0""")
def velocity_display(spark, sf_dir):
    return rounded(fields.velocity_display(_field(spark, sf_dir), 4), ["iy", "ix"], "magnitude", "direction")


def _label_sql(d2: str) -> str:
    return f"""WITH {X.SITES}, {CELLS}, dd AS (SELECT iy, ix, gc.x, gc.y, site_id, {d2} AS d FROM gc, st),
  lb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY iy, ix ORDER BY d, site_id) AS k FROM dd) WHERE k = 1)"""


D2 = "(gc.x - st.x) * (gc.x - st.x) + (gc.y - st.y) * (gc.y - st.y)"


@query(_label_sql(D2) + " SELECT iy, ix, site_id AS label FROM lb")
def voronoi_label_step(spark, sf_dir):
    return fields.nearest_labels(_grid().cells(spark), X.seed_sites(spark, sf_dir)).select("iy", "ix", "label")


@query(_label_sql(f"({D2}) / weight") + " SELECT iy, ix, site_id AS label FROM lb")
def voronoi_label_weighted(spark, sf_dir):
    return fields.nearest_labels(_grid().cells(spark), X.seed_sites(spark, sf_dir), weighted=True).select("iy", "ix", "label")


@query(_label_sql(D2) + """, mn AS (SELECT site_id, avg(x) AS mx, avg(y) AS my, count(*) AS n FROM lb GROUP BY 1)
  SELECT site_id, round(st.x + 1.5 * (coalesce(mx, st.x) - st.x), 4) + 0.0 AS x, round(st.y + 1.5 * (coalesce(my, st.y) - st.y), 4) + 0.0 AS y, coalesce(n, 0) AS n_cells FROM st LEFT JOIN mn USING (site_id)""")
def lloyd_centroid_step(spark, sf_dir):
    seeds = X.seed_sites(spark, sf_dir)
    labelled = fields.nearest_labels(_grid().cells(spark), seeds)
    return fields.lloyd_step(labelled, seeds, 1.5).select("site_id", r("x").alias("x"), r("y").alias("y"), "n_cells")


@query(_label_sql(D2) + """, mn AS (SELECT site_id, count(*) AS n FROM lb GROUP BY 1)
  SELECT site_id, round(0.2 * 0.140625 * (400.0 / (SELECT count(*) FROM st) - coalesce(n, 0)), 4) + 0.0 AS "offset" FROM st LEFT JOIN mn USING (site_id)""")
def power_offset_update(spark, sf_dir):
    seeds = X.seed_sites(spark, sf_dir).withColumn("offset", F.lit(0.0))
    counted = fields.lloyd_step(fields.nearest_labels(_grid().cells(spark), seeds), seeds)
    return rounded(fields.offset_update(counted, 0.1, _grid().dx * _grid().dy), ["site_id"], "offset")


@query(BOX + " SELECT round(stddev_pop(value) / avg(value), 4) + 0.0 AS area_cv FROM nm")
def area_cv(spark, sf_dir):
    return rounded(measure.area_cv(X.nation_map(spark, sf_dir), "value"), [], "area_cv")


@query(BOX + " SELECT region_id, round((value / (sum(value) OVER () / 25) - 1) * 100, 4) + 0.0 AS area_error_pct FROM nm")
def area_errors(spark, sf_dir):
    return rounded(measure.area_errors(X.nation_map(spark, sf_dir), "value"), ["region_id"], "area_error_pct")


MOVED = QUEEN + """, mv AS (SELECT region_id, x0 + 0.5 AS bx, y0 + 0.5 AS by, (7 * region_id) % 5 + 0.5 AS ax, (3 * region_id) // 5 % 5 + 0.5 AS ay FROM nm)"""


def _moved(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The nation map's centres, and another arrangement of them."""
    n = F.col("region_id")
    ids = X.nation_values(spark, sf_dir).select("region_id", "grp")
    before = ids.select("region_id", "grp", (n % 5 + 0.5).alias("x"), (F.floor(n / 5) + 0.5).alias("y"))
    return before, ids.select("region_id", "grp", ((7 * n) % 5 + 0.5).alias("x"), (F.floor(3 * n / 5) % 5 + 0.5).alias("y"))


@query(MOVED + " SELECT i, j FROM pr JOIN mv a ON a.region_id = i JOIN mv b ON b.region_id = j WHERE NOT (abs(a.ax - b.ax) <= 1 AND abs(a.ay - b.ay) <= 1)")
def topology_violations(spark, sf_dir):
    regions, (_, after) = X.nation_map(spark, sf_dir), _moved(spark, sf_dir)
    boxes = after.select("region_id", G.box(F.col("x") - 0.5, F.col("y") - 0.5, F.col("x") + 0.5, F.col("y") + 0.5).alias("geom"))
    return topology.violations(adjacency.box_pairs(regions), adjacency.box_pairs(boxes))


@query(MOVED + """, d AS (SELECT i, j, b.bx - a.bx AS p, b.by - a.by AS q, b.ax - a.ax AS u, b.ay - a.ay AS v FROM pr JOIN mv a ON a.region_id = i JOIN mv b ON b.region_id = j)
  SELECT i, j, round(CASE WHEN u * u + v * v = 0 THEN 0.0 ELSE (p * u + q * v) / sqrt(p * p + q * q) / sqrt(u * u + v * v) END, 4) + 0.0 AS cosine, (p * u + q * v) <= 0 AS misaligned FROM d""")
def orientation_cosine(spark, sf_dir):
    regions, (before, after) = X.nation_map(spark, sf_dir), _moved(spark, sf_dir)
    return topology.orientation(adjacency.box_pairs(regions), before, after).select("i", "j", r("cosine").alias("cosine"), "misaligned")


@query(BOX + """, c AS (SELECT region_id, grp, x0 + 0.5 AS x, y0 + 0.5 AS y FROM nm), d AS (SELECT *, (x - avg(x) OVER (PARTITION BY grp)) ** 2 + (y - avg(y) OVER (PARTITION BY grp)) ** 2 AS d2 FROM c)
  SELECT region_id, grp, round(d2 / avg(d2) OVER (PARTITION BY grp), 4) + 0.0 AS score FROM d""")
def compactness_score(spark, sf_dir):
    return rounded(topology.compactness(_moved(spark, sf_dir)[0]), ["region_id", "grp"], "score")


#: Thirty steps of a run; how many orders fall to a step makes its mean rise and fall.
SERIES = f"""{X.order_sums_sql(30)}, sr AS (SELECT CAST(range AS INT) AS iteration, 0.9 / (1 + range) + 0.02 * (coalesce(orders, 0) % 3) AS mean_log_error, 1.7 / (1 + range) AS max_log_error FROM range(1, 31) LEFT JOIN oc ON k = range - 1)"""


def _series(spark, sf_dir) -> DataFrame:
    i, n = F.col("id"), F.coalesce("orders", F.lit(0))
    steps = spark.range(1, 31).join(X.order_sums(spark, sf_dir, 30), F.col("id") - 1 == F.col("k"), "left")
    return steps.select(i.cast("int").alias("iteration"), (0.9 / (1 + i) + 0.02 * (n % 3)).alias("mean_log_error"), (1.7 / (1 + i)).alias("max_log_error"))


@query(f"""WITH {SERIES}, l AS (SELECT *, CASE WHEN mean_log_error > lag(mean_log_error) OVER (ORDER BY iteration) THEN 1 ELSE 0 END AS up FROM sr), c AS (SELECT *, sum(up) OVER (ORDER BY iteration) AS rises FROM l)
  SELECT iteration, CAST(rises AS BIGINT) AS rises, CASE WHEN mean_log_error < log2(1.05) AND max_log_error < log2(1.10) THEN 'converged' WHEN rises > 5 THEN 'stalled' ELSE 'running' END AS status FROM c""")
def convergence_status(spark, sf_dir):
    return measure.convergence_status(_series(spark, sf_dir)).select("iteration", F.col("rises").cast("long").alias("rises"), "status")


YEARS = """y AS (SELECT CAST(row_number() OVER (ORDER BY year(o_orderdate)) - 1 AS INT) AS idx, count(*) AS n FROM orders GROUP BY year(o_orderdate))"""


def _years(spark, sf_dir) -> DataFrame:
    """(idx, n): the orders of each year, few rows."""
    by = X.table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    return by.select((F.row_number().over(Window.orderBy("year")) - 1).alias("idx"), "n")


@query(f"""WITH p AS (SELECT range AS frame, range / 20.0 AS progress FROM range(0, 21)), {YEARS}, s AS (SELECT idx, sum(n) OVER (ORDER BY idx) - first(n) OVER (ORDER BY idx) AS v FROM y),
  b AS (SELECT idx, v, lead(v) OVER (ORDER BY idx) AS nxt, max(v) OVER () AS top FROM s)
  SELECT CAST(frame AS BIGINT) AS frame, round(coalesce(idx + (progress * top - v) / (nxt - v), (SELECT max(idx) FROM s)), 4) + 0.0 AS position FROM p LEFT JOIN b ON progress * top >= v AND progress * top < nxt""")
def linear_over_position(spark, sf_dir):
    """Frames spaced by how the orders of the years add up."""
    along = Window.orderBy("idx")  # a row for each year
    series = _years(spark, sf_dir).select("idx", (F.sum("n").over(along) - F.first("n").over(along)).cast("double").alias("v"))
    return rounded(frames.linear_over(frames.progress(spark, 21), series), ["frame"], "position")


@query(f"""WITH p AS (SELECT range AS frame, range / 20.0 AS progress FROM range(0, 21)), {YEARS}, s AS (SELECT idx, CASE WHEN idx = 1 THEN -1.0 ELSE n END AS w FROM y),
  c AS (SELECT idx, greatest(w, 0) / sum(greatest(w, 0)) OVER () AS sh, sum(greatest(w, 0)) OVER (ORDER BY idx) / sum(greatest(w, 0)) OVER () AS hi FROM s)
  SELECT CAST(frame AS BIGINT) AS frame, round(max(idx + (progress - (hi - sh)) / sh), 4) + 0.0 AS position FROM p JOIN c ON sh > 0 AND progress >= hi - sh AND (progress < hi OR (progress >= 1 AND hi >= 1)) GROUP BY 1""")
def weights_position(spark, sf_dir):
    """Frames dealt to the years by their orders; a year of negative weight gets none."""
    series = _years(spark, sf_dir).select("idx", F.when(F.col("idx") == 1, F.lit(-1.0)).otherwise(F.col("n").cast("double")).alias("w"))
    return rounded(frames.by_weights(frames.progress(spark, 21), series), ["frame"], "position")


@query(L + " SELECT region_id, round(area * 1.3225, 4) + 0.0 AS area FROM ar")
def ring_interpolation(spark, sf_dir):
    """Half way to regions grown by 1.3 about their own centre, areas have grown by 1.15 squared."""
    a = X.nation_lshape(spark, sf_dir).select("region_id", "geom")
    b = a.withColumn("c", G.centroid(F.col("geom"))).select("region_id", G.scale_about(F.col("geom"), F.lit(1.3), F.col("c.x"), F.col("c.y")).alias("geom"))
    return vertices.interpolate_rings(a, b, 0.5).select("region_id", r(G.area(F.col("geom"))).alias("area"))


@query(L + " SELECT region_id, 0.5::DOUBLE AS dx, -0.25::DOUBLE AS dy, round(sqrt(0.3125), 4) AS displacement, 1.0::DOUBLE AS area_change FROM ar")
def compare_results(spark, sf_dir):
    a = X.nation_lshape(spark, sf_dir).select("region_id", "geom")
    b = a.select("region_id", G.map_points(F.col("geom"), lambda p: G.point_of(p["x"] + 0.5, p["y"] - 0.25)).alias("geom"))
    return rounded(measure.compare(a, b), ["region_id"], "dx", "dy", "displacement", "area_change")


@query(BOX + """, z AS (SELECT region_id, x0 + 0.5 AS x, y0 + 0.5 AS y, sqrt(value) / max(sqrt(value)) OVER () * sqrt(1.0 / pi()) AS size FROM nm)
  SELECT region_id, CASE WHEN region_id % 4 = 1 THEN 'square' ELSE 'circle' END AS symbol, round(x, 4) + 0.0 AS _symbol_x, round(y, 4) + 0.0 AS _symbol_y, round(size, 4) + 0.0 AS _symbol_size,
    round(CASE WHEN region_id % 4 = 1 THEN 4 * (size * sqrt(0.5)) ** 2 * 0.81 ELSE 0 END, 3) + 0.0 AS square_area FROM z""")
def style_overrides(spark, sf_dir):
    """Every fourth region a square, at nine tenths, inside its circle."""
    layout = measure.layout_input(X.nation_map(spark, sf_dir), "value").withColumns({"x0": F.col("x"), "y0": F.col("y")}).select("region_id", "x", "y", "size", "x0", "y0")
    rules = layout.where("region_id % 4 = 1").select("region_id", F.lit(0).alias("seq"), F.lit("square").alias("symbol"), F.lit(0.9).alias("scale"), F.lit(None).cast("double").alias("rotation"), F.lit(None).cast("boolean").alias("reflection"), F.lit(None).cast("map<string,string>").alias("params"))
    placed = styling.symbols(styling.overrides(layout, rules))
    shown = F.when(F.col("symbol") == "square", G.area(F.col("geom"))).otherwise(F.lit(0.0))
    return placed.select("region_id", "symbol", *(r(c).alias(c) for c in ("_symbol_x", "_symbol_y", "_symbol_size")), r(shown, 3).alias("square_area"))


@query(f"""WITH {SERIES}, rn AS (SELECT 0 AS run_id, * FROM sr WHERE iteration <= 10 UNION ALL SELECT 1, * FROM sr WHERE iteration <= 7 UNION ALL SELECT 2, * FROM sr WHERE iteration <= 20)
  SELECT run_id, iteration, CAST(iteration + CASE run_id WHEN 0 THEN 0 WHEN 1 THEN 10 ELSE 17 END AS BIGINT) AS step FROM rn""")
def workflow_convergence(spark, sf_dir):
    s = _series(spark, sf_dir)
    runs = [s.where(F.col("iteration") <= n).withColumn("run_id", F.lit(k)) for k, n in enumerate((10, 7, 20))]
    return frames.workflow_series(runs[0].unionByName(runs[1]).unionByName(runs[2])).select("run_id", "iteration", F.col("step").cast("long").alias("step"))


@query(BOX + """ SELECT region_id, round(0.5 + (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) * 2.5, 4) + 0.0 AS linewidth FROM nm""")
def rescaled_values(spark, sf_dir):
    return rounded(measure.rescaled(X.nation_map(spark, sf_dir), "value", 0.5, 3.0, "linewidth"), ["region_id"], "linewidth")


@query("""WITH lo AS (SELECT min(p_partkey) AS m FROM part), p AS (SELECT p_partkey AS region_id, (p_partkey - m) AS k FROM part, lo)
  SELECT a.region_id AS i, b.region_id AS j, round(CASE WHEN abs(a.k % 50 - b.k % 50) + abs(a.k // 50 - b.k // 50) = 1 THEN 1.001 ELSE 0.001 END::DOUBLE, 4) + 0.0 AS shared_len
  FROM p a JOIN p b ON a.region_id < b.region_id AND abs(a.k % 50 - b.k % 50) <= 1 AND abs(a.k // 50 - b.k // 50) <= 1""")
def part_map_adjacency(spark, sf_dir):
    """Neighbours of every part's square: a spatial self-join over all parts."""
    return rounded(adjacency.box_pairs(X.part_map(spark, sf_dir)), ["i", "j"], "shared_len")


@query("""WITH lo AS (SELECT min(p_partkey) AS m FROM part), t AS (SELECT p_partkey AS region_id, p_retailprice AS value, sum(p_retailprice) OVER () / count(*) OVER () AS rho FROM part)
  SELECT region_id, round(value / rho, 4) + 0.0 AS target_area, round(log2(rho / value), 4) + 0.0 AS log_error FROM t""")
def part_map_errors(spark, sf_dir):
    return rounded(measure.original_state(X.part_map(spark, sf_dir)), ["region_id"], "target_area", "log_error")



# Solvers: what must hold of their results is compared; the results themselves have no SQL.


@query("SELECT 'converged' AS status, TRUE AS within, CAST(25 AS BIGINT) AS regions, 25.0::DOUBLE AS area")
def flow_cartogram(spark, sf_dir):
    """The nation map carried until its mean error is under 5 % and its largest under 10 %."""
    found = cartograms.flow(X.nation_map(spark, sf_dir), options=flow.Options(grid_size=128))
    last = found.convergence.orderBy(F.desc("iteration")).limit(1).select("status", ((F.col("mean_error_pct") < 5) & (F.col("max_error_pct") < 10)).alias("within"))
    return last.join(found.regions.agg(F.count("*").alias("regions"), r(F.sum(G.area(F.col("geom"))), 0).alias("area")))


@query("SELECT 'converged' AS status, TRUE AS missed, TRUE AS met, TRUE AS more_levels")
def flow_multiresolution(spark, sf_dir):
    """Limits at nine tenths of what the first level alone comes to: it misses them, and a finer level goes on from it and meets them."""
    regions = X.nation_map(spark, sf_dir)
    never = flow.Options(mean_tol=1e-9, max_tol=1e-9)
    alone = cartograms.multiresolution(regions, min_resolution=32, levels=1, options=never).convergence
    least = alone.agg((0.009 * F.min("mean_error_pct")).alias("mean"), (0.009 * F.min("max_error_pct")).alias("max")).first()
    found = cartograms.multiresolution(regions, min_resolution=32, levels=3, options=never.with_(mean_tol=least["mean"], max_tol=least["max"])).convergence
    first = found.where("run_id = 1").agg((F.min("max_error_pct") > 100 * least["max"]).alias("missed"))
    last = found.orderBy(F.desc("run_id"), F.desc("iteration")).limit(1)
    told = last.select("status", ((F.col("mean_error_pct") <= 100 * least["mean"]) & (F.col("max_error_pct") <= 100 * least["max"])).alias("met"), (F.col("run_id") > 1).alias("more_levels"))
    return told.join(first).select("status", "missed", "met", "more_levels")


@query("SELECT 2 AS runs, TRUE AS fell")
def flow_workflow(spark, sf_dir):
    """One run refined by another with tighter limits: the second ends below the first."""
    work = cartograms.Workflow(X.nation_map(spark, sf_dir))
    work.morph(flow.Options(grid_size=64, mean_tol=0.2, max_tol=0.4))
    work.morph(flow.Options(grid_size=64, mean_tol=0.05, max_tol=0.1))
    ends = work.convergence().groupBy("run_id").agg(F.max_by("mean_error_pct", "iteration").alias("e"))
    return ends.agg(F.countDistinct("run_id").cast("int").alias("runs"), (F.max_by("e", "run_id") < F.max_by("e", -F.col("run_id"))).alias("fell"))


def _areas(df: DataFrame, names: list[str], digits: int = 4) -> DataFrame:
    return df.select("region_id", *(r(F.coalesce(G.area(F.col(f"geometry_{c}")), F.lit(0.0)), digits).alias(f"a_{c}") for c in names))


@query(F3 + " SELECT region_id, round(c1 / rs, 4) + 0.0 AS a_c1, round(c2 / rs, 4) + 0.0 AS a_c2, round(c3 / rs, 4) + 0.0 AS a_c3 FROM s")
def partition_split(spark, sf_dir):
    """Unit squares cut by shares of their row: parts have just those areas."""
    regions = X.nation_map(spark, sf_dir).select("region_id", "geom").join(X.nation_flags(spark, sf_dir), "region_id")
    return _areas(cartograms.partition(regions, ["c1", "c2", "c3"], "split", "row"), ["c1", "c2", "c3"])


@query(F3 + " SELECT region_id, round(c1 / rs, 4) + 0.0 AS a_c1, round(c2 / rs, 4) + 0.0 AS a_c2, round(c3 / rs, 4) + 0.0 AS a_c3 FROM s")
def partition_treemap(spark, sf_dir):
    regions = X.nation_map(spark, sf_dir).select("region_id", "geom").join(X.nation_flags(spark, sf_dir), "region_id")
    return _areas(cartograms.partition(regions, ["c1", "c2", "c3"], "split", "row", strategy="treemap"), ["c1", "c2", "c3"])


@query(F3 + " SELECT region_id, round(c1 / rs, 3) + 0.0 AS a_c1, round(c2 / rs, 3) + 0.0 AS a_c2, round(c3 / rs, 3) + 0.0 AS a_c3 FROM s")
def partition_shrink(spark, sf_dir):
    """Concentric shells of the same areas, with a fine tolerance."""
    regions = X.nation_map(spark, sf_dir).select("region_id", "geom").join(X.nation_flags(spark, sf_dir), "region_id")
    return _areas(cartograms.partition(regions, ["c1", "c2", "c3"], "shrink", "row", tol=1e-9), ["c1", "c2", "c3"], 3)


@query(F3 + """, p AS (SELECT region_id, c1, c2, c3, max(rs) OVER () AS m FROM s)
  SELECT region_id, round(c1 / m, 4) + 0.0 AS a_c1, round(1 - rs / m, 4) + 0.0 AS a_complement FROM p JOIN s USING (region_id, c1, c2, c3)""")
def partition_complement(spark, sf_dir):
    regions = X.nation_map(spark, sf_dir).select("region_id", "geom").join(X.nation_flags(spark, sf_dir), "region_id")
    held = cartograms.partition(regions, ["c1", "c2", "c3"], "split", "maximum")
    zero = lambda c: F.greatest(F.col(c), F.lit(0.0))
    return _areas(held, ["c1", "complement"]).select("region_id", zero("a_c1").alias("a_c1"), zero("a_complement").alias("a_complement"))


@query(ORACLES["dot_counts"].replace("AS dots", "AS dots").replace(" SELECT region_id, u.category", " SELECT CAST(region_id AS BIGINT) AS original_index, u.category", 1).replace("AS BIGINT) AS dots", "AS BIGINT) AS dots, TRUE AS inside"))
def dot_density(spark, sf_dir):
    """As many dots as counted, all inside their square."""
    regions = X.nation_map(spark, sf_dir).select("region_id", "geom").join(X.nation_flags(spark, sf_dir), "region_id")
    dots = cartograms.dot_density(regions, ["c1", "c2", "c3"], 100, "maximum")
    n = F.col("original_index")
    inside = (F.floor("x") == n % 5) & (F.floor("y") == F.floor(n / 5))
    return dots.groupBy("original_index", "category").agg(F.count("*").alias("dots"), F.every(inside).alias("inside"))


@query(QUEEN + " SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(shared_len, 4) + 0.0 AS shared_len FROM pr")
def adjacency_polygons(spark, sf_dir):
    """The general kernel agrees with the closed form of boxes."""
    return rounded(adjacency.pairs(X.nation_map(spark, sf_dir)), ["i", "j"], "shared_len")


def _overlaps(layout: DataFrame) -> DataFrame:
    o = layout.select("map_id", *(F.col(c).alias(c + "_") for c in ("region_id", "x", "y", "size")))
    near = layout.join(o, "map_id").where(F.col("region_id") < F.col("region_id_"))
    hit = F.hypot(F.col("x") - F.col("x_"), F.col("y") - F.col("y_")) < (F.col("size") + F.col("size_")) * 0.999
    return near.agg(F.count_if(hit).alias("overlaps")).join(layout.agg(F.count("*").alias("symbols")))


@query("SELECT CAST(0 AS BIGINT) AS overlaps, CAST(25 AS BIGINT) AS symbols")
def circle_packing(spark, sf_dir):
    return _overlaps(cartograms.layout(X.nation_map(spark, sf_dir), "value", "packing"))


@query("SELECT CAST(0 AS BIGINT) AS overlaps, CAST(25 AS BIGINT) AS symbols, TRUE AS moved, TRUE AS near")
def circle_physics(spark, sf_dir):
    """Circles that began with overlaps end without, not where they were and not far from it."""
    held = cartograms.layout(X.nation_map(spark, sf_dir), "value", "physics")
    far = F.max(F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0")))
    return _overlaps(held).join(held.agg((far > 0.01).alias("moved"), (far < 2.5).alias("near")))


@query("SELECT CAST(25 AS BIGINT) AS tiles, CAST(25 AS BIGINT) AS regions")
def tile_map(spark, sf_dir):
    """Every region has a tile of its own."""
    held = cartograms.grid_layout(X.nation_map(spark, sf_dir), "value", "hexagon")
    return held.agg(F.countDistinct("tile_id").alias("tiles"), F.count("*").alias("regions"))


@query("SELECT CAST(25 AS BIGINT) AS cells, 25.0::DOUBLE AS area, TRUE AS even")
def voronoi_cartogram(spark, sf_dir):
    """Cells tile the map, and their areas come out nearly even."""
    cells, steps = cartograms.voronoi(X.nation_map(spark, sf_dir), voronoi.Options(n_iter=30, resolution=120))
    last = steps.agg((F.max_by("area_cv", "iteration") < 0.1).alias("even"))
    return cells.agg(F.count("*").alias("cells"), r(F.sum(G.area(F.col("geom"))), 3).alias("area")).join(last)


@query("SELECT CAST(25 AS BIGINT) AS regions, CAST(25 AS BIGINT) AS cells, TRUE AS fewer")
def contiguous_groups(spark, sf_dir):
    """Groups scattered over the nation map drawn together: a permutation with fewer stray regions than there were."""
    regions = X.nation_map(spark, sf_dir).withColumn("grp", (F.col("region_id") * 7 % 25) % 3)
    held = cartograms.make_groups_contiguous(regions, "grp")
    edges = adjacency.box_pairs(regions)
    before = topology.satellites(regions, edges).count()
    moved = held.join(regions.select("region_id", "grp"), "region_id").select(F.col("cell_id").alias("region_id"), "grp")
    after = topology.satellites(moved, edges).agg(F.count("*").alias("n"))
    return held.agg(F.count("*").alias("regions"), F.countDistinct("cell_id").alias("cells")).join(after).select("regions", "cells", (F.col("n") < before).alias("fewer"))


@query(L + " SELECT CAST(region_id AS BIGINT) AS region_id FROM ar WHERE region_id % 7 = 3 OR region_id % 7 = 5")
def topology_check(spark, sf_dir):
    """Among good shapes, some with holes, rings that cross themselves and rings without area are found."""
    n = F.col("region_id")
    x, y = (n % 5).cast("double"), F.floor(n / 5).cast("double")
    bow = G.geom("Polygon", G.ring(F.array(*(G.point_of(x + a, y + b) for a, b in ((0, 0), (1, 1), (1, 0), (0, 1), (0, 0))))))
    flat = G.geom("Polygon", G.ring(F.array(*(G.point_of(x + a, y) for a in (0, 1, 0.5, 0)))))
    return cartograms.check_topology(X.nation_lshape(spark, sf_dir).withColumn("geom", F.when(n % 7 == 3, bow).when(n % 7 == 5, flat).otherwise(F.col("geom"))))


@query(L + " SELECT region_id, round(area, 4) + 0.0 AS area FROM ar")
def geojson_round_trip(spark, sf_dir):
    """Features as text and back, holes included."""
    lines = files.features(X.nation_lshape(spark, sf_dir).select("region_id", "geom"))
    shape = "struct<properties:struct<region_id:int>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>"
    held = lines.select(F.from_json("feature", shape).alias("f"))
    area = F.aggregate(F.transform("f.geometry.coordinates", lambda p, k: F.when(k == 0, 1).otherwise(-1) * G.ring_area(F.transform(p, lambda c: G.point_of(c[0], c[1])))), F.lit(0.0), lambda a, v: a + v)
    return held.select("f.properties.region_id", r(area).alias("area"))


@query(BOX + " SELECT CAST(region_id AS BIGINT) AS region_id, 1.0::DOUBLE AS area, TRUE AS fewer_points, CAST(CASE WHEN x0 BETWEEN 1 AND 3 AND y0 BETWEEN 1 AND 3 THEN 5 END AS INT) AS inner_points FROM nm")
def simplified_coverage(spark, sf_dir):
    """Squares with needless points on their borders (ten and the first again) come back as squares: inner ones with their corners only."""
    n = F.col("region_id")
    x0, y0 = (n % 5).cast("double"), F.floor(n / 5).cast("double")
    dense = F.array(*(G.point(x0 + a, y0 + b) for a, b in ((0, 0), (0.3, 0), (0.6, 0), (1, 0), (1, 0.4), (1, 1), (0.6, 1), (0.3, 1), (0, 1), (0, 0.4), (0, 0))))
    regions = X.nation_values(spark, sf_dir).withColumn("geom", G.geom("Polygon", G.ring(dense)))
    held = cartograms.simplify(regions, 0.01)
    points, m = G.n_points(F.col("geom")), F.col("region_id")
    inner = (m % 5).between(1, 3) & F.floor(m / 5).between(1, 3)
    return held.select("region_id", r(G.area(F.col("geom"))).alias("area"), (points < 11).alias("fewer_points"), F.when(inner, points).alias("inner_points"))


@query(L + """, t AS (SELECT unnest([0.0, 0.5, 1.0]) AS t) SELECT CAST(region_id AS BIGINT) AS region_id, CAST(t AS DOUBLE) AS t,
  CAST(CASE region_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN CASE t WHEN 0.0 THEN 0.75 WHEN 0.5 THEN 0.8125 ELSE 1.0 END ELSE 1 - (0.5 * (1 - t)) ** 2 END AS DOUBLE) AS area FROM ar, t""")
def shape_interpolation(spark, sf_dir):
    """From notched and holed shapes to whole squares, at the start, half way and at the end: holes without a partner shrink."""
    a, b = X.nation_lshape(spark, sf_dir), X.nation_map(spark, sf_dir)
    parts = [cartograms.interpolate(a, b, t).select("region_id", F.lit(t).alias("t"), r(G.area(F.col("geom"))).alias("area")) for t in (0.0, 0.5, 1.0)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT * FROM (VALUES ('ih1', 1.0::DOUBLE, 6), ('ih4', 1.0, 6), ('ih41', 1.0, 4), ('ih46', 1.0, 4), ('ih47', 1.0, 4), ('ih84', 1.0, 3)) t(type, unit_area, neighbours)")
def isohedral_tilings(spark, sf_dir):
    """Tiles of every type have one area, and inner ones as many neighbours as edges."""
    out, bounds = None, X.nation_bounds(spark, sf_dir)
    for name, (kinds, _) in isohedral.TYPES.items():
        tiles = isohedral.Isohedral(name).tiles(spark, bounds, tile_size=0.3)
        edges = tilings.vertex_edges(tiles, 1e-6).where("shared >= 2")
        most = edges.select("src").unionByName(edges.select(F.col("dst").alias("src"))).groupBy("src").count().agg(F.max("count").cast("int").alias("neighbours"))
        one = tiles.agg(r(F.avg(G.area(F.col("geom"))) / 0.09).alias("unit_area")).join(most).select(F.lit(name).alias("type"), "unit_area", "neighbours")
        out = one if out is None else out.unionByName(one)
    return out
