"""Queries of rasters, borders, walks and several maps in one table, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import fixtures as X
from .functions import geometry as G
from .kernels import flow, raster, voronoi
from .operators import adjacency, auction, borders, fields, grids, history, measure, rasters, vertices, walks
from .plans import cartograms
from .queries import BOX, SERIES, L, _series, query, r
from .sources import census, files, manifest

GRID20 = """gc AS (SELECT CAST(range // 20 AS INT) AS iy, CAST(range % 20 AS INT) AS ix, -1.25 + (range % 20 + 0.5) * 0.375::DOUBLE AS cx, -1.25 + (range // 20 + 0.5) * 0.375::DOUBLE AS cy FROM range(0, 400))"""
#: Regions that hold a centre by the parity of borders to its right.
HELD = """hit AS (SELECT iy, ix, region_id FROM gc JOIN ed ON x2 IS NOT NULL AND (y <= cy) <> (y2 <= cy) AND cx < x + (cy - y) * (x2 - x) / CASE WHEN y2 <> y THEN y2 - y END GROUP BY ALL HAVING count(*) % 2 = 1)"""


def _grid() -> grids.Grid:
    return grids.Grid.from_bounds((0.0, 0.0, 5.0, 5.0), 20, 0.25)


@query(L + f""", {GRID20}, {HELD} SELECT iy, ix, round(coalesce(max_by(nm.value / ar.area, region_id), (SELECT sum(value) / (SELECT sum(area) FROM ar) FROM nm)), 4) + 0.0 AS rho, CAST(coalesce(max(region_id), -1) AS BIGINT) AS geom_idx
  FROM gc LEFT JOIN hit USING (iy, ix) LEFT JOIN nm USING (region_id) LEFT JOIN ar USING (region_id) GROUP BY iy, ix""")
def density_polygons(spark, sf_dir):
    """Densities of notched and holed regions: notches and holes are outside."""
    return rasters.density_field(X.nation_lshape(spark, sf_dir), _grid()).select("iy", "ix", r("rho").alias("rho"), "geom_idx")


@query(L + f""", {GRID20}, {HELD}, mean AS (SELECT nm.grp, sum(nm.value) / sum(area) AS mean FROM nm JOIN ar USING (region_id) GROUP BY nm.grp),
  own AS (SELECT grp, iy, ix, max(region_id) AS region_id FROM hit JOIN nm USING (region_id) GROUP BY ALL)
  SELECT CAST(mean.grp AS VARCHAR) AS map_id, gc.iy, gc.ix, round(coalesce(nullif(nm.value / ar.area, 0), mean), 4) + 0.0 AS rho, CAST(coalesce(own.region_id, -1) AS BIGINT) AS geom_idx
  FROM mean CROSS JOIN gc LEFT JOIN own ON own.grp = mean.grp AND own.iy = gc.iy AND own.ix = gc.ix LEFT JOIN nm ON nm.region_id = own.region_id LEFT JOIN ar ON ar.region_id = own.region_id""")
def density_of_maps(spark, sf_dir):
    """A map for every continent, on one grid: each has its own mean outside."""
    regions = X.nation_lshape(spark, sf_dir).withColumn("map_id", F.col("grp").cast("string"))
    return rasters.density_field(regions, _grid(), zero_is_outside=True).select("map_id", "iy", "ix", r("rho").alias("rho"), "geom_idx")


@query(L + f""", rows AS (SELECT range AS iy, -1.25 + (range + 0.5) * 0.375::DOUBLE AS cy FROM range(0, 20)),
  cr AS (SELECT region_id, iy, x + (cy - y) * (x2 - x) / CASE WHEN y2 <> y THEN y2 - y END AS x FROM ed JOIN rows ON x2 IS NOT NULL AND (y <= cy) <> (y2 <= cy)),
  sp AS (SELECT *, row_number() OVER w AS k, lead(x) OVER w AS x1 FROM cr WINDOW w AS (PARTITION BY region_id, iy ORDER BY x))
  SELECT region_id, CAST(iy AS INT) AS iy, round(x, 6) + 0.0 AS x0, round(x1, 6) + 0.0 AS x1 FROM sp WHERE k % 2 = 1 AND x1 > x""")
def raster_spans(spark, sf_dir):
    """Each grid row's stretches inside each region: two beside a hole."""
    held = rasters.spans(X.nation_lshape(spark, sf_dir), _grid())
    return held.select("region_id", "iy", r("x0", 6).alias("x0"), r("x1", 6).alias("x1"))


#: Two maps of squares: one in two pieces, of which one has a hole, and without two of its corners; one of two bands.
ISLANDS = "n.region_id % 5 <> 3 AND n.region_id NOT IN (0, 11, 24)"
BANDS = "n.region_id // 5 <> 2"
TWO = BOX + f""", maps AS (SELECT 'islands' AS map_id, n.* FROM nm n WHERE {ISLANDS} UNION ALL SELECT 'bands', n.* FROM nm n WHERE {BANDS}),
  side(dx, dy, ex, ey) AS (VALUES (0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0)),
  es AS (SELECT map_id, CAST(x0 + dx AS INT) AS ax, CAST(y0 + dy AS INT) AS ay, CAST(x0 + ex AS INT) AS bx, CAST(y0 + ey AS INT) AS bv FROM maps, side),
  rim AS (SELECT * FROM es e WHERE NOT EXISTS (SELECT 1 FROM es o WHERE o.map_id = e.map_id AND o.ax = e.bx AND o.ay = e.bv AND o.bx = e.ax AND o.bv = e.ay))"""
#: A point's ring is the least point that it reaches along the rim.
RINGS = """, link AS (SELECT map_id, ax * 10 + ay AS p, bx * 10 + bv AS q FROM rim UNION SELECT map_id, bx * 10 + bv, ax * 10 + ay FROM rim),
  reach AS (WITH RECURSIVE w AS (SELECT DISTINCT map_id, p AS p0, p AS p1 FROM link UNION SELECT w.map_id, w.p0, link.q FROM w JOIN link ON link.map_id = w.map_id AND link.p = w.p1) SELECT map_id, p0 AS p, min(p1) AS ring FROM w GROUP BY ALL),
  rg AS (SELECT map_id, ring, sum(ax * bv - bx * ay) / 2.0 AS a, count(*) AS n FROM rim JOIN reach USING (map_id) WHERE p = ax * 10 + ay GROUP BY ALL)"""


def _two_maps(spark, sf_dir) -> DataFrame:
    regions, n = X.nation_map(spark, sf_dir), F.col("region_id")
    one = regions.where((n % 5 != 3) & ~n.isin(0, 11, 24)).withColumn("map_id", F.lit("islands"))
    return one.unionByName(regions.where(F.floor(n / 5) != 2).withColumn("map_id", F.lit("bands")))


@query(TWO + RINGS + " SELECT map_id, CAST(sign(a) AS INT) AS sign, round(abs(a), 4) + 0.0 AS area, CAST(n AS INT) AS points FROM rg")
def outline_rings(spark, sf_dir):
    """The outlines of two maps, ring by ring: pieces and their holes."""
    held = borders.outline_rings(_two_maps(spark, sf_dir))
    return held.select("map_id", F.col("sign").cast("int").alias("sign"), r(G.ring_area(F.col("pts"))).alias("area"), (F.size("pts") - 1).alias("points"))


@query(TWO + RINGS + """, s AS (SELECT map_id, count(*) AS squares, max(x0 + 1) - min(x0) AS w, max(y0 + 1) - min(y0) AS h FROM maps GROUP BY 1),
  k AS (SELECT map_id, count(*) FILTER (a > 0) AS parts, count(*) AS rings FROM rg GROUP BY 1)
  SELECT map_id, spec, round(CASE spec WHEN 'union' THEN squares WHEN 'bbox' THEN w * h WHEN 'convex_hull' THEN w * h - CASE WHEN map_id = 'islands' THEN 1.5 ELSE 0 END ELSE 64 * squares / pi() * sin(2 * pi() / 128) END, 4) + 0.0 AS area,
    CAST(CASE WHEN spec = 'union' THEN parts ELSE 1 END AS INT) AS parts, CAST(CASE WHEN spec = 'union' THEN rings ELSE 1 END AS INT) AS rings
  FROM s JOIN k USING (map_id), (VALUES ('union'), ('bbox'), ('convex_hull'), ('circle')) t(spec)""")
def outlines_that_differ(spark, sf_dir):
    """Union, bounds, hull and circle of a map with a hole, an island and missing corners; half a square and a whole one lie between its hull and its bounds."""
    out = None
    for spec in ("union", "bbox", "convex_hull", "circle"):
        one = cartograms.outline(_two_maps(spark, sf_dir), spec).select("map_id", F.lit(spec).alias("spec"), r(G.area(F.col("geom"))).alias("area"), F.size(F.array_distinct("geom.rings.part")).alias("parts"), F.size("geom.rings").alias("rings"))
        out = one if out is None else out.unionByName(one)
    return out


def _stepped(spark, sf_dir) -> DataFrame:
    """Squares whose borders carry needless points, and a step of a hundredth in the middle of each."""
    n = F.col("region_id")
    x0, y0 = (n % 5).cast("double"), F.floor(n / 5).cast("double")
    along = ((0.0, 0.0), (0.25, 0.0), (0.5, 0.01), (0.75, 0.0), (1.0, 0.0), (1.0, 0.25), (1.01, 0.5), (1.0, 0.75), (1.0, 1.0), (0.75, 1.0), (0.5, 1.01), (0.25, 1.0), (0.0, 1.0), (0.0, 0.75), (0.01, 0.5), (0.0, 0.25), (0.0, 0.0))
    return X.nation_values(spark, sf_dir).withColumn("geom", G.geom("Polygon", G.ring(F.array(*(G.point(x0 + a, y0 + b) for a, b in along)))))


@query("""WITH a AS (SELECT x.range AS x, y.range AS y, way FROM range(0, 6) x, range(0, 6) y, (VALUES ('along'), ('up')) t(way) WHERE (way = 'along' AND x.range < 5) OR (way = 'up' AND y.range < 5)),
  b AS (SELECT *, CASE way WHEN 'along' THEN y WHEN 'up' THEN x END IN (0, 5) AS rim FROM a),
  corner AS (SELECT x, y, x IN (0, 5) AND y IN (0, 5) AS bare FROM range(0, 6) x(x), range(0, 6) y(y)),
  n AS (SELECT rim, CAST(count(*) AS BIGINT) AS edges FROM b GROUP BY 1)
  SELECT rim, CAST(edges - CASE WHEN rim THEN 4 ELSE 0 END AS BIGINT) AS arcs, CAST(4 * edges AS BIGINT) AS steps FROM n""")
def shared_arcs(spark, sf_dir):
    """Each border once, between the points where regions meet; the map's four corners are no such points, so two sides of a corner are one arc."""
    found, _ = borders.arcs(_stepped(spark, sf_dir))
    return found.groupBy((F.size("who") == 1).alias("rim")).agg(F.count("*").alias("arcs"), F.sum(F.size("pts") - 1).alias("steps"))


@query(BOX + """ SELECT CAST(region_id AS BIGINT) AS region_id, 1.0::DOUBLE AS area, CAST(5 AS INT) AS points FROM nm WHERE x0 BETWEEN 1 AND 3 AND y0 BETWEEN 1 AND 3""")
def simplified_arcs(spark, sf_dir):
    """Steps below the tolerance go from both sides of every border: inner regions are the squares between their corners."""
    held = cartograms.simplify(_stepped(spark, sf_dir), 0.1).where("region_id % 5 between 1 and 3 and region_id div 5 between 1 and 3")
    return held.select("region_id", r(G.area(F.col("geom"))).alias("area"), G.n_points(F.col("geom")).alias("points"))


SUPPLIERS = """st AS (SELECT s_suppkey AS site_id, 5.0::DOUBLE * ((37 * s_suppkey) % 101) / 101 AS x, 5.0::DOUBLE * ((53 * s_suppkey) % 103) / 103 AS y, CAST(1 + s_nationkey AS DOUBLE) AS weight, 0.01::DOUBLE * (s_suppkey % 17) AS "offset" FROM supplier)"""


def _suppliers(spark, sf_dir) -> DataFrame:
    key = F.col("s_suppkey")
    return X.table(spark, sf_dir, "supplier").select(key.alias("site_id"), (5.0 * ((37 * key) % 101) / 101).alias("x"), (5.0 * ((53 * key) % 103) / 103).alias("y"), (1.0 + F.col("s_nationkey")).alias("weight"), (0.01 * (key % 17)).alias("offset"))


def _all_sql(score: str) -> str:
    return f"""WITH {SUPPLIERS}, {GRID20} SELECT iy, ix, arg_min(site_id, (({score}), site_id)) AS label FROM gc, (SELECT site_id, x, y, weight, "offset" FROM st) GROUP BY iy, ix"""


SQUARED = "(cx - x) * (cx - x) + (cy - y) * (cy - y)"


@query(_all_sql(SQUARED))
def labels_of_all_suppliers(spark, sf_dir):
    return fields.nearest_labels(_grid().cells(spark), _suppliers(spark, sf_dir), listed=0).select("iy", "ix", "label")


@query(_all_sql(f"({SQUARED}) / weight"))
def weighted_labels_of_all_suppliers(spark, sf_dir):
    """Weights of one to twenty-five."""
    return fields.nearest_labels(_grid().cells(spark), _suppliers(spark, sf_dir), weighted=True, listed=0).select("iy", "ix", "label")


@query(_all_sql(f"""({SQUARED}) / 1.0 - "offset\""""))
def offset_labels_of_all_suppliers(spark, sf_dir):
    return fields.nearest_labels(_grid().cells(spark), _suppliers(spark, sf_dir), offset=True, listed=0).select("iy", "ix", "label")


#: A horseshoe: the squares of column 2 above the lowest are missing.
SHOE = f"""WITH {X.NATION}, {SUPPLIERS}, gc AS (SELECT CAST(range // 40 AS INT) AS iy, CAST(range % 40 AS INT) AS ix, (range % 40 + 0.5) * 0.125::DOUBLE AS x, (range // 40 + 0.5) * 0.125::DOUBLE AS y FROM range(0, 1600)),
  act AS (SELECT gc.* FROM gc JOIN nm ON gc.x > x0 AND gc.x < x0 + 1 AND gc.y > y0 AND gc.y < y0 + 1 WHERE region_id % 5 <> 2 OR region_id < 5),
  home AS (SELECT site_id, st.x, st.y, CAST(least(39, floor(st.x / 0.125)) AS INT) AS ix, CAST(least(39, floor(st.y / 0.125)) AS INT) AS iy FROM st),
  near AS (SELECT site_id, arg_min(act.iy * 40 + act.ix, ((act.x - home.x) * (act.x - home.x) + (act.y - home.y) * (act.y - home.y), act.iy * 40 + act.ix)) AS c FROM home, act GROUP BY site_id),
  go AS (SELECT home.site_id, CASE WHEN act.iy IS NULL THEN c // 40 ELSE home.iy END AS iy, CASE WHEN act.iy IS NULL THEN c % 40 ELSE home.ix END AS ix FROM home JOIN near USING (site_id) LEFT JOIN act ON act.iy = home.iy AND act.ix = home.ix),
  nb(dy, dx) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)),
  walk AS (WITH RECURSIVE w AS (SELECT CAST(iy AS INT) AS iy, CAST(ix AS INT) AS ix, min(site_id) AS label, 0 AS steps FROM go GROUP BY iy, ix
    UNION ALL SELECT act.iy, act.ix, min(label), steps + 1 FROM w, nb, act WHERE act.iy = w.iy + dy AND act.ix = w.ix + dx AND steps < 160 GROUP BY act.iy, act.ix, steps) SELECT * FROM w)
  SELECT iy, ix, arg_min(label, steps) AS label, CAST(min(steps) AS INT) AS steps FROM walk GROUP BY iy, ix"""


def _shoe(spark, sf_dir) -> tuple[DataFrame, grids.Grid]:
    grid = grids.Grid.from_bounds((0.0, 0.0, 5.0, 5.0), 40)
    held = X.nation_map(spark, sf_dir).where("region_id % 5 <> 2 or region_id < 5")
    return rasters.rasterize(held, grid).select("iy", "ix", (grid.xmin + (F.col("ix") + 0.5) * grid.dx).alias("x"), (grid.ymin + (F.col("iy") + 0.5) * grid.dy).alias("y")), grid


@query(SHOE)
def geodesic_labels(spark, sf_dir):
    """Steps inside a horseshoe to the nearest supplier: seeds across the gap are far, however near they lie."""
    cells, grid = _shoe(spark, sf_dir)
    return walks.geodesic_labels(cells, _suppliers(spark, sf_dir), grid, tile=16).select("iy", "ix", "label", "steps")


@query(SHOE.replace("FROM supplier)", "FROM supplier ORDER BY s_suppkey LIMIT 1)"))
def geodesic_distance_to_the_first_supplier(spark, sf_dir):
    """The whole horseshoe walked from one seed, through many tiles."""
    cells, grid = _shoe(spark, sf_dir)
    held = _suppliers(spark, sf_dir)
    first = held.join(held.agg(F.min("site_id").alias("site_id")), "site_id")
    return walks.geodesic_labels(cells, first, grid, tile=8).select("iy", "ix", "label", "steps")


#: The map of nations twice, the second time twice as large, under the same ids.
TWICE = BOX + """, pr AS (SELECT a.region_id AS i, b.region_id AS j, abs(a.x0 - b.x0) + abs(a.y0 - b.y0) = 1 AS side FROM nm a JOIN nm b ON a.region_id < b.region_id AND abs(a.x0 - b.x0) <= 1 AND abs(a.y0 - b.y0) <= 1),
  mp(map_id, size) AS (VALUES ('one', 1.0::DOUBLE), ('two', 2.0::DOUBLE))"""


def _twice(spark, sf_dir) -> DataFrame:
    regions, n = X.nation_map(spark, sf_dir).withColumn("map_id", F.lit("one")), F.col("region_id")
    x, y = 2.0 * (n % 5), 2.0 * F.floor(n / 5)
    return regions.unionByName(X.nation_map(spark, sf_dir).withColumn("map_id", F.lit("two")).withColumn("geom", G.box(x, y, x + 2, y + 2)))


@query(TWICE + " SELECT map_id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(size * (CASE WHEN side THEN 1.001 ELSE 0.001 END), 3) + 0.0 AS shared_len FROM pr, mp")
def adjacency_of_maps(spark, sf_dir):
    """Two maps that lie over each other: neighbours are of one map, each map has its own tolerance."""
    return adjacency.pairs(_twice(spark, sf_dir)).select("map_id", "i", "j", r("shared_len", 3).alias("shared_len"))


@query(TWICE + """, gr AS (SELECT a.map_id, i, j FROM (SELECT * FROM pr, mp) a JOIN nm x ON x.region_id = i JOIN nm y ON y.region_id = j WHERE CASE WHEN map_id = 'one' THEN x.grp = y.grp ELSE x.region_id % 2 = y.region_id % 2 END),
  bo AS (SELECT map_id, i, j FROM gr UNION ALL SELECT map_id, j, i FROM gr),
  wk AS (WITH RECURSIVE w AS (SELECT map_id, region_id AS p0, region_id AS p1 FROM nm, mp UNION SELECT w.map_id, w.p0, bo.j FROM w JOIN bo ON bo.map_id = w.map_id AND bo.i = w.p1) SELECT * FROM w)
  SELECT map_id, p0 AS region_id, min(p1) AS component FROM wk GROUP BY ALL""")
def components_of_maps(spark, sf_dir):
    """Neighbours of one continent in one map, neighbours of like ids in the other: components of one never reach the other."""
    regions = _twice(spark, sf_dir)
    names = regions.select("map_id", "region_id", F.when(F.col("map_id") == "one", F.col("grp")).otherwise(F.col("region_id") % 2).alias("g"))
    of = lambda k: names.select("map_id", F.col("region_id").alias(k), F.col("g").alias("g" + k))
    edges = adjacency.box_pairs(regions).join(of("i"), ["map_id", "i"]).join(of("j"), ["map_id", "j"]).where("gi = gj")
    return adjacency.components(names, edges).select("map_id", "region_id", "component")


@query(TWICE + """, bw AS (SELECT map_id, i AS src, j AS dst FROM pr, mp WHERE side UNION ALL SELECT map_id, j, i FROM pr, mp WHERE side)
  SELECT map_id, src, dst, round(1.001 / 4, 6) + 0.0 AS weight FROM bw""")
def weights_of_maps(spark, sf_dir):
    """The shared part of a region's own perimeter, edges alone; the same in both maps, since tolerances follow the size."""
    regions = _twice(spark, sf_dir)
    held = adjacency.weights(regions, adjacency.box_pairs(regions, min_shared=0.5), "weighted")
    return held.select("map_id", "src", "dst", r("weight", 6).alias("weight"))




#: Nations by their order totals against nations by their customers, both as whole numbers to 100; on a line the least cost pairs them in order.
LINE = BOX + """, cu AS (SELECT c_nationkey AS j, count(*) AS n FROM customer GROUP BY 1),
  a AS (SELECT region_id AS i, CAST(floor(100 * value / max(value) OVER ()) AS BIGINT) AS x FROM nm), b AS (SELECT region_id AS j, CAST(floor(100 * coalesce(n, 0) / max(n) OVER ()) AS BIGINT) AS y FROM nm LEFT JOIN cu ON j = region_id)"""


@query(LINE + """, p AS (SELECT x, row_number() OVER (ORDER BY x) AS k FROM a), q AS (SELECT y, row_number() OVER (ORDER BY y) AS k FROM b)
  SELECT CAST(25 AS BIGINT) AS pairs, CAST(sum((x - y) * (x - y)) AS DOUBLE) AS cost, TRUE AS proven FROM p JOIN q USING (k)""")
def auction_assignment(spark, sf_dir):
    """All 25 nations to 25 places: costs are whole and epsilon is under 1 / 25, so the total is the least one, and prices prove it."""
    nations = X.nation_values(spark, sf_dir)
    x = nations.join(F.broadcast(nations.agg(F.max("value").alias("top")))).select(F.col("region_id").alias("i"), F.floor(100 * F.col("value") / F.col("top")).alias("x"))  # one row
    customers = X.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("j")).agg(F.count("*").alias("n"))
    y = nations.select(F.col("region_id").alias("j")).join(customers, "j", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    y = y.join(F.broadcast(y.agg(F.max("n").alias("top")))).select("j", F.floor(100 * F.col("n") / F.col("top")).alias("y"))  # one row
    options = x.join(F.broadcast(y.agg(F.collect_list(F.struct("j", "y")).alias("all")))).select("i", "x", F.inline("all"))  # 25 places
    costs = options.select(F.lit("map").alias("map_id"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.pow(F.col("x") - F.col("y"), F.lit(2.0)).alias("cost"))
    found = auction.auction(costs, epsilon=0.03)
    proven = auction.gap(costs, found).select((F.col("gap") < 1).alias("proven"))
    return found.agg(F.countDistinct("i", "j").alias("pairs"), F.sum("cost").alias("cost")).join(proven)


#: What every customer had ordered by each day of an order, as a run's history; asked for at the end of each year.
SPENT = """sn AS (SELECT o_custkey AS run_id, CAST(date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS INT) AS iteration, sum(o_totalprice) AS value FROM orders GROUP BY ALL),
  aq AS (SELECT DISTINCT run_id, CAST(365 * y.range AS INT) AS iteration FROM sn, range(1, 8) y)"""


def _spent(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    orders = X.table(spark, sf_dir, "orders")
    snaps = orders.groupBy(F.col("o_custkey").alias("run_id"), F.date_diff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).alias("iteration")).agg(F.sum("o_totalprice").alias("value"))
    asked = snaps.select("run_id").distinct().withColumn("iteration", F.explode(F.array(*(F.lit(365 * y) for y in range(1, 8)))))
    return snaps, asked


@query(f"WITH {SPENT} SELECT aq.run_id, aq.iteration, sn.iteration AS recorded, round(sn.value, 2) + 0.0 AS value FROM aq ASOF JOIN sn ON aq.run_id = sn.run_id AND aq.iteration >= sn.iteration")
def history_as_of(spark, sf_dir):
    """Each customer's last order at or before the end of each year; before the first there is none."""
    snaps, asked = _spent(spark, sf_dir)
    return history.as_of(snaps, asked, ["run_id"]).select("run_id", "iteration", "recorded", r("value", 2).alias("value"))


@query(f"""WITH {SERIES}, l AS (UNPIVOT (SELECT iteration, mean_log_error, max_log_error FROM sr) ON mean_log_error, max_log_error INTO NAME variable VALUE value)
  SELECT iteration, variable, round(value, 4) + 0.0 AS value, round(value - lag(value) OVER (PARTITION BY variable ORDER BY iteration), 4) + 0.0 AS change FROM l""")
def history_by_variable(spark, sf_dir):
    """A run's errors in long form, and how they changed from step to step."""
    long = history.series(_series(spark, sf_dir), ["iteration"], ["mean_log_error", "max_log_error"])
    return history.changes(long, []).select("iteration", "variable", r("value").alias("value"), r("change").alias("change"))


@query("SELECT asked, recorded, TRUE AS moved, TRUE AS as_recorded, 25 AS regions FROM (VALUES (1, 1), (5, 1), (7, 6), (12, 11)) t(asked, recorded)")
def flow_as_of(spark, sf_dir):
    """A moving map with snapshots at steps 1, 6 and 11, asked at others: each answer is the last snapshot before, and areas have moved by then."""
    found = cartograms.flow(X.nation_map(spark, sf_dir), options=flow.Options(grid_size=64, n_iter=14, mean_tol=1e-9, max_tol=1e-9, stall_patience=None, snapshot_every=5))
    held = found.at(1, 5, 7, 12).join(found.snapshots.select(F.col("iteration").alias("recorded"), "region_id", F.col("geom").alias("then")), ["recorded", "region_id"])
    return held.groupBy(F.col("iteration").alias("asked"), "recorded").agg((F.max(F.abs(G.area(F.col("geom")) - 1)) > 1e-3).alias("moved"), F.bool_and(F.col("geom") == F.col("then")).alias("as_recorded"), F.count("*").cast("int").alias("regions"))


@query(BOX + " SELECT CAST(region_id AS BIGINT) AS region_id, 2 AS runs, TRUE AS same, TRUE AS moved FROM nm")
def workflow_continued(spark, sf_dir):
    """A workflow saved after its first run, loaded and gone on with: the same shapes as without the stop."""
    first = flow.Options(grid_size=64, n_iter=6, mean_tol=1e-9, max_tol=1e-9, velocity_mod=raster.Pipeline(raster.VelocitySmooth(0.2)), prescale_components=False)
    work, path = cartograms.Workflow(X.nation_map(spark, sf_dir)), files.scratch(spark)
    work.morph(first)
    work.save(path)
    again = cartograms.Workflow.load(spark, path)
    for w in (work, again):
        w.morph(w.options[-1], n_iter=4)
    held = work.table().select("region_id", F.col("geom").alias("a")).join(again.table().select("region_id", F.col("geom").alias("b")), "region_id")
    return held.select("region_id", F.lit(len(again.results)).alias("runs"), (F.col("a") == F.col("b")).alias("same"), (F.abs(G.area(F.col("b")) - 1) > 1e-9).alias("moved"))


@query(BOX + """, t AS (SELECT 'nations' AS name, CAST(region_id AS BIGINT) AS id, value FROM nm UNION ALL SELECT 'orders', o_orderkey, o_totalprice FROM orders) SELECT name, count(*) AS rows, round(sum(value), 2) + 0.0 AS total, 0.25::DOUBLE AS dt, 'square' AS symbol, 2 AS saves FROM t GROUP BY 1""")
def saved_runs(spark, sf_dir):
    """Two saves of two tables with options: the last one comes back whole, with its options."""
    path = files.scratch(spark)
    nations = X.nation_values(spark, sf_dir).select(F.col("region_id").cast("long").alias("id"), "value")
    orders = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    manifest.save_run(path, {"nations": nations.limit(1)}, options=flow.Options())
    manifest.save_run(path, {"nations": nations, "orders": orders}, options=flow.Options(dt=0.25), style={"symbol": "square"})
    tables, told = manifest.load_run(spark, path)
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows"), r(F.sum("value"), 2).alias("total")).select(F.lit(name).alias("name"), "rows", "total", F.lit(told["options"].dt).alias("dt"), F.lit(told["style"]["symbol"]).alias("symbol"), F.lit(len(manifest.numbers(spark, path))).alias("saves"))
        out = one if out is None else out.unionByName(one)
    return out


#: The equal-area projection of longitudes and latitudes, and areas of belts, by the ellipsoid's own formulas.
ALBERS = """e AS (SELECT sqrt((2 - 1 / 298.257222101::DOUBLE) / 298.257222101::DOUBLE) AS e), p AS (SELECT *, e * e AS e2 FROM e),
  st2 AS (SELECT k, lat, cos(radians(lat)) / sqrt(1 - e2 * sin(radians(lat)) ** 2) AS m, (1 - e2) * (sin(radians(lat)) / (1 - e2 * sin(radians(lat)) ** 2) - ln((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat)))) / (2 * e)) AS q
    FROM p, (VALUES (0, 40.0::DOUBLE), (1, 20.0), (2, 60.0)) t(k, lat)),
  cn AS (SELECT (a.m ** 2 - b.m ** 2) / (b.q - a.q) AS n, a.m ** 2 AS mm, a.q AS qa, o.q AS qo FROM st2 a, st2 b, st2 o WHERE a.k = 1 AND b.k = 2 AND o.k = 0), cc AS (SELECT *, mm + n * qa AS c FROM cn)"""


def _in_degrees(spark, sf_dir, steps: int = 1) -> DataFrame:
    """Nations as boxes of three by two degrees, with points along their sides."""
    n = F.col("region_id")
    x0, y0 = -110.0 + 3 * (n % 5), 30.0 + 2 * F.floor(n / 5)
    along = [k / steps for k in range(steps)]
    pts = [*((t, 0.0) for t in along), *((1.0, t) for t in along), *((1 - t, 1.0) for t in along), *((0.0, 1 - t) for t in along), (0.0, 0.0)]
    # A list of places put at each nation, not a literal for every point of every one.
    places = F.transform(F.array(*(G.point(a, b) for a, b in pts)), lambda p: G.point_of(x0 + 3 * p["x"], y0 + 2 * p["y"]))
    return X.nation_values(spark, sf_dir).withColumn("geom", G.geom("Polygon", G.ring(places)))


@query(f"""WITH {X.NATION}, {ALBERS}, g AS (SELECT region_id, -110.0 + 3 * x0 AS lon, 30.0 + 2 * y0 AS lat FROM nm),
  h AS (SELECT *, (1 - e2) * (sin(radians(lat)) / (1 - e2 * sin(radians(lat)) ** 2) - ln((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat)))) / (2 * e)) AS q,
    (1 - e2) * (sin(radians(lat + 2)) / (1 - e2 * sin(radians(lat + 2)) ** 2) - ln((1 - e * sin(radians(lat + 2))) / (1 + e * sin(radians(lat + 2)))) / (2 * e)) AS q2 FROM g, p),
  k AS (SELECT *, 6378137 * sqrt(c - n * q) / n AS rho, 6378137 * sqrt(c - n * qo) / n AS rho0, n * radians(lon + 96) AS t FROM h, cc)
  SELECT region_id, round(rho * sin(t), 0) + 0.0 AS x, round(rho0 - rho * cos(t), 0) + 0.0 AS y, round(6378137.0 ** 2 * radians(3) * (q2 - q) / 2 / 1e10, 2) + 0.0 AS area FROM k""")
def census_projection(spark, sf_dir):
    """Boxes of longitude and latitude: where their corners come to lie, and that they keep the areas that they have on the ellipsoid."""
    held = census.projected(_in_degrees(spark, sf_dir, 24))
    first = F.col("geom.rings")[0]["pts"][0]
    return held.select("region_id", r(first["x"], 0).alias("x"), r(first["y"], 0).alias("y"), r(G.area(F.col("geom")) / 1e10, 2).alias("area"))


CODES = [x[0] for x in census.states() if x[0] not in ("02", "15", "72")]


@query(f"""WITH {X.NATION}, {ALBERS}, sc(k, code, letters, name, region, division) AS (VALUES {", ".join(f"({k}, '{x[0]}', '{x[1]}', '{x[2]}', '{x[3]}', '{x[4]}')" for k, x in enumerate(y for y in census.states() if y[0] in CODES))}),
  pp AS (SELECT c_nationkey AS region_id, count(*) AS people, count(*) FILTER (c_acctbal < 0) AS poor FROM customer GROUP BY 1),
  h AS (SELECT nm.region_id, (1 - e2) * (sin(radians(32 + 2 * y0)) / (1 - e2 * sin(radians(32 + 2 * y0)) ** 2) - ln((1 - e * sin(radians(32 + 2 * y0))) / (1 + e * sin(radians(32 + 2 * y0)))) / (2 * e)) - (1 - e2) * (sin(radians(30 + 2 * y0)) / (1 - e2 * sin(radians(30 + 2 * y0)) ** 2) - ln((1 - e * sin(radians(30 + 2 * y0))) / (1 + e * sin(radians(30 + 2 * y0)))) / (2 * e)) AS belt FROM nm, p)
  SELECT nm.region_id, letters AS state_abbreviation, sc.name AS state_name, region, division, round(people / 1e6, 6) + 0.0 AS millions, round(1e4 * people / (6378137.0 ** 2 * radians(3) * belt / 2 / 1e6), 2) + 0.0 AS per_ten_thousand, round(poor / people, 4) + 0.0 AS below
  FROM nm JOIN sc ON sc.k = nm.region_id JOIN pp ON pp.region_id = nm.region_id JOIN h ON h.region_id = nm.region_id WHERE nm.region_id % 7 <> 6""")
def census_of_customers(spark, sf_dir):
    """Nations as states, customers as people: lookups by code, shares, and density by projected area; every seventh row is Alaska's and goes."""
    people = X.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("region_id")).agg(F.count("*").alias("Population"), F.count_if(F.col("c_acctbal") < 0).alias("Below Poverty Level"), F.count_if(F.col("c_acctbal") >= 0).alias("Above Poverty Level"))
    code = F.when(F.col("region_id") % 7 == 6, F.lit("02")).otherwise(F.array(*map(F.lit, CODES))[F.col("region_id")])
    raw = _in_degrees(spark, sf_dir, 48).join(people, "region_id").withColumns({"STATE": code, "Total Poverty": F.col("Population")})
    held = census.census_map(raw, poverty=True)
    return held.select("region_id", F.col("State Abbreviation").alias("state_abbreviation"), F.col("State Name").alias("state_name"), F.col("Region").alias("region"), F.col("Division").alias("division"), r("Population (Millions)", 6).alias("millions"), r(1e4 * F.col("Population Density"), 2).alias("per_ten_thousand"), r(F.col("Below Poverty Level %")).alias("below"))


# What a moving flow tells, held against what its shapes say.

MOVING = flow.Options(grid_size=64, n_iter=12, mean_tol=1e-9, max_tol=1e-9, stall_patience=None, snapshot_every=4, save_internals=True)


@query(BOX + """, s AS (SELECT i.range AS seq FROM range(0, 5) i) SELECT CAST(region_id AS BIGINT) AS region_id, CAST(seq AS INT) AS seq, TRUE AS on_border, CAST(x0 + CASE WHEN seq IN (1, 2) THEN 1 ELSE 0 END AS DOUBLE) AS x, CAST(y0 + CASE WHEN seq IN (2, 3) THEN 1 ELSE 0 END AS DOUBLE) AS y, TRUE AS moved FROM nm, s""")
def flow_points_on_borders(spark, sf_dir):
    """Points put on the corners of regions end where the corners end, and most corners move."""
    regions = X.nation_map(spark, sf_dir)
    corners = vertices.explode_vertices(regions.select("region_id", "geom"))
    points = corners.select((F.col("region_id") * 10 + F.col("seq")).cast("long").alias("point_id"), "x", "y")
    found = cartograms.flow(regions, options=MOVING, points=points)
    ended = vertices.explode_vertices(found.regions.select("region_id", "geom")).select((F.col("region_id") * 10 + F.col("seq")).alias("point_id"), F.col("x").alias("ex"), F.col("y").alias("ey"))
    held = found.points.join(ended, "point_id").join(points.select("point_id", F.col("x").alias("bx"), F.col("y").alias("by")), "point_id")
    near = (F.hypot(F.col("x") - F.col("ex"), F.col("y") - F.col("ey")) < 1e-9).alias("on_border")
    most = held.agg((F.count_if(F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by")) > 1e-3) > 100).alias("moved"))
    return held.select(F.expr("point_id div 10").alias("region_id"), F.expr("int(point_id % 10)").alias("seq"), near, F.col("bx").alias("x"), F.col("by").alias("y")).join(most)


@query("SELECT iteration, TRUE AS same, CAST(25 AS BIGINT) AS regions, TRUE AS fell FROM (VALUES (1), (5), (9), (12)) t(iteration)")
def flow_errors_of_snapshots(spark, sf_dir):
    """Errors that a run tells for an iteration are those of its shapes then, and they are below those of the first snapshot."""
    # Orders of some nations count for more, so that there is something to level at every scale.
    regions = X.nation_map(spark, sf_dir).withColumn("value", F.col("value") * (1 + F.col("region_id") % 4))
    found = cartograms.flow(regions, options=MOVING)
    wanted = measure.original_state(regions).select(F.col("region_id").cast("long").alias("region_id"), "target_area")
    error = F.abs(F.log2(G.area(F.col("geom")) / F.col("target_area")))
    own = found.snapshots.join(wanted, "region_id").groupBy("iteration").agg(F.avg(error).alias("mean"), F.max(error).alias("max"), F.count("*").alias("regions"))
    told = found.errors_at(1, 5, 9, 12).join(own, "iteration")
    before = F.first("mean").over(Window.partitionBy("map_id").orderBy("iteration"))  # four snapshots
    same = (F.abs(F.col("mean") - F.col("mean_log_error")) < 1e-6) & (F.abs(F.col("max") - F.col("max_log_error")) < 1e-6)
    return told.select("iteration", same.alias("same"), "regions", ((F.col("iteration") == 1) | (F.col("mean") < before)).alias("fell"))


@query(BOX + """, gc AS (SELECT CAST(range // 64 AS INT) AS iy, CAST(range % 64 AS INT) AS ix, -2.5 + (range % 64 + 0.5) * 10 / 64 AS x, -2.5 + (range // 64 + 0.5) * 10 / 64 AS y FROM range(0, 4096))
  SELECT iy, ix, round(coalesce(value, (SELECT sum(value) / 25 FROM nm)) / 1e6, 4) + 0.0 AS rho, coalesce(region_id, -1) AS geom_idx FROM gc LEFT JOIN nm ON x > x0 AND x < x0 + 1 AND y > y0 AND y < y0 + 1""")
def flow_fields_of_orders(spark, sf_dir):
    """The density field that a flow starts from is that of the nations' orders, cell by cell."""
    held = cartograms.flow(X.nation_map(spark, sf_dir), options=MOVING).fields.where("iteration = 1")
    return held.select("iy", "ix", r(F.col("rho") / 1e6).alias("rho"), "geom_idx")


@query(BOX + " SELECT CAST(region_id AS BIGINT) AS region_id, 3 AS ran, 1 AS kept, TRUE AS first_again, TRUE AS moved, 1.0::DOUBLE AS area_after_reset FROM nm")
def workflow_popped(spark, sf_dir):
    """Three runs, two taken back: the shapes are those of the first; then all are, and the map is as it was."""
    work = cartograms.Workflow(X.nation_map(spark, sf_dir))
    for _ in range(3):
        work.morph(MOVING, n_iter=3, save_internals=False)
    ran, first = len(work.results), work.results[0].regions.select("region_id", F.col("geom").alias("then"))
    work.pop(2)
    held = work.table().select("region_id", "geom").join(first, "region_id").select("region_id", F.lit(ran).alias("ran"), F.lit(len(work.results)).alias("kept"), (F.col("geom") == F.col("then")).alias("first_again"), (F.abs(G.area(F.col("geom")) - 1) > 1e-6).alias("moved"))
    work.reset()
    return held.join(work.table().select("region_id", r("area").alias("area_after_reset")), "region_id")


@query("SELECT CAST(25 AS BIGINT) AS cells, 55.9::DOUBLE AS area, TRUE AS evener, TRUE AS centred")
def voronoi_exact_of_an_uneven_map(spark, sf_dir):
    """Exact Lloyd steps on columns of uneven width: cells tile the map, come out evener, and seeds end in their cells' centres, which none did."""
    n = F.col("region_id")
    wide = lambda k: F.pow(k.cast("double"), F.lit(1.5))
    y = F.floor(n / 5).cast("double")
    uneven = X.nation_map(spark, sf_dir).withColumn("geom", G.box(wide(n % 5), y, wide(n % 5 + 1), y + 1))
    found = cartograms.voronoi_result(uneven, voronoi.Options(n_iter=150, exact=True))
    cv = lambda df, c: df.agg((F.stddev_pop(c) / F.avg(c)).alias("cv"))
    after = found.cells.withColumn("area", G.area(F.col("geom"))).withColumn("c", G.centroid(F.col("geom")))
    before = cv(uneven.withColumn("area", G.area(F.col("geom"))), "area").select(F.col("cv").alias("was"))
    far = after.agg(F.count("*").alias("cells"), r(F.sum("area"), 1).alias("area"), (F.max(F.hypot(F.col("c.x") - F.col("x"), F.col("c.y") - F.col("y"))) < 0.05).alias("centred"))
    return far.join(cv(after, "area")).join(before).select("cells", "area", (F.col("cv") < 0.9 * F.col("was")).alias("evener"), "centred")
