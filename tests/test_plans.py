"""Readers, writers, workflows, styles, frames and streams."""

import json

import pytest
from pyspark.sql import functions as F

from arealmap import fixtures as X
from arealmap.functions import geometry as G
from arealmap.kernels import flow
from arealmap.operators import adjacency, fields, frames, isohedral, measure, styling, tilings, vertices
from arealmap.operators.grids import Grid
from arealmap.plans import cartograms
from arealmap.sources import files
from arealmap.streaming import values as stream


def square(x0, y0, x1, y1):
    return [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]


def test_geojson(spark, tmp_path):
    shapes = [("Polygon", [square(0, 0, 2, 2), square(0.5, 0.5, 1, 1)]), ("MultiPolygon", [[square(0, 0, 1, 1)], [square(3, 3, 4, 5)]]), ("Point", [1.0, 2.0]), ("LineString", [[0, 0], [1, 1]])]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": k, "pop": i}, "geometry": {"type": k, "coordinates": c}} for i, (k, c) in enumerate(shapes)]}
    (tmp_path / "map.geojson").write_text(json.dumps(doc))
    got = files.read_geojson(spark, str(tmp_path / "map.geojson"), "name string, pop long")
    assert [(x.region_id, x.name, x.pop, x.a) for x in got.select("*", G.area(F.col("geom")).alias("a")).orderBy("region_id").collect()] == [(0, "Polygon", 0, 3.75), (1, "MultiPolygon", 1, 3.0), (2, "Point", 2, 0.0), (3, "LineString", 3, 0.0)]
    polygons = got.where("pop < 2")
    files.write_geojson(polygons, str(tmp_path / "lines"))
    back = files.read_feature_lines(spark, str(tmp_path / "lines"), "region_id long, name string, pop long")
    assert sorted(x.a for x in back.select(G.area(F.col("geom")).alias("a")).collect()) == [3.0, 3.75]


def test_population_and_census(spark, tmp_path):
    (tmp_path / "p.csv").write_text("year,state_fips,state_name,state_abbr,population\n1990,01,Alabama,AL,4040587\n")
    assert files.read_population(spark, str(tmp_path / "p.csv")).first().state_fips == "01"
    raw = spark.createDataFrame([("01", 2_000_000, 4e9, 500_000), ("11", 600_000, 2e8, 1), ("02", 1, 1.0, 1)], "state_fips string, population long, land_area_m2 double, black long")
    got = files.census_columns(raw, ["black"]).orderBy("state_fips").collect()
    assert [x.state_fips for x in got] == ["01", "11"]
    assert (got[0]["Population (Millions)"], got[0]["Population Density"], got[0]["black %"]) == (2.0, 500.0, 25.0)
    assert files.census_columns(raw, level="county").count() == 1


def test_tables_documents_and_history(spark, sf_dir, tmp_path):
    regions = X.nation_lshape(spark, sf_dir).select("region_id", "geom")
    steps = spark.createDataFrame([(1, 0.5), (2, 0.2)], "iteration int, mean double")
    for run in ("a", "b"):
        files.save_tables({"regions": regions, "steps": steps}, str(tmp_path / "runs"), run)
    assert files.load_table(spark, str(tmp_path / "runs"), "regions", "b").count() == 25 and files.load_table(spark, str(tmp_path / "runs"), "steps").count() == 4
    files.save_document(regions, steps, str(tmp_path / "doc"), status="converged", n=2)
    facts, back, series = files.load_document(spark, str(tmp_path / "doc"), "region_id int", "iteration int, mean double", "status string, n int")
    assert facts.first().status == "converged" and series.count() == 2
    area = lambda df: df.agg(F.sum(G.area(F.col("geom")))).first()[0]
    assert area(back) == pytest.approx(area(regions))
    files.export_history(steps, str(tmp_path / "h.csv"))
    files.export_history(steps.limit(0), str(tmp_path / "none.csv"))
    files.export_history(steps, str(tmp_path / "h.json"), "json")
    assert spark.read.csv(str(tmp_path / "h.csv"), header=True).count() == 2 and not (tmp_path / "none.csv").exists()
    with pytest.raises(ValueError):
        files.export_history(steps, str(tmp_path / "x"), "xml")


def test_workflow(spark, sf_dir):
    work = cartograms.Workflow(X.nation_map(spark, sf_dir))
    with pytest.raises(ValueError):
        work.convergence()
    before = work.table().agg(F.max(F.abs("_morph_error_pct"))).first()[0]
    work.morph(flow.Options(grid_size=64))
    after = work.table().agg(F.max(F.abs("_morph_error_pct"))).first()[0]
    assert after < before
    work.pop()
    with pytest.raises(ValueError):
        work.pop()
    work.reset()
    assert work.state().count() == 25


def test_points_ride_along(spark, sf_dir):
    found = cartograms.flow(X.nation_map(spark, sf_dir), options=flow.Options(grid_size=64, n_iter=5, mean_tol=1e-9, max_tol=1e-9), points=X.user_points(spark, sf_dir))
    moved = found.points.join(X.user_points(spark, sf_dir).withColumnsRenamed({"x": "x0", "y": "y0"}), "point_id")
    assert moved.where(F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0")) > 1e-6).count() > 0


def test_several_maps_at_once(spark, sf_dir):
    one = X.nation_map(spark, sf_dir)
    two = one.withColumn("map_id", F.lit("a")).unionByName(one.withColumn("map_id", F.lit("b")).withColumn("value", F.lit(1.0)))
    ends = {x.map_id: x.n for x in cartograms.flow(two, options=flow.Options(grid_size=64)).convergence.groupBy("map_id").agg(F.max("iteration").alias("n")).collect()}
    assert ends["b"] == 1 and ends["a"] > 1
    state = measure.original_state(two)
    assert state.where("map_id = 'b'").agg(F.max(F.abs("log_error"))).first()[0] == pytest.approx(0)


def test_fractions_refuse(spark):
    df = spark.createDataFrame([(1, 1.0, -1.0, "x"), (2, 0.0, 0.0, "y")], "region_id long, a double, b double, c string")
    for columns, how in ((["a", "b"], "sum"), (["zzz"], None), (["a"], "row"), (["c"], None), (["a"], "most")):
        with pytest.raises(ValueError):
            measure.fractions(df, columns, how)
    with pytest.raises(ValueError):
        measure.fractions(spark.createDataFrame([(1, 0.9, 0.9)], "region_id long, a double, b double"), ["a", "b"])
    with pytest.raises(ValueError):
        measure.fractions(df.where("a = 0").select("region_id", "a"), ["a"], "sum")


def test_layout_input(spark, sf_dir):
    regions = X.nation_map(spark, sf_dir).withColumn("value", F.when(F.col("region_id") > 0, F.col("value")))
    assert measure.layout_input(regions, "value").count() == 24
    assert measure.layout_input(regions).count() == 25
    with pytest.raises(ValueError, match="not found"):
        measure.layout_input(regions, "nonexistent")
    with pytest.raises(ValueError, match="empty"):
        measure.layout_input(regions.limit(0), "value")
    with pytest.raises(ValueError):
        cartograms.layout(regions, "value", "no such layout")
    kept = cartograms.layout(regions, "value", "centroid")
    assert kept.agg(F.max(F.abs(F.col("x") - F.col("x0")))).first()[0] == 0


def test_styles(spark):
    layout = spark.createDataFrame([(i, float(i), 0.0, 0.5, float(i), 1.0) for i in range(4)], "region_id long, x double, y double, size double, x0 double, y0 double")
    rules = spark.createDataFrame(
        [(1, 0, "square", 0.5, None, None, {"a": "1", "b": "1"}), (1, 1, None, 0.5, 0.3, True, {"a": "2"}), (2, 0, "hexagon", None, None, True, None), (2, 1, "star", None, None, True, None)],
        "region_id long, seq int, symbol string, scale double, rotation double, reflection boolean, params map<string,string>",
    )
    got = {x.region_id: x for x in styling.overrides(layout, rules).collect()}
    assert (got[1].symbol, got[1].s_scale, got[1].s_rotation, got[1].s_reflection, got[1].params) == ("square", 0.25, 0.3, True, {"a": "2", "b": "1"})
    assert (got[2].symbol, got[2].s_reflection, got[0].symbol) == ("star", False, "circle")
    placed = styling.symbols(styling.overrides(layout, None, "square"), "square")
    areas = {round(x.a, 6) for x in placed.select(G.area(F.col("geom")).alias("a")).collect()}
    assert areas == {round(3.14159265 * 0.25, 6)}
    assert styling.displacement_metrics(placed).first().displacement_mean == 1.0
    assert styling.fit_scale("square", "circle", "area") == pytest.approx((1 / (3.14159265 / 4)) ** 0.5)
    assert styling.fit_scale("square", "diamond") == pytest.approx(1.0) and styling.fit_scale("square", "diamond", "fill") >= 1.0
    with pytest.raises(Exception, match="unknown symbol"):
        styling.symbols(styling.overrides(layout, None, "blob")).collect()


def test_frames(spark, sf_dir):
    falling = spark.createDataFrame([(0, 8.0), (1, 4.0), (2, 2.0), (3, 0.0)], "idx int, v double")
    got = [x.position for x in frames.linear_over(frames.progress(spark, 5), falling, decreasing=True).orderBy("frame").collect()]
    assert got == pytest.approx([0, 0.5, 1, 2, 3])
    held = [x.position for x in frames.hold(frames.progress(spark, 10), 2, 3).orderBy("frame").collect()]
    assert held[:3] == [0, 0, 0] and held[-1] == 1 and held == sorted(held)
    a = X.nation_map(spark, sf_dir).select(F.lit(0).alias("idx"), "region_id", "geom")
    b = a.select(F.lit(1).alias("idx"), "region_id", G.map_points(F.col("geom"), lambda p: G.point_of(p["x"] + 2, p["y"])).alias("geom"))
    shown = frames.region_frames(frames.progress(spark, 3).withColumnRenamed("progress", "position"), a.unionByName(b))
    assert [round(x.x, 6) for x in shown.groupBy("frame").agg(F.min(G.bounds(F.col("geom"))["xmin"]).alias("x")).orderBy("frame").collect()] == [0, 1, 2]


def test_vertices_refuse_unknown_kinds(spark):
    bad = spark.createDataFrame([(1,)], "region_id int").withColumn("geom", G.geom("Blob", G.ring(G.box_points(0, 0, 1, 1))))
    with pytest.raises(Exception, match="unsupported geometry kind"):
        vertices.explode_vertices(bad).collect()


def test_small_parts_go(spark):
    many = G.geom("MultiPolygon", G.ring(G.box_points(0, 0, 2, 2), 0), G.ring(G.box_points(0.1, 0.1, 0.2, 0.2), 0, -1), G.ring(G.box_points(5, 5, 5.1, 5.1), 1))
    df = spark.range(1).select(many.alias("geom"))
    size = lambda a, b: df.select(F.size(G.drop_small(F.col("geom"), a, b)["rings"])).first()[0]
    assert (size(0.5, 0.0), size(0.5, 0.5), size(0.0, 0.0), size(100.0, 100.0)) == (2, 1, 3, 1)


def test_density_variants(spark):
    regions = spark.range(2).select(F.col("id").alias("region_id"), F.when(F.col("id") == 0, 0.0).otherwise(2.0).alias("value"), G.box(F.col("id"), F.lit(0), F.col("id") + 1, F.lit(1)).alias("geom"))
    grid = Grid.from_bounds((0, 0, 2, 1), 4)
    plain = {(x.iy, x.ix): (x.rho, x.geom_idx) for x in fields.density_field(regions, grid).collect()}
    assert plain[0, 0] == (0.0, 0) and plain[1, 3] == (2.0, 1)
    other = {(x.iy, x.ix): x.rho for x in fields.density_field(regions, grid, zero_is_outside=True).collect()}
    assert other[0, 0] == 1.0
    with pytest.raises(ValueError):
        fields.precision([[1.0, 2.0], [2.0, 1.0]], 0.0)


def test_components_of_a_long_chain(spark):
    n = 40
    nodes = spark.range(n + 3).select(F.col("id").alias("region_id"))
    edges = spark.range(n - 1).select((F.col("id") + 1).alias("i"), F.col("id").alias("j"))
    got = {x.region_id: x.component for x in adjacency.components(nodes, edges).collect()}
    assert all(got[k] == 0 for k in range(n)) and got[n] == n


def test_tilings(spark):
    edge = tilings.adjacency(tilings.SQUARE.tiles(spark, (0.0, 0.0, 3.0, 3.0), tile_size=1.0, margin=0.0))
    assert edge.count() == 12
    assert tilings.adjacency(tilings.SQUARE.tiles(spark, (0.0, 0.0, 3.0, 3.0), tile_size=1.0, margin=0.0), "vertex").count() == 20
    turned = tilings.rotated(tilings.SQUARE.tiles(spark, (0.0, 0.0, 3.0, 3.0), tile_size=1.0, margin=0.0), 90.0)
    assert turned.agg(F.min("cx")).first()[0] == pytest.approx(-2.5)
    with pytest.raises(ValueError):
        tilings.resolve("pentagon")
    assert isohedral.find_types(4, "C") == ["ih46", "ih47"] and "3 corners" in isohedral.describe("ih84")
    bent = isohedral.Isohedral("ih41", curves={0: ((0.3, 0.2), (0.7, -0.1))})
    assert isohedral.Isohedral.from_dict(json.loads(json.dumps(bent.to_dict()))) == bent
    areas = bent.tiles(spark, tile_size=0.5).select(G.area(F.col("geom")).alias("a")).agg(F.min("a"), F.max("a")).first()
    assert areas[0] == pytest.approx(0.25) == areas[1]
    with pytest.raises(ValueError):
        isohedral.Isohedral("ih41", ((0, 0), (1, 0), (2, 2), (0, 1))).base()


def test_stream(spark, sf_dir, tmp_path):
    regions = X.nation_map(spark, sf_dir).select("region_id", "geom")
    rows = [(f"2024-01-01 0{h}:10:00", r, float(1 + r + h)) for h in range(3) for r in range(25)]
    spark.createDataFrame(rows, "t string, region int, v double").select(F.to_timestamp("t").alias("ts"), "region", "v").write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("ts timestamp, region int, v double").parquet(str(tmp_path / "in"))
    seen = []
    running = stream.stream_errors(regions, stream.windowed_values(events, "region", "v", "ts"), lambda df, epoch: seen.extend(df.select("map_id", "region_id", "log_error").collect()), str(tmp_path / "ck"))
    running.processAllAvailable()
    running.stop()
    assert len(seen) == 50 and len({x.map_id for x in seen}) == 2  # the last window is still open
