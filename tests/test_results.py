"""Larger forms of the operators, and what results tell beside their maps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealmap import fixtures as X
from arealmap.functions import geometry as G
from arealmap.kernels import planar as P
from arealmap.kernels import raster, voronoi
from arealmap.operators import adjacency, fields, grids, isohedral, tilings
from arealmap.plans import cartograms


def test_components_in_rounds(spark):
    """Chains, a star and single nodes."""
    edges = [(i, i + 1) for i in range(0, 40)] + [(50, 50 + k) for k in range(1, 9)]
    found = adjacency.components(spark.range(70).withColumnRenamed("id", "region_id"), spark.createDataFrame(edges, "i long, j long"))
    assert {x.region_id: x.component for x in found.collect()} == {i: 0 if i <= 40 else 50 if 50 <= i <= 58 else i for i in range(70)}


def test_boxes_of_many_sizes(spark):
    """One huge box among small ones: each pair is found once."""
    rng = np.random.default_rng(1)
    at, side = rng.uniform(0, 30, (150, 2)), np.where(np.arange(150) % 50 == 0, 25.0, rng.uniform(0.1, 2, 150))
    boxes = [(int(i), float(x), float(y), float(x + s), float(y + s)) for i, ((x, y), s) in enumerate(zip(at, side, strict=True))]
    rows = spark.createDataFrame(boxes, "region_id long, xmin double, ymin double, xmax double, ymax double").select("region_id", F.struct("xmin", "ymin", "xmax", "ymax").alias("b"))
    found = [(x.i, x.j) for x in adjacency.near_boxes(rows.withColumn("tol", F.lit(0.01))).collect()]
    near = lambda a, b: a[1] <= b[3] + 0.01 and b[1] <= a[3] + 0.01 and a[2] <= b[4] + 0.01 and b[2] <= a[4] + 0.01
    assert sorted(found) == [(a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and near(a, b)]


def test_nearest_seeds_by_buckets(spark):
    rng = np.random.default_rng(2)
    pts = rng.uniform(0, 5, (40, 2)) ** 1.5
    seeds = spark.createDataFrame([(int(i), float(x), float(y)) for i, (x, y) in enumerate(pts)], "site_id long, x double, y double")
    cells = grids.Grid.from_bounds((0.0, 0.0, 14.0, 9.0), 24).cells(spark)
    for x in fields.nearest_labels(cells, seeds, listed=3).collect():
        d = ((pts - (x.x, x.y)) ** 2).sum(1)
        assert d[x.label] == pytest.approx(d.min())


def test_weighted_and_offset_seeds_by_buckets(spark):
    """Weights over many orders, equal seeds, and one seed that outweighs all: as a full scan has it."""
    rng = np.random.default_rng(3)
    pts = np.concatenate([rng.uniform(0, 5, (60, 2)), [[1.0, 1.0]] * 3, [[40.0, 40.0]]])
    w, o = np.concatenate([2.0 ** rng.integers(-6, 4, 63), [5000.0]]), np.concatenate([rng.normal(0, 2, 63), [30.0]])
    seeds = spark.createDataFrame([(int(i), float(x), float(y), float(a), float(b)) for i, ((x, y), a, b) in enumerate(zip(pts, w, o, strict=True))], "site_id long, x double, y double, weight double, offset double")
    cells = grids.Grid.from_bounds((0.0, 0.0, 14.0, 9.0), 16).cells(spark)
    for weighted, offset in ((True, False), (False, True), (True, True)):
        found = fields.nearest_labels(cells, seeds, weighted, offset, listed=0).collect()
        assert len(found) == cells.count()
        for x in found:
            d = ((pts - (x.x, x.y)) ** 2).sum(1) / (w if weighted else 1) - (o if offset else 0)
            assert x.label == d.argmin()


def test_pixels_to_polygons():
    """Rings round pixels: a hole, pieces that touch at a corner only, and the whole area."""
    label = np.array([[0, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 0, 1, 1]])
    rings = voronoi.outlines(label == 0)
    signed = sorted(round(float((p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]).sum() / 2), 9) for p in rings)
    assert signed == [-1.0, 10.0 + 1.0 - 0.0]
    assert len(voronoi.outlines(np.eye(3, dtype=bool))) == 3
    cells = voronoi.raster_cells(np.repeat(np.repeat(label, 6, 0), 6, 1), np.linspace(0, 4, 25), np.linspace(0, 4, 25), 2)
    assert sum(P.area(c) for c in cells) == pytest.approx(16) and P.area(cells[0]) == pytest.approx(10, abs=0.5)
    assert voronoi.raster_pairs(np.array([[0, 1], [-1, 2]])) == [(0, 1), (1, 2)]


def test_weighted_cells_follow_the_weights():
    seeds = np.array([[1.0, 2.5], [4.0, 2.5]])
    square = [(0, 1, np.array([(0, 0), (5, 0), (5, 5), (0, 5), (0, 0)], float))]
    field, _ = voronoi.solve(seeds, square, voronoi.Options(n_iter=60, resolution=80), weights=[1.0, 4.0])
    small, large = (P.area(c) for c in field.cells())
    assert small + large == pytest.approx(25) and large / small == pytest.approx(field.counts[1] / field.counts[0], rel=0.05)


def test_decays_without_a_border():
    grid, ones = grids.Grid.from_bounds((0, 0, 4, 4), 8), np.ones((8, 8))
    inside, outside = np.zeros((8, 8), int), np.full((8, 8), -1)
    assert (raster.BoundaryDecay(1.0, 0.3)(ones, ones, grid, inside)[0] == 1).all()
    assert raster.BoundaryDecay(1.0, 0.3)(ones, ones, grid, outside)[0] == pytest.approx(0.3)
    assert (raster.BoundaryNormalDecay(1.0)(ones, ones, grid, inside)[0] == 1).all()


def test_tilings_to_files_and_by_name(tmp_path):
    tile = isohedral.Isohedral("ih46", curves={1: ((0.2, 0.1),)})
    tile.save(str(tmp_path / "tile.json"))
    assert isohedral.Isohedral.load(str(tmp_path / "tile.json")).tile() == pytest.approx(tile.tile())
    assert isinstance(tilings.resolve("IH41"), isohedral.Isohedral) and tilings.resolve("square") is tilings.SQUARE
    with pytest.raises(ValueError):
        tilings.resolve("none such")


def test_symbols_of_ones_own():
    assert np.array(G.tile_symbol([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)])) == pytest.approx(np.array([(-1, -1), (1, -1), (1, 1), (-1, 1)]) * 0.125**0.5)
    with pytest.raises(ValueError):
        G.tile_symbol([(0, 0), (1, 1), (2, 2)])
    with pytest.raises(ValueError):
        G.add_symbol("circle", [(0.0, 0.0)])


def test_voronoi_result(spark, sf_dir):
    regions = X.nation_map(spark, sf_dir)
    found = cartograms.voronoi_result(regions, voronoi.Options(n_iter=6, resolution=40, repair_every=3, snapshot_every=2))
    assert {x.iteration for x in found.snapshots.collect()} == {1, 3, 5} and found.convergence.count() == 6
    assert {x.what for x in found.repair_report(regions, found.cells).collect()} == {"violated", "orientation"}
    with pytest.raises(ValueError):
        cartograms.symbol_cartogram(regions, "value", "none such")


@pytest.mark.parametrize("parts", [1, 3400, 300_000, 330_000])
def test_grids_of_narrow_part_maps(spark, tmp_path, parts):
    """Maps so long that no count near the short side's is over 4 have no levels, as in SQL."""
    import duckdb

    from arealmap import queries as maps

    spark.range(7, 7 + parts, 1, 2).select(F.col("id").alias("p_partkey"), F.lit(1).alias("p_size"), F.lit(1.0).alias("p_retailprice")).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got = sorted(tuple(x) for x in maps.multilevel_grid_sizes(spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(maps.ORACLES["multilevel_grid_sizes"]).fetchall())
    assert bool(got) == (parts < 320_000)


def test_flow_over_levels_of_a_narrow_map(spark):
    strip = spark.createDataFrame([(1, 1.0, 0.0), (2, 2.0, 500.0)], "region_id long, value double, x double")
    strip = strip.select("region_id", "value", G.box(F.col("x"), F.lit(0.0), F.col("x") + 500.0, F.lit(1.0)).alias("geom"))
    with pytest.raises(ValueError, match="too narrow"):
        cartograms.multiresolution(strip, min_resolution=64)
