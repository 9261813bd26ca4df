"""Rasters, borders and walks as tables against plain programs, and several maps in one table."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arealmap import fixtures as X
from arealmap.functions import geometry as G
from arealmap.kernels import flow, shapes, voronoi
from arealmap.kernels import planar as P
from arealmap.operators import adjacency, borders, grids, rasters, walks
from arealmap.plans import cartograms


def ring(*pts):
    return {"part": 0, "sign": 1, "pts": [{"x": float(x), "y": float(y)} for x, y in [*pts, pts[0]]]}


def regions_of(spark, shapes_, map_id=None):
    rows = [(i, float(i + 1), P.to_geom(s)) for i, s in shapes_.items()]
    held = spark.createDataFrame(rows, f"region_id long, value double, geom {G.GEOM}")
    return held.withColumn("map_id", F.lit(map_id)) if map_id else held


def square(x, y, side=1.0):
    return [(0, 1, np.array([(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)], float))]


def test_raster_of_odd_polygons(spark):
    """Triangles, a star, a ring with a hole, two parts; centres on borders, corners and tips lie in no region."""
    turn = np.linspace(0, 2 * np.pi, 11)[:-1]
    star = np.array([(4 + r * np.sin(t), 4 + r * np.cos(t)) for t, r in zip(turn, [3.0, 1.2] * 5, strict=True)])
    held = {
        0: [(0, 1, np.array([(0, 0), (6, 0), (0, 6), (0, 0)], float))],
        1: [(0, 1, np.vstack([star, star[:1]]))],
        2: [(0, 1, np.array([(6, 6), (6, 11), (11, 11), (11, 6), (6, 6)], float)), (0, -1, np.array([(7, 7), (9, 8), (8, 9), (7, 7)], float))],
        3: [*square(0, 8, 2.0), (1, 1, np.array([(3, 9), (5, 9), (4, 11), (3, 9)], float))],
    }
    grid = grids.Grid.from_size_and_spacing((24, 24), 0.5, (6.25, 6.25))  # centres on whole and half numbers
    found = {(r.region_id, r.iy, r.ix) for r in rasters.inside_cells(regions_of(spark, held), grid).collect()}

    def on_border(rings, x, y):
        for _, _, p in rings:
            for (ax, ay), (bx, by) in zip(p[:-1], p[1:], strict=True):
                if abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) < 1e-12 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                    return True
        return False

    want = set()
    for k, s in held.items():
        for iy in range(24):
            for ix in range(24):
                x, y = grid.xmin + (ix + 0.5) * grid.dx, grid.ymin + (iy + 0.5) * grid.dy
                if P.contains(s, np.array([x]), np.array([y]))[0] and not on_border(s, x, y):
                    want.add((k, iy, ix))
    assert found == want and len(want) > 150
    top = {(r.iy, r.ix): r.region_id for r in rasters.rasterize(regions_of(spark, held), grid).collect()}
    assert top == {(iy, ix): max(k for k, a, b in want if (a, b) == (iy, ix)) for _, iy, ix in want}


def test_density_of_nothing_and_of_flat_regions(spark):
    grid = grids.Grid.from_bounds((0.0, 0.0, 2.0, 2.0), 4)
    flat = regions_of(spark, {0: square(0, 0), 1: [(0, 1, np.array([(1, 1), (2, 2), (1, 1), (1, 1)], float))]})
    cells = rasters.density_field(flat, grid).collect()
    assert len(cells) == 16 and {c.geom_idx for c in cells} == {0, -1}


def test_chains(spark):
    """Rings and open chains of many lengths, single ids among them."""
    links, want, at = [], {}, 0
    rng = np.random.default_rng(4)
    for n, closed in [(1, False), (1, True), (2, False), (3, True), (17, False), (33, True), (5, False), (64, True)]:
        ids = (rng.permutation(n) + at).tolist()
        at += n
        for k, i in enumerate(ids):
            links.append((i, ids[k + 1] if k + 1 < n else ids[0] if closed else None))
            want[i] = (None, None, min(ids)) if closed else (ids[-1], n - 1 - k, None)
    found = borders.chained(spark.createDataFrame(links, "id long, next long")).collect()
    got = {r.id: (r.last, r.left if r.last is not None else None, r.low if r.last is None else None) for r in found}
    assert got == want


def test_outline_of_pieces_that_touch(spark):
    """A checkerboard: each square is a ring of its own, and a square inside a frame is a piece inside a hole."""
    board = {k: square(k % 3, k // 3) for k in range(9) if k % 2 == 0}
    frame = {20 + k: square(10 + k % 5, k // 5) for k in range(25) if k % 5 in (0, 4) or k // 5 in (0, 4) or k == 12}
    turned = {k: [(p, s, pts[::-1])] if k % 4 == 0 else [(p, s, pts)] for k, ((p, s, pts),) in {**board, **frame}.items()}
    geom = cartograms.outline(regions_of(spark, turned)).first().geom
    rings = P.rings_of(geom.asDict(recursive=True))
    assert sum(s > 0 for _, s, _ in rings) == 7 and sum(s < 0 for _, s, _ in rings) == 1
    assert P.area(rings) == pytest.approx(5 + 16 + 1)
    parts = {}
    for part, sign, pts in rings:
        parts.setdefault(part, []).append((sign, P.ring_area(pts)))
    assert sorted(map(sorted, parts.values())) == sorted([[(-1, 9.0), (1, 25.0)]] + [[(1, 1.0)]] * 6)


def test_outlines_of_a_mixed_map(spark, sf_dir):
    one = X.nation_lshape(spark, sf_dir).where("region_id % 3 = 2 and region_id < 6")  # two squares with holes, apart
    rings = P.rings_of(cartograms.outline(one).first().geom.asDict(recursive=True))
    assert len(rings) == 4 and P.area(rings) == pytest.approx(1.5)
    with pytest.raises(ValueError):
        cartograms.outline(one, "none such")


def wavy(seed, n=4, steps=9):
    """A lattice of regions with winding borders that they share, an island, and a hole that another region fills."""
    rng = np.random.default_rng(seed)
    line = {}

    def side(a, b):
        key = (min(a, b), max(a, b))
        if key not in line:
            t = np.linspace(0, 1, steps)[:, None]
            line[key] = np.array(key[0]) + t * (np.array(key[1]) - np.array(key[0])) + np.vstack([[0, 0], rng.normal(0, 0.03, (steps - 2, 2)), [0, 0]])
        return line[key] if key[0] == a else line[key][::-1]

    out = {}
    for k in range(n * n):
        x, y = float(k % n), float(k // n)
        corners = [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y)]
        pts = np.vstack([side(a, b)[:-1] for a, b in zip(corners[:-1], corners[1:], strict=True)])
        out[k] = [(0, 1, np.vstack([pts, pts[:1]]))]
    t = np.linspace(0, 2 * np.pi, 40)[:-1]
    lake = np.column_stack([0.5 + (0.2 + rng.uniform(0, 0.02, 39)) * np.cos(t), 0.5 + 0.2 * np.sin(t)])
    lake = np.vstack([lake, lake[:1]])
    out[0] = [*out[0], (0, -1, lake[::-1])]
    out[90] = [(0, 1, lake)]
    out[91] = [(0, 1, lake + 20.0)]
    return out


@pytest.mark.parametrize("tolerance,outer", [(0.05, True), (0.05, False), (0.4, True)])
def test_simplified_arcs_as_the_kernel_has_them(spark, tolerance, outer):
    """Two maps in one table, each as if alone."""
    maps = {"a": wavy(1), "b": wavy(2, 3)}
    table = regions_of(spark, maps["a"], "a").unionByName(regions_of(spark, maps["b"], "b"))
    found = {(r.map_id, r.region_id): r.geom for r in borders.simplify(table, tolerance, outer).collect()}
    for name, held in maps.items():
        want = shapes.simplify_coverage(list(held.values()), tolerance, outer)
        for k, s in zip(held, want, strict=True):
            got = P.rings_of(found[name, k].asDict(recursive=True)) if found[name, k] else []
            cycle = lambda p: [tuple(x) for x in np.roll(np.round(p[:-1], 9), -min(range(len(p) - 1), key=lambda i: tuple(np.round(p[i], 9))), axis=0)]
            assert [(sign, cycle(p)) for _, sign, p in got] == [(sign, cycle(p)) for _, sign, p in s]


def test_simplified_columns_and_small_parts(spark):
    table = regions_of(spark, {0: square(0, 0), 1: square(1, 0), 2: [*square(3, 3), (1, 1, square(9, 9, 0.01)[0][2])]}).withColumn("name", F.lit("x"))
    found = {r.region_id: r for r in cartograms.simplify(table, 0.1, min_island=0.1).collect()}
    assert found[2].geom.kind == "Polygon" and found[0].name == "x" and found[1].value == 2.0


def walked(active, seeds):
    """(steps, label) of cells, by waves from all seeds."""
    best, wave = {}, {}
    for label, cell in sorted(seeds):
        wave.setdefault(cell, label)
    steps = 0
    while wave:
        best |= {c: (steps, n) for c, n in wave.items()}
        new = {}
        for (y, x), n in wave.items():
            for c in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if c in active and c not in best:
                    new[c] = min(n, new.get(c, n))
        wave, steps = new, steps + 1
    return best


@pytest.mark.parametrize("tile", [4, 7, 64])
def test_walks_through_a_maze(spark, tile):
    """Walls with doors, a piece without a seed, two seeds in one cell, and one outside."""
    rng = np.random.default_rng(6)
    n = 24
    mask = np.ones((n, n), bool)
    for k in range(3, n, 5):
        mask[k] = False
        mask[k, rng.integers(0, n - 6)] = True
    mask[:, n - 4] = False
    grid = grids.Grid.from_bounds((0.0, 0.0, float(n), float(n)), n)
    cells = spark.createDataFrame([(y, x, x + 0.5, y + 0.5) for y, x in np.argwhere(mask).tolist()], "iy int, ix int, x double, y double")
    seeds = [(7, 0.5, 0.5), (3, 0.6, 0.7), (2**40, 10.5, 20.5), (1, 2.2, -3.0)]
    found = {(r.iy, r.ix): (r.steps, r.label) for r in walks.geodesic_labels(cells, spark.createDataFrame(seeds, "site_id long, x double, y double"), grid, tile).collect()}
    active = set(map(tuple, np.argwhere(mask).tolist()))
    want = walked(active, [(7, (0, 0)), (3, (0, 0)), (2**40, (20, 10)), (1, (0, 2))])
    assert set(found) == active and {c: found[c] for c in want} == want
    alone = active - set(want)
    assert alone
    for y, x in alone:
        d = [((x + 0.5 - sx) ** 2 + (y + 0.5 - sy) ** 2, k) for k, sx, sy in seeds]
        assert found[y, x] == (None, min(d)[1])


def test_ways_lead_to_their_seeds(spark):
    grid = grids.Grid.from_bounds((0.0, 0.0, 6.0, 6.0), 6)
    cells = grid.cells(spark).where("not (ix = 3 and iy > 0)")
    labelled = walks.geodesic_labels(cells, spark.createDataFrame([(5, 0.5, 5.5), (9, 5.5, 5.5)], "site_id long, x double, y double"), grid, 4)
    at = {(r.iy, r.ix): r for r in walks.ways(cells, labelled).collect()}
    assert len(at) == 31
    for r in at.values():
        n = 0
        while r.to_iy is not None:
            r, n = at[r.to_iy, r.to_ix], n + 1
        assert (r.iy, r.ix) in {(5, 0), (5, 5)}


def two_maps(spark, shared):
    """The same nine squares twice, in two places that overlap, with shared ids or own ones."""
    one = {k: square(k % 3, k // 3) for k in range(9)}
    two = {k if shared else 100 + k: square(0.5 + 2 * (k % 3), 2 * (k // 3), 2.0) for k in range(9)}
    return regions_of(spark, one, "one").unionByName(regions_of(spark, two, "two"))


@pytest.mark.parametrize("shared", [True, False])
def test_two_maps_in_every_plan(spark, shared):
    both = two_maps(spark, shared).withColumn("grp", F.col("region_id") % 2).cache()
    by_map = lambda df: {r.map_id: r["count"] for r in df.groupBy("map_id").count().collect()}
    pairs = adjacency.pairs(both)
    assert by_map(pairs) == {"one": 20, "two": 20} and by_map(adjacency.box_pairs(both)) == {"one": 20, "two": 20}
    parts = adjacency.components(both, pairs)
    assert {(r.map_id, r.component) for r in parts.collect()} == {("one", 0), ("two", 0 if shared else 100)}
    scales = adjacency.prescale(both, parts).select("map_id", "scale").distinct().collect()
    assert len(scales) == 2
    cells = cartograms.voronoi_result(both, voronoi.Options(n_iter=3, resolution=30)).cells
    assert by_map(cells) == {"one": 9, "two": 9}
    report = cartograms.analyze(both, cells, "grp")
    assert report["violated"].columns[0] == "map_id" and report["satellites"].columns[0] == "map_id"
    assert by_map(cartograms.make_groups_contiguous(both, "grp")) == {"one": 9, "two": 9}
    assert by_map(cartograms.layout(both, "value")) == {"one": 9, "two": 9}
    assert by_map(cartograms.simplify(both, 0.01)) == {"one": 9, "two": 9} and by_map(cartograms.outline(both)) == {"one": 1, "two": 1}
    found = cartograms.flow(both, options=flow.Options(grid_size=32, n_iter=2, prescale_components=True))
    assert by_map(found.regions) == {"one": 9, "two": 9}


def test_maps_in_one_table_are_as_alone(spark):
    """A map's neighbours, components and layout are the same with and without another map beside it."""
    both = two_maps(spark, True)
    alone = both.where("map_id = 'two'").drop("map_id")
    mine = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert mine(adjacency.pairs(both).where("map_id = 'two'").drop("map_id")) == mine(adjacency.pairs(alone))
    a, b = (cartograms.layout(x, "value").select("region_id", "x", "y", "size") for x in (both.where("map_id = 'two'"), alone))
    assert mine(a) == mine(b)
    assert pd.DataFrame(mine(a)).notna().all().all()
