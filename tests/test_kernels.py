"""Kernels: closed forms, invariants, and brute force on small inputs."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arealmap.functions import geometry as G
from arealmap.kernels import assign, circles, flow, partition, planar, raster, repair, voronoi
from arealmap.operators.grids import Grid, multilevel, symbol_size


def square(x0, y0, x1, y1, n=1):
    side = lambda a, b: [(a[0] + (b[0] - a[0]) * k / n, a[1] + (b[1] - a[1]) * k / n) for k in range(n)]
    c = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    return [(0, 1, np.array([p for a, b in zip(c, c[1:] + c[:1], strict=True) for p in side(a, b)] + [c[0]], float))]


LSHAPE = [(0, 1, np.array([(0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1), (0, 0)], float))]


def grid_map(n=3, per_edge=8):
    values = np.random.default_rng(42).integers(100, 10000, n * n).astype(float)
    return [square(c, r, c + 1, r + 1, per_edge) for r in range(n) for c in range(n)], values


def test_fixture_values():
    assert grid_map()[1].tolist() == [983, 7762, 6580, 4444, 4386, 8600, 950, 7003, 2094]


def test_flow_converges():
    shapes, values = grid_map()
    found = flow.solve(shapes, values, flow.Options(grid_size=128))
    assert found.status == flow.CONVERGED and found.series[-1][2] < math.log2(1.1)
    assert sum(map(planar.area, found.shapes)) == pytest.approx(9, rel=0.02)
    assert sum(found.logs > 0) and sum(found.logs < 0)


def test_equal_densities_do_not_move():
    shapes, _ = grid_map()
    found = flow.solve(shapes, np.ones(9), flow.Options(grid_size=64), points=np.array([[1.5, 1.5]]))
    assert found.status == flow.CONVERGED and found.iterations == 1
    assert np.allclose(found.points, [[1.5, 1.5]], atol=1e-9)


def test_two_boxes_errors():
    """Values 1 and 3 on equal areas: the first is twice too large, the second a third short."""
    areas, values = np.ones(2), np.array([1.0, 3.0])
    logs = np.log2(areas / (values / (values.sum() / areas.sum())))
    assert logs == pytest.approx([1.0, math.log2(2 / 3)])


def test_zero_value_never_converges():
    shapes, values = grid_map()
    values[0] = 0
    found = flow.solve(shapes, values, flow.Options(grid_size=64, n_iter=20))
    assert found.status != flow.CONVERGED and found.series[-1][2] == np.inf


def test_snapshot_numbers():
    shapes, values = grid_map()
    found = flow.solve(shapes, values, flow.Options(grid_size=64, n_iter=25, snapshot_every=10, mean_tol=1e-9, max_tol=1e-9, stall_patience=None))
    assert [i for i, _ in found.snapshots] == [1, 11, 21, 25] and found.status == flow.COMPLETED


@pytest.mark.parametrize("bad", [{"dt": 0}, {"n_iter": 0}, {"grid_margin": -1}, {"mean_tol": -0.1}, {"recompute_every": 0}])
def test_options_are_checked(bad):
    with pytest.raises(flow.OptionsError):
        flow.Options(**bad)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(0.01, 1.0), min_size=2, max_size=6), st.sampled_from(["sequential", "treemap"]), st.booleans())
def test_split_keeps_area(shares, strategy, lshape):
    shape = LSHAPE if lshape else square(0, 0, 2, 1)
    whole = planar.area(shape)
    parts = partition.split(shape, [x / sum(shares) for x in shares], strategy=strategy)
    assert sum(map(planar.area, parts)) == pytest.approx(whole, rel=1e-6)
    for part, share in zip(parts, shares, strict=True):
        if share / sum(shares) > 0.01:
            assert planar.area(part) / whole == pytest.approx(share / sum(shares), abs=2e-3)


def test_split_of_unit_square():
    left, right = partition.split(square(0, 0, 1, 1), 0.3)
    assert planar.bounds(left) == pytest.approx((0, 0, 0.3, 1)) and planar.bounds(right) == pytest.approx((0.3, 0, 1, 1))


def test_treemap_cuts_at_the_first_best():
    assert partition.balanced([1, 1, 2]) == 2 and partition.balanced([1, 1]) == 1 and partition.balanced([3, 1, 1, 1]) == 1


def test_shrink():
    parts = partition.shrink(square(0, 0, 1, 1), [0.2, 0.3, 0.5], tol=1e-9)
    assert [planar.area(p) for p in parts] == pytest.approx([0.2, 0.3, 0.5], abs=1e-6)
    core, shell = partition.shrink(square(0, 0, 1, 1), [0.5, 0.5], mode="shell", tol=1e-9)
    assert planar.area(core) == pytest.approx(0.25, abs=1e-6)
    concave = partition.shrink(LSHAPE, [0.5, 0.5], tol=0.01)
    assert sum(map(planar.area, concave)) == pytest.approx(0.75) and planar.area(concave[0]) == pytest.approx(0.375, rel=0.08)


def test_parts_fall_back_to_the_whole():
    assert partition.parts([], [0.5, 0.5]) == [[], []]
    line = [(0, 1, np.array([(0, 0), (1, 0), (0, 0)], float))]
    assert partition.parts(line, [0.5, 0.5])[0] == line


def test_dots():
    pts = partition.dots(LSHAPE, 200, 5)
    assert len(pts) == 200 and planar.contains(LSHAPE, pts[:, 0], pts[:, 1]).all()
    assert (pts == partition.dots(LSHAPE, 200, 5)).all()
    assert len(partition.dots([(0, 1, np.array([(0, 0), (1, 1), (0, 0)], float))], 5, 1)) == 0


def test_shared_boundaries():
    g = lambda *b: planar.to_geom(square(*b))
    assert planar.boundary_within(g(0, 0, 1, 1), g(1, 0, 2, 1), 0.0005) == pytest.approx(1.001)
    assert planar.boundary_within(g(0, 0, 1, 1), g(1, 1, 2, 2), 0.0005) == pytest.approx(0.001)
    assert planar.boundary_within(g(0, 0, 1, 1), g(3, 0, 4, 1), 0.0005) == 0


def test_distance_against_brute_force():
    mask = np.random.default_rng(3).random((17, 23)) < 0.06
    far, row, col = raster.distance(mask, 1.5, 0.5)
    yy, xx = np.nonzero(mask)
    gy, gx = np.mgrid[:17, :23]
    wanted = np.sqrt(((gy[..., None] - yy) * 1.5) ** 2 + ((gx[..., None] - xx) * 0.5) ** 2).min(-1)
    assert np.allclose(far, wanted) and np.allclose(np.hypot((gy - row) * 1.5, (gx - col) * 0.5), wanted) and mask[row, col].all()


def test_gaussian_keeps_constants_and_sums():
    field = np.zeros((30, 30))
    field[15, 15] = 1
    out = raster.gaussian(field, 2.0, 2.0)
    assert out.sum() == pytest.approx(1) and out[15, 15] == out.max()
    assert np.allclose(raster.gaussian(np.full((8, 5), 3.0), 4.0, 4.0), 3.0)


def test_poisson_velocity_of_a_wave():
    n = 64
    x = np.arange(n) / n
    rho = 1 + 0.1 * np.sin(2 * np.pi * x)[None, :].repeat(n, 0)
    vx, vy = raster.poisson_velocity(rho, 1 / n, 1 / n)
    assert np.allclose(vy, 0, atol=1e-12) and np.allclose(vx, -0.1 * np.cos(2 * np.pi * x) / (2 * np.pi), atol=1e-9)


def test_modulators():
    grid = Grid.from_bounds((0, 0, 10, 10), 20)
    mask = np.full((20, 20), -1)
    mask[5:15, 5:15] = 0
    rho = np.where(mask >= 0, 2.0, 1.0)
    grown = raster.BorderExtension(1.0, 1.0)(rho, grid, mask, 1.0)
    assert grown[4, 10] == 2.0 and grown[0, 10] == 1.0
    ones = np.ones((20, 20))
    vx, vy = raster.BoundaryDecay(2.0)(ones, ones, grid, mask)
    assert vx[10, 10] == 1 and vx[0, 0] == 0
    both = raster.Pipeline(raster.VelocitySmooth(1.0), raster.BoundaryNormalDecay(2.0))(ones, ones, grid, mask)
    assert len(both) == 2 and np.isfinite(both[0]).all()
    assert raster.Pipeline(raster.DensitySmooth(1.0))(rho, grid, mask, 1.0).mean() == pytest.approx(rho.mean())


def test_assignment_against_all_permutations():
    cost = np.random.default_rng(1).random((5, 7))
    found = assign.least_cost(cost)
    assert cost[range(5), found].sum() == pytest.approx(min(sum(cost[k, p[k]] for k in range(5)) for p in itertools.permutations(range(7), 5)))
    with pytest.raises(ValueError):
        assign.least_cost(cost.T)


TILES = np.array([[x, y] for y in range(3) for x in range(3)], float)
NEAR = np.abs(TILES[:, None] - TILES).sum(2) == 1


def test_hole_is_filled_unless_the_map_has_one():
    ring = np.array([0, 1, 2, 3, 5, 6, 7, 8])
    assert assign.holes(ring, NEAR) == [[4]]
    filled = assign.fill_holes(ring, NEAR)
    assert not assign.holes(filled, NEAR) and len(set(filled.tolist())) == 8
    assert (assign.fill_holes(ring, NEAR, real_holes=1) == ring).all()


def test_hops():
    far = assign.hops(NEAR)
    assert far[0, 8] == 4 and (np.diag(far) == 0).all() and assign.hops(np.zeros((2, 2), bool))[0, 1] == 2


def test_circles_part():
    rng = np.random.default_rng(42)
    pos, radii = rng.uniform(0, 10, (5, 2)), np.ones(5)
    assert circles.overlaps(circles.physics(pos, radii)[0], radii) == 0
    four = np.array([[0, 0], [2, 0], [0, 2], [2, 2]], float)
    near = np.array([[0, 1, 1, 0], [1, 0, 0, 1], [1, 0, 0, 1], [0, 1, 1, 0]], float)
    placed, info = circles.packing(four, np.full(4, 0.8), near)
    assert info["converged"] and circles.overlaps(placed, np.full(4, 0.8)) == 0
    same, _ = circles.resolve_overlaps(np.zeros((3, 2)), np.ones(3), max_iterations=200)
    assert np.isfinite(same).all() and circles.overlaps(same, np.full(3, 0.9)) == 0


def test_moving_stats():
    stats = circles.MovingStats(3, adaptive=False)
    for x in (1.0, 2.0, 3.0):
        stats.update(np.array(x))
    assert stats.mean == pytest.approx(2.25)


def test_voronoi_evens_areas():
    seeds = np.random.default_rng(4).uniform(0.5, 4.5, (12, 2))
    field, series = voronoi.solve(seeds, square(0, 0, 5, 5), voronoi.Options(n_iter=40, resolution=100))
    areas = [planar.area(c) for c in field.cells()]
    assert sum(areas) == pytest.approx(25) and series[-1][1] < series[0][1] / 5
    weighted, steps = voronoi.solve(seeds, square(0, 0, 5, 5), voronoi.Options(n_iter=20, resolution=80), weights=[1] * 11 + [1000])
    assert np.isfinite(weighted.seeds).all()
    with pytest.raises(ValueError):
        voronoi.Field(seeds, square(0, 0, 5, 5), voronoi.Options(), weights=[0] * 12)


def test_geodesic_labels_stay_inside():
    u = [(0, 1, np.array([(0, 0), (3, 0), (3, 3), (2, 3), (2, 1), (1, 1), (1, 3), (0, 3), (0, 0)], float))]
    field, _ = voronoi.solve(np.array([[0.5, 2.5], [2.5, 2.5]]), u, voronoi.Options(n_iter=5, resolution=60, geodesic=True))
    label = field.labels()
    left = field.px[:, 0] < 1
    assert (label[left & (field.px[:, 1] > 1.2)] == 0).all()


def test_border_of_tiles():
    ring = [square(x, y, x + 1, y + 1) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    rings = voronoi.border(ring)
    assert [s for _, s, _ in rings] == [1, -1] and planar.area(rings) == pytest.approx(8)


PAIRS = [(a, b) for a in range(9) for b in range(a + 1, 9) if NEAR[a, b]]


def test_repair_is_a_permutation_that_mends():
    links = repair.links_of(9, PAIRS)
    groups = np.array([0, 0, 1, 1, 0, 0, 1, 1, 0])
    slot = repair.repair(9, PAIRS, PAIRS, groups, TILES, TILES)
    by_cell = np.empty(9, int)
    by_cell[slot] = np.arange(9)
    assert sorted(slot) == list(range(9)) and len(repair.satellites(groups[by_cell], links)) < len(repair.satellites(groups, links))
    shuffled = np.random.default_rng(2).permutation(9)
    kept = lambda s: sum(s[b] in links[s[a]] for a, b in PAIRS)
    better = repair.adjacency(shuffled, PAIRS, links, 10)
    assert sorted(better) == list(range(9)) and kept(better) > kept(shuffled)
    turned = repair.orientation(better, TILES, TILES, PAIRS, links)
    assert sorted(turned) == list(range(9)) and kept(turned) >= kept(better)


def test_grids():
    grid = Grid.from_bounds((0, 0, 100, 50), 10)
    assert (grid.sx, grid.sy, grid.dx, grid.dy) == (10, 5, 10, 10)
    assert Grid.from_bounds((0, 0, 50, 100), 10).sx == 5
    assert Grid.from_bounds((0, 0, 100, 50), (None, 5)).sx == 10
    assert Grid.from_bounds_and_spacing((0, 0, 100, 50), 7, strict=True).bounds == (0, 0, 100, 50)
    assert Grid.from_size_and_spacing((4, 2), 5.0).bounds == (-10, -5, 10, 5)
    assert [(g.sx, g.sy) for g in multilevel((0, 0, 100, 80), 64)] == [(64, 51), (128, 102), (256, 204)]
    with pytest.raises(ValueError):
        Grid.from_bounds((0, 0, 1, 1), (None, None))
    assert symbol_size("hexagon", 1.0, "square", 0.0) == 0.75 and symbol_size("square", 1.0, "circle", 0.0) == 0.5


def test_symbol_units():
    assert G.unit_area("square") == 1 and G.area_factor("circle") == 1
    assert G.area_factor("square") == pytest.approx(math.sqrt(math.pi / 4))
    assert all(max(abs(v) for p in pts for v in p) <= 0.5 + 1e-12 for pts in G.SYMBOLS.values())


def test_crossing_rings():
    bow = [(0, 1, np.array([(0, 0), (1, 1), (1, 0), (0, 1), (0, 0)], float))]
    assert planar.crossing_segments(bow) and not planar.crossing_segments(LSHAPE)


def test_elastic_boundary_gives_way():
    seeds = np.random.default_rng(6).uniform(0.5, 4.5, (10, 2))
    field, steps = voronoi.solve(seeds, square(0, 0, 5, 5), voronoi.Options(n_iter=15, resolution=60, elasticity=0.8, min_boundary_points=80), weights=[1] * 9 + [8])
    outline = field.boundary[0][2]
    assert len(outline) == 80 and not planar.crossing_segments(field.boundary)
    assert np.abs(planar.area(field.boundary) - 25) < 5 and not np.allclose(planar.bounds(field.boundary), (0, 0, 5, 5))
    assert sum(planar.area(c) for c in field.cells()) == pytest.approx(planar.area(field.boundary), rel=1e-3)
