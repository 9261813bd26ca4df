"""Raster fields: densities, velocity modulators that act cell by cell, labels of the nearest seed, and what plots show of them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .adjacency import _kept
from .grids import Grid


def rasterize_boxes(regions: DataFrame, grid: Grid, value: str = "value") -> DataFrame:
    """(iy, ix, region_id, density) of cells whose centre lies in an axis-aligned region; of several regions the last counts.

    Each region names the cells it can cover, so nothing is compared that isn't near.
    """
    held = regions.select("region_id", (F.col(value) / G.area(F.col("geom"))).alias("density"), G.bounds(F.col("geom")).alias("b"))
    span = lambda lo, hi, start, step, n: F.sequence(F.greatest(F.ceil((F.col(lo) - start) / step - 0.5), F.lit(0)).cast("int"), F.least(F.floor((F.col(hi) - start) / step - 0.5), F.lit(n - 1)).cast("int"))
    inside = (F.col("b.xmax") >= grid.xmin) & (F.col("b.xmin") <= grid.xmax) & (F.col("b.ymax") >= grid.ymin) & (F.col("b.ymin") <= grid.ymax)
    cells = held.where(inside).select("region_id", "density", "b", F.explode(span("b.xmin", "b.xmax", grid.xmin, grid.dx, grid.sx)).alias("ix"))
    cells = cells.select("region_id", "density", "ix", F.explode(span("b.ymin", "b.ymax", grid.ymin, grid.dy, grid.sy)).alias("iy"))
    return cells.groupBy("iy", "ix").agg(F.max_by(F.struct("region_id", "density"), "region_id").alias("r")).select("iy", "ix", "r.region_id", "r.density")


def density_field(regions: DataFrame, grid: Grid, value: str = "value", mean_density: float | None = None, zero_is_outside: bool = False) -> DataFrame:
    """(iy, ix, x, y, rho, geom_idx): a region's density inside it, the map's mean outside (geom_idx -1).

    With ``zero_is_outside`` cells of density 0 count as outside too.
    """
    if mean_density is None:
        mean_density = regions.agg(F.sum(value) / F.sum(G.area(F.col("geom")))).first()[0]
    held = grid.cells(regions.sparkSession).join(rasterize_boxes(regions, grid, value), ["iy", "ix"], "left")
    rho = F.coalesce("density", F.lit(mean_density))
    if zero_is_outside:
        rho = F.when(rho == 0, F.lit(mean_density)).otherwise(rho)
    return held.select("iy", "ix", "x", "y", rho.alias("rho"), F.coalesce("region_id", F.lit(-1)).cast("long").alias("geom_idx"))


def multiply(cells: DataFrame, fx: Column | float, fy: Column | float) -> DataFrame:
    return cells.withColumns({"vx": F.col("vx") * fx, "vy": F.col("vy") * fy})


def tensor(cells: DataFrame, axx, axy, ayx, ayy) -> DataFrame:
    """v' = A v."""
    vx, vy = F.col("vx"), F.col("vy")
    return cells.withColumns({"vx": axx * vx + axy * vy, "vy": ayx * vx + ayy * vy})


def axis_aligned(cells: DataFrame, dx: float = 1.0, dy: float = 1.0, theta: Column | None = None) -> DataFrame:
    if theta is None:
        return tensor(cells, F.lit(dx), F.lit(0.0), F.lit(0.0), F.lit(dy))
    return directional(cells, theta, dx, dy)


def directional(cells: DataFrame, theta: Column | float, along: float = 2.0, across: float = 1.0) -> DataFrame:
    """Stretch by ``along`` in the direction theta and by ``across`` at right angles to it."""
    c, s = F.cos(F.lit(theta)), F.sin(F.lit(theta))
    mixed = (along - across) * c * s
    return tensor(cells, along * c * c + across * s * s, mixed, mixed, along * s * s + across * c * c)


def _center(grid: Grid, center: tuple[float, float] | None) -> tuple[float, float]:
    return center or ((grid.xmin + grid.xmax) / 2, (grid.ymin + grid.ymax) / 2)


def radial(grid: Grid, center: tuple[float, float] | None = None, inward: bool = False) -> Column:
    cx, cy = _center(grid, center)
    sign = -1.0 if inward else 1.0
    return F.atan2(sign * (F.col("y") - cy), sign * (F.col("x") - cx))


def tangential(grid: Grid, center: tuple[float, float] | None = None, clockwise: bool = False) -> Column:
    cx, cy = _center(grid, center)
    return F.atan2(F.col("y") - cy, F.col("x") - cx) + (-math.pi / 2 if clockwise else math.pi / 2)


def seeded_direction(cells: DataFrame, seeds: list[tuple[float, float, float]], power: float = 2.0) -> DataFrame:
    """``theta`` of each cell: directions of (x, y, theta) seeds blended by inverse distance, exact at a seed.

    Seeds are literals of the plan, a short list, so a cell is computed where it is.
    """
    d2 = lambda s: (F.col("x") - s[0]) * (F.col("x") - s[0]) + (F.col("y") - s[1]) * (F.col("y") - s[1])
    weight = lambda s: F.pow(F.greatest(d2(s), F.lit(1e-300)), F.lit(-power / 2))
    blend = lambda f: sum((weight(s) * f(s[2]) for s in seeds[1:]), weight(seeds[0]) * f(seeds[0][2]))
    theta = F.atan2(blend(math.sin), blend(math.cos))
    for s in reversed(seeds):
        theta = F.when(d2(s) == 0, F.lit(math.atan2(math.sin(s[2]), math.cos(s[2])))).otherwise(theta)
    return cells.withColumn("theta", theta)


def precision(sigma, theta: float) -> tuple[float, float, float]:
    """(pxx, pxy, pyy) of a Gaussian given by one width, widths along and across theta, or a covariance."""
    import numpy as np

    s = np.array(sigma, float)
    if s.ndim == 0:
        held = np.eye(2) * float(s) ** 2
    elif s.shape == (2,):
        turn = np.array([[math.cos(theta), -math.sin(theta)], [math.sin(theta), math.cos(theta)]])
        held = turn @ np.diag(s**2) @ turn.T
    elif s.shape == (2, 2):
        held = s
    else:
        raise ValueError("sigma is a number, a pair or a 2 by 2 covariance")
    if not np.allclose(held, held.T) or np.linalg.eigvalsh(held).min() <= 0:
        raise ValueError("the covariance must be symmetric and positive definite")
    inverse = np.linalg.inv(held)
    return float(inverse[0, 0]), float(inverse[0, 1]), float(inverse[1, 1])


def localized(cells: DataFrame, seeds: list[tuple], along: float = 2.0, across: float = 1.0) -> DataFrame:
    """Tensors of (x, y, theta, sigma[, along, across]) seeds blended by their Gaussians; where they are weak the identity fills up."""
    sums = [F.lit(0.0)] * 4
    for x, y, theta, sigma, *own in seeds:
        a, b = own or (along, across)
        pxx, pxy, pyy = precision(sigma, theta)
        dx, dy = F.col("x") - x, F.col("y") - y
        w = F.exp(-0.5 * (pxx * dx * dx + 2 * pxy * dx * dy + pyy * dy * dy))
        c, s = math.cos(theta), math.sin(theta)
        for i, k in enumerate((1.0, a * c * c + b * s * s, (a - b) * c * s, a * s * s + b * c * c)):
            sums[i] = sums[i] + w * k
    whole = F.greatest(F.lit(1.0), sums[0])
    rest = F.greatest(F.lit(0.0), 1 - sums[0] / whole)
    return tensor(cells, sums[1] / whole + rest, sums[2] / whole, sums[2] / whole, sums[3] / whole + rest)


#: Seeds, counted first, that are broadcast as one array.
LISTED_SEEDS = 4096


def nearest_labels(cells: DataFrame, seeds: DataFrame, weighted: bool = False, offset: bool = False, listed: int = LISTED_SEEDS) -> DataFrame:
    """``label`` of each cell (iy, ix, x, y): the seed of least squared distance, over its weight or less its offset; ties to the smaller id.

    Up to ``listed`` seeds are broadcast as one array that each cell scans where it is; more are looked up
    in buckets (``_nearest_by_buckets``), with the same result.
    """
    n = seeds.count()
    fields = [F.col("site_id").alias("site_id"), F.col("x").cast("double").alias("sx"), F.col("y").cast("double").alias("sy")]
    fields.append((F.col("weight").cast("double") if weighted else F.lit(1.0)).alias("w"))
    fields.append((F.col("offset").cast("double") if offset else F.lit(0.0)).alias("o"))
    if n > listed:
        return _nearest_by_buckets(cells, seeds.select(*fields))
    listing = seeds.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("seeds"))
    d2 = lambda s: ((F.col("x") - s["sx"]) * (F.col("x") - s["sx"]) + (F.col("y") - s["sy"]) * (F.col("y") - s["sy"])) / s["w"] - s["o"]
    best = F.array_min(F.transform("seeds", lambda s: F.struct(d2(s).alias("d"), s["site_id"].alias("site_id"))))
    return cells.join(F.broadcast(listing)).withColumn("label", best["site_id"]).drop("seeds")


#: Bands of equal width that offsets are put into.
OFFSET_BANDS = 16


def _classes(seeds: DataFrame) -> tuple[DataFrame, list]:
    """Seeds with a class ``c`` of like weight (a factor of two) and offset (a band), and each class's number, bounds and largest values.

    Classes are as many as weights have binary orders, times ``OFFSET_BANDS`` at most, however many seeds there are.
    """
    lo, hi = seeds.agg(F.min("o"), F.max("o")).first()
    band = F.least(F.floor((F.col("o") - lo) / ((hi - lo) / OFFSET_BANDS)), F.lit(OFFSET_BANDS - 1)) if hi > lo else F.lit(0)
    named = seeds.withColumn("c", (F.floor(F.log2("w")) * OFFSET_BANDS + band).cast("int"))
    return named, named.groupBy("c").agg(F.count("*").alias("n"), F.max("w").alias("w"), F.max("o").alias("o"), *(f(k).alias(f"{f.__name__}_{k}") for f in (F.min, F.max) for k in ("sx", "sy"))).collect()


def _nearest_by_buckets(cells: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nearest of seeds (site_id, sx, sy, w, o) by square buckets, class by class of seeds with like weights and offsets.

    A cell looks into the nine buckets round it, so no seed that it doesn't see is nearer than a bucket's
    side s; such a seed of a class can't come under s * s / (the largest weight) - (the largest offset).
    Where that isn't under the best found, the cell is done with the class; for the others buckets double.
    Few cells and classes go on each time, since a class's first buckets hold about one seed each.
    """
    named, classes = _classes(seeds)
    extent = cells.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if extent[0] is None:
        return cells.withColumn("label", F.lit(None).cast(dict(seeds.dtypes)["site_id"]))
    span = lambda k: max(k.max_sx, extent[1]) - min(k.min_sx, extent[0]) + max(k.max_sy, extent[3]) - min(k.min_sy, extent[2])
    wide = lambda k: span(k) / 4 if k.n == 1 else max(((k.max_sx - k.min_sx) * (k.max_sy - k.min_sy) / k.n) ** 0.5, (k.max_sx - k.min_sx + k.max_sy - k.min_sy) / k.n, span(k) / 65536)
    sizes = {k.c: max(wide(k), 1e-12) for k in classes}
    site = dict(seeds.dtypes)["site_id"]
    held = _kept(cells.withColumn("best", F.lit(None).cast(f"struct<d:double,site_id:{site}>")).withColumn("open", F.array(*(F.lit(k.c) for k in classes))))
    done, going, grown = None, {k.c: k for k in classes}, 1.0
    while True:
        by_class = lambda of: F.create_map(*(x for c, k in going.items() for x in (F.lit(c), F.lit(float(of(c, k))))))  # noqa: B023, E731
        size = by_class(lambda c, k: sizes[c] * grown)  # noqa: B023
        key = lambda p, d=0: F.floor(F.col(p) / F.col("side")) + d
        asked = held.select("iy", "ix", "x", "y", F.explode("open").alias("c")).withColumn("side", size[F.col("c")])
        asked = asked.withColumn("kx", F.explode(F.array(*(key("x", d) for d in (-1, 0, 1))))).withColumn("ky", F.explode(F.array(*(key("y", d) for d in (-1, 0, 1)))))
        placed = named.where(F.col("c").isin(list(going))).withColumn("side", size[F.col("c")]).withColumns({"kx": key("sx"), "ky": key("sy")}).drop("side")
        d2 = ((F.col("x") - F.col("sx")) * (F.col("x") - F.col("sx")) + (F.col("y") - F.col("sy")) * (F.col("y") - F.col("sy"))) / F.col("w") - F.col("o")
        found = asked.join(placed, ["c", "kx", "ky"]).groupBy("iy", "ix").agg(F.min(F.struct(d2.alias("d"), "site_id")).alias("seen"))
        joined = held.join(found, ["iy", "ix"], "left")
        best = F.least("best", "seen")  # nulls give way
        # What a class may still hold unseen, beyond the nine buckets; nothing where these cover everything.
        unseen = by_class(lambda c, k: float("inf") if sizes[c] * grown > span(k) else (sizes[c] * grown) ** 2 / k.w - k.o)  # noqa: B023
        joined = joined.withColumn("best", best).drop("seen")
        left = F.filter("open", lambda c: F.coalesce(unseen[c] < F.col("best.d"), unseen[c] < float("inf")))
        held = _kept(joined.withColumn("open", left))
        over = held.where(F.size("open") == 0).select(*cells.columns, F.col("best.site_id").alias("label"))
        done = over if done is None else done.unionByName(over)
        held = held.where(F.size("open") > 0)
        still = {r[0] for r in held.select(F.explode("open").alias("c")).distinct().collect()}  # classes, a bounded number
        if not still:
            return done
        going, grown = {c: going[c] for c in still}, grown * 2


def lloyd_step(labelled: DataFrame, seeds: DataFrame, factor: float = 1.0) -> DataFrame:
    """Seeds moved toward the mean of their cells; one without cells stays."""
    means = labelled.groupBy("label").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("n_cells"))
    held = seeds.join(means, seeds["site_id"] == means["label"], "left")
    move = lambda p, m: F.col(p) + factor * (F.coalesce(m, p) - F.col(p))
    return held.select("site_id", *(c for c in seeds.columns if c not in ("site_id", "x", "y", "n_cells")), move("x", "mx").alias("x"), move("y", "my").alias("y"), F.coalesce("n_cells", F.lit(0)).alias("n_cells"))


def offset_update(counted: DataFrame, rate: float, cell_area: float) -> DataFrame:
    """Power offsets: (1 - rate) of the old, and twice rate times cell area for each cell under the mean number."""
    whole = Window.partitionBy()
    mean = F.sum("n_cells").over(whole) / F.count("*").over(whole)
    return counted.withColumn("offset", (1 - rate) * F.col("offset") + 2 * rate * cell_area * (mean - F.col("n_cells")))


def density_display(cells: DataFrame, target: float, normalize: str = "ratio", clip_percentile: float | None = None) -> DataFrame:
    """``shown``: log2 of the density by its target (kept off 0), or the difference, cut at a percentile of its size."""
    if normalize == "ratio":
        return cells.withColumn("shown", F.log2(F.greatest(F.col("rho") / target, F.lit(1e-6))))
    if normalize != "difference":
        raise ValueError("normalize is ratio or difference")
    held = cells.withColumn("shown", F.col("rho") - target)
    if clip_percentile is None:
        return held
    limit = held.agg(F.percentile(F.abs("shown"), clip_percentile / 100).alias("limit"))
    return held.join(F.broadcast(limit)).withColumn("shown", F.greatest(F.least("shown", "limit"), -F.col("limit"))).drop("limit")


def velocity_display(cells: DataFrame, skip: int = 1) -> DataFrame:
    """Speed by the largest speed, and direction from 0 to 1, of every ``skip``-th cell."""
    held = cells.withColumn("speed", F.hypot("vx", "vy"))
    top = held.agg(F.max("speed").alias("top"))
    held = held.where((F.col("ix") % skip == 0) & (F.col("iy") % skip == 0)).join(F.broadcast(top))
    return held.withColumns({"magnitude": F.when(F.col("top") > 0, F.col("speed") / F.col("top")).otherwise(F.lit(0.0)), "direction": (F.atan2("vy", "vx") + math.pi) / (2 * math.pi)}).drop("top")


def arrows(cells: DataFrame, dx: float, skip: int = 1, scale: float | None = None, reference: float | None = None) -> DataFrame:
    """(iy, ix, x, y, ux, uy) of every ``skip``-th cell: an arrow of the reference speed (the largest shown) is ``scale`` steps long; without a scale arrows are velocities."""
    held = cells.where((F.col("ix") % skip == 0) & (F.col("iy") % skip == 0))
    if scale is None:
        return held.select("iy", "ix", "x", "y", F.col("vx").alias("ux"), F.col("vy").alias("uy"))
    top = F.lit(float(reference)) if reference is not None else F.max(F.hypot("vx", "vy"))
    held = held.join(F.broadcast(held.agg(top.alias("top"))))
    factor = F.when(F.col("top") > 0, scale * skip * dx / F.col("top")).otherwise(F.lit(1.0))
    return held.select("iy", "ix", "x", "y", (F.col("vx") * factor).alias("ux"), (F.col("vy") * factor).alias("uy"))
