"""Symbols, per-region overrides, and placed symbol polygons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

FIT_MODES = ("inside", "area", "fill")


def compose(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """Transform b after a: places and turns add up, scales multiply, reflections cancel."""
    return {
        "x": a["x"] + b["x"], "y": a["y"] + b["y"], "rotation": a["rotation"] + b["rotation"],
        "scale": a["scale"] * b["scale"], "reflection": a["reflection"] != b["reflection"],
    }


def inner_fit(canonical: str, styled: str) -> float:
    """Largest scale at which the styled unit symbol stays inside the canonical one, upright and about its centre."""
    corners, pts = G.SYMBOLS[canonical], G.SYMBOLS[styled]
    # Convex canonical symbols are intersections of half-planes through neighbouring corners.
    most = math.inf
    for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1], strict=True):
        nx, ny = y1 - y0, x0 - x1
        limit = nx * x0 + ny * y0
        if limit < 0:
            nx, ny, limit = -nx, -ny, -limit
        far = max(nx * px + ny * py for px, py in pts)
        if far > 0:
            most = min(most, limit / far)
    return most


def fit_scale(canonical: str, styled: str, mode: str = "inside") -> float:
    """Scale of a styled symbol for its canonical one: inside it, of its area, or (fill) the larger of what fits at some turn."""
    if mode not in FIT_MODES:
        raise ValueError(f"fit mode must be one of {FIT_MODES}")
    if canonical == styled:
        return 1.0
    if mode == "area":
        return math.sqrt(G.unit_area(canonical) / G.unit_area(styled))
    if mode == "inside":
        return inner_fit(canonical, styled)
    return best_turn(canonical, styled)[0]


def best_turn(canonical: str, styled: str, steps: int = 720) -> tuple[float, float]:
    """(scale, rotation) that let the styled symbol be largest inside the canonical one, by a search over turns."""
    corners, best = G.SYMBOLS[canonical], (0.0, 0.0)
    for k in range(steps):
        turn = 2 * math.pi * k / steps
        pts = [(x * math.cos(turn) - y * math.sin(turn), x * math.sin(turn) + y * math.cos(turn)) for x, y in G.SYMBOLS[styled]]
        most = math.inf
        for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1], strict=True):
            nx, ny = y1 - y0, x0 - x1
            limit = nx * x0 + ny * y0
            sign = -1 if limit < 0 else 1
            far = max(sign * (nx * px + ny * py) for px, py in pts)
            if far > 0:
                most = min(most, abs(limit) / far)
        if most > best[0] + 1e-12:
            best = (most, turn)
    return best


def overrides(layout: DataFrame, rules: DataFrame | None, symbol: str = "circle", scale: float = 1.0, rotation: float = 0.0, reflection: bool = False) -> DataFrame:
    """(…, symbol, scale, rotation, reflection, params) of each region: the global style, changed by its rules.

    ``rules`` holds (region_id, seq, symbol, scale, rotation, reflection, params): a later symbol
    replaces an earlier one, params merge, transforms compose.  Nulls leave things as they are.
    """
    base = layout.withColumns({"symbol": F.lit(symbol), "s_scale": F.lit(float(scale)), "s_rotation": F.lit(float(rotation)), "s_reflection": F.lit(reflection)})
    if rules is None:
        return base.withColumn("params", F.create_map().cast("map<string,string>"))
    held = rules.groupBy("region_id").agg(
        F.max_by("symbol", F.when(F.col("symbol").isNotNull(), F.col("seq"))).alias("o_symbol"),
        F.product(F.coalesce("scale", F.lit(1.0))).alias("o_scale"), F.sum(F.coalesce("rotation", F.lit(0.0))).alias("o_rotation"),
        (F.count_if("reflection") % 2 == 1).alias("o_reflection"),
        F.array_sort(F.collect_list(F.struct("seq", F.map_entries("params").alias("p")))).alias("o_params"),
    )
    out = base.join(held, "region_id", "left")
    # Entries in order of the rules; the last value of a key counts.
    entries = F.flatten(F.transform("o_params", lambda r: F.coalesce(r["p"], F.array().cast("array<struct<key:string,value:string>>"))))
    params = F.aggregate(F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>")), F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.create_map(e["key"], e["value"])))
    return out.withColumns({
        "symbol": F.coalesce("o_symbol", "symbol"), "s_scale": F.col("s_scale") * F.coalesce("o_scale", F.lit(1.0)),
        "s_rotation": F.col("s_rotation") + F.coalesce("o_rotation", F.lit(0.0)),
        "s_reflection": F.col("s_reflection") != F.coalesce("o_reflection", F.lit(False)), "params": params,
    }).drop("o_symbol", "o_scale", "o_rotation", "o_reflection", "o_params")


def symbols(styled: DataFrame, canonical: str = "circle", fit_mode: str = "inside") -> DataFrame:
    """Placed polygons: (region_id, original_index, _symbol_x, _symbol_y, _symbol_size, _displacement, geom).

    ``styled`` has (region_id, x, y, size, x0, y0) of the layout and the style's columns.  Sizes
    are radii of equal-area circles; each symbol's factor turns them into its half-extent.
    """
    names = sorted(G.SYMBOLS)
    unit = F.create_map(*(c for n in names for c in (F.lit(n), G.symbol_points(n))))
    extent = F.create_map(*(c for n in names for c in (F.lit(n), F.lit(2 * G.area_factor(canonical) * fit_scale(canonical, n, fit_mode)))))
    known = F.when(F.col("symbol").isin(*names), F.col("symbol")).otherwise(F.raise_error(F.concat(F.lit("unknown symbol: "), F.coalesce("symbol", F.lit("null")))))
    held = styled.withColumn("symbol", known)
    size = F.col("size") * extent[F.col("symbol")] * F.col("s_scale")
    pts = G.place(unit[F.col("symbol")], F.col("x"), F.col("y"), size, F.col("s_rotation"), F.col("s_reflection"))
    return held.select(
        "region_id", F.col("region_id").alias("original_index"), F.col("x").alias("_symbol_x"), F.col("y").alias("_symbol_y"), F.col("size").alias("_symbol_size"),
        F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0")).alias("_displacement"), "symbol", "params", G.geom("Polygon", G.ring(pts)).alias("geom"),
    )


def displacement_metrics(placed: DataFrame) -> DataFrame:
    return placed.agg(F.avg("_displacement").alias("displacement_mean"), F.max("_displacement").alias("displacement_max"), F.stddev_pop("_displacement").alias("displacement_std"))
