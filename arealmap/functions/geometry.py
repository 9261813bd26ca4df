"""Geometry as nested arrays, and its scalar functions as higher-order expressions.

A geometry is a kind and its rings; a ring has its part's number, a sign (1 for
an exterior, -1 for a hole, 0 where it bounds no area) and its points.  Rings
of polygons are closed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
RING = f"struct<part:int,sign:tinyint,pts:array<{POINT}>>"
GEOM = f"struct<kind:string,rings:array<{RING}>>"
POLYGONS = ("Polygon", "MultiPolygon")


def point(x, y) -> Column:
    return F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))


def ring(pts: Column, part: int = 0, sign: int = 1) -> Column:
    return F.struct(F.lit(part).alias("part"), F.lit(sign).cast("tinyint").alias("sign"), pts.alias("pts"))


def geom(kind: str, *rings: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.array(*rings).alias("rings"))


def box_points(x0, y0, x1, y1) -> Column:
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def box(x0, y0, x1, y1) -> Column:
    return geom("Polygon", ring(box_points(x0, y0, x1, y1)))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _next(pts: Column) -> Column:
    """The points from the second on, then the first: a closed ring gets one empty edge by it."""
    return F.concat(F.slice(pts, 2, F.greatest(F.size(pts), F.lit(1))), F.slice(pts, 1, 1))


def _edges(pts: Column, of) -> Column:
    return F.zip_with(pts, _next(pts), of)


def _cross(p: Column, q: Column) -> Column:
    return p["x"] * q["y"] - q["x"] * p["y"]


def ring_area(pts: Column) -> Column:
    """Shoelace area of a ring, without sign."""
    return F.abs(_total(_edges(pts, _cross))) / 2


def area(g: Column) -> Column:
    """Exteriors less holes; 0 for kinds without area."""
    whole = _total(F.transform(g["rings"], lambda r: r["sign"] * ring_area(r["pts"])))
    return F.when(g["kind"].isin(*POLYGONS), whole).otherwise(F.lit(0.0))


def perimeter(g: Column) -> Column:
    return _total(F.transform(g["rings"], lambda r: _total(_edges(r["pts"], lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"])))))


def _moment(pts: Column, axis: str) -> Column:
    """Area times centroid along an axis, with the sign of the ring's area taken off."""
    twice = _total(_edges(pts, _cross))
    return F.signum(twice) * _total(_edges(pts, lambda p, q: (p[axis] + q[axis]) * _cross(p, q))) / 6


def centroid(g: Column) -> Column:
    """Centroid by area; of geometries without area, the mean of their points."""
    axis = lambda a: _total(F.transform(g["rings"], lambda r: r["sign"] * _moment(r["pts"], a))) / area(g)
    pts = F.flatten(F.transform(g["rings"], lambda r: r["pts"]))
    mean = lambda a: _total(F.transform(pts, lambda p: p[a])) / F.size(pts)
    return F.when(area(g) > 0, point_of(axis("x"), axis("y"))).otherwise(point_of(mean("x"), mean("y")))


def point_of(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def bounds(g: Column) -> Column:
    xs = F.flatten(F.transform(g["rings"], lambda r: F.transform(r["pts"], lambda p: p["x"])))
    ys = F.flatten(F.transform(g["rings"], lambda r: F.transform(r["pts"], lambda p: p["y"])))
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def n_points(g: Column) -> Column:
    return F.aggregate(g["rings"], F.lit(0), lambda a, r: a + F.size(r["pts"]))


def map_points(g: Column, of) -> Column:
    """The same rings with every point replaced by ``of(point)``."""
    rings = F.transform(g["rings"], lambda r: F.struct(r["part"].alias("part"), r["sign"].alias("sign"), F.transform(r["pts"], of).alias("pts")))
    return F.struct(g["kind"].alias("kind"), rings.alias("rings"))


def scale_about(g: Column, factor: Column, cx: Column, cy: Column) -> Column:
    return map_points(g, lambda p: point_of(cx + factor * (p["x"] - cx), cy + factor * (p["y"] - cy)))


def place(pts: Column, x: Column, y: Column, size: Column, rotation: Column | float = 0.0, flipped: Column | bool = False) -> Column:
    """Points of a unit symbol, scaled, mirrored, turned (radians), then moved."""
    turn, mirrored = F.lit(rotation), F.lit(flipped)

    def move(p: Column) -> Column:
        px = F.when(mirrored, -p["x"]).otherwise(p["x"]) * size
        py = p["y"] * size
        return point_of(x + px * F.cos(turn) - py * F.sin(turn), y + px * F.sin(turn) + py * F.cos(turn))

    return F.transform(pts, move)


def regular(n: int, start: float, radius: float = 0.5) -> list[tuple[float, float]]:
    return [(radius * math.cos(start + 2 * math.pi * k / n), radius * math.sin(start + 2 * math.pi * k / n)) for k in range(n)]


def star(n: int = 5, ratio: float = 0.4) -> list[tuple[float, float]]:
    return [((0.5 if k % 2 == 0 else 0.5 * ratio) * math.cos(math.pi / 2 + math.pi * k / n), (0.5 if k % 2 == 0 else 0.5 * ratio) * math.sin(math.pi / 2 + math.pi * k / n)) for k in range(2 * n)]


#: Unit symbols, inside the square from -1/2 to 1/2.
SYMBOLS = {
    "circle": regular(32, 0.0),
    "square": [(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)],
    "hexagon": regular(6, math.pi / 2),
    "hexagon_flat": regular(6, 0.0),
    "triangle": regular(3, math.pi / 2),
    "triangle_down": regular(3, -math.pi / 2),
    "diamond": regular(4, 0.0),
    "pentagon": regular(5, math.pi / 2),
    "pentagon_down": regular(5, -math.pi / 2),
    "star": star(),
}


def tile_symbol(pts: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Any outline as a unit symbol: its centroid in the origin, its farthest corner half a unit away."""
    pts = [tuple(p) for p in pts]
    pts = pts[:-1] if pts[0] == pts[-1] else pts
    crossed = [(x0 * y1 - x1 * y0, x0 + x1, y0 + y1) for (x0, y0), (x1, y1) in zip(pts, pts[1:] + pts[:1], strict=True)]
    twice = sum(c for c, _, _ in crossed)
    if abs(twice) < 1e-12:
        raise ValueError("the outline has no area")
    cx, cy = sum(c * x for c, x, _ in crossed) / (3 * twice), sum(c * y for c, _, y in crossed) / (3 * twice)
    far = max(math.hypot(x - cx, y - cy) for x, y in pts)
    return [((x - cx) / far / 2, (y - cy) / far / 2) for x, y in pts]


def transformed_symbol(name: str, rotation: float = 0.0, reflection: bool = False) -> list[tuple[float, float]]:
    """A known symbol mirrored about the vertical axis, if asked, then turned by degrees; it counts as a shape of its own when fitted."""
    c, s = math.cos(math.radians(rotation)), math.sin(math.radians(rotation))
    return [(x * c - y * s, x * s + y * c) for x, y in ((-x if reflection else x, y) for x, y in SYMBOLS[name])]


def add_symbol(name: str, pts: list[tuple[float, float]]) -> str:
    """Make an outline known under a name, for layouts and styles."""
    if name in SYMBOLS and SYMBOLS[name] != pts:
        raise ValueError(f"the symbol {name!r} is there already")
    SYMBOLS[name] = pts
    return name


def bounding_radius(name: str) -> float:
    return max(math.hypot(x, y) for x, y in SYMBOLS[name])


def inscribed_radius(name: str) -> float:
    """Distance of the origin to the outline."""
    pts = SYMBOLS[name]

    def away(a, b):
        (x, y), (u, v) = a, (b[0] - a[0], b[1] - a[1])
        t = min(1.0, max(0.0, -(x * u + y * v) / ((u * u + v * v) or 1.0)))
        return math.hypot(x + t * u, y + t * v)

    return min(away(a, b) for a, b in zip(pts, pts[1:] + pts[:1], strict=True))


def symbol_points(name: str) -> Column:
    """A unit symbol as a closed ring."""
    if name not in SYMBOLS:
        raise ValueError(f"unknown symbol {name!r}; known: {', '.join(SYMBOLS)}")
    pts = SYMBOLS[name]
    return F.array(*(point(x, y) for x, y in [*pts, pts[0]]))


def unit_area(name: str) -> float:
    if name == "circle":
        return math.pi / 4
    pts = SYMBOLS[name]
    return abs(sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(pts, pts[1:] + pts[:1], strict=True))) / 2


def area_factor(name: str) -> float:
    """Half-extent of a symbol whose area is that of a circle, by the circle's radius."""
    return math.sqrt(math.pi / (4 * unit_area(name)))


def lerp(a: Column, b: Column, t: Column) -> Column:
    """Points between two rings of equal length."""
    return F.zip_with(a, b, lambda p, q: point_of(p["x"] + t * (q["x"] - p["x"]), p["y"] + t * (q["y"] - p["y"])))


def drop_small(g: Column, least_part: Column | float, least_hole: Column | float) -> Column:
    """Without exteriors and holes under the given areas; the largest exterior, and the holes of parts that stay, remain."""
    largest = F.array_max(F.transform(F.filter(g["rings"], lambda r: r["sign"] > 0), lambda r: ring_area(r["pts"])))
    parts = F.transform(F.filter(g["rings"], lambda r: (r["sign"] > 0) & ((ring_area(r["pts"]) >= least_part) | (ring_area(r["pts"]) == largest))), lambda r: r["part"])
    rings = F.filter(g["rings"], lambda r: F.array_contains(parts, r["part"]) & ((r["sign"] > 0) | (ring_area(r["pts"]) >= least_hole)))
    return F.struct(g["kind"].alias("kind"), rings.alias("rings"))
