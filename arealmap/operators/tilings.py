"""Tilings of the plane as tables of tiles and of their neighbours."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from .grids import HEX_AREA, staggered, steps

DEFAULT_BOUNDS, DEFAULT_TILES = (-1.0, -1.0, 1.0, 1.0), 64


def _area(pts: np.ndarray) -> float:
    x, y = pts[:, 0], pts[:, 1]
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def _centroid(pts: np.ndarray) -> np.ndarray:
    nxt = np.roll(pts, -1, axis=0)
    cross = pts[:, 0] * nxt[:, 1] - nxt[:, 0] * pts[:, 1]
    return ((pts + nxt) * cross[:, None]).sum(0) / (3 * cross.sum())


@dataclass(frozen=True)
class Tiling:
    """A prototile's corners (for squares and hexagons only its name) laid over bounds."""

    name: str
    corners: tuple[tuple[float, float], ...] = ()

    def unit(self) -> np.ndarray:
        """The prototile with area 1 about its centroid."""
        pts = np.array(self.corners)
        pts = pts - _centroid(pts)
        return pts / math.sqrt(_area(pts))

    def size_of(self, bounds, n_tiles: int | None, tile_size: float | None, margin: float) -> float:
        x0, y0, x1, y1 = bounds
        whole = (x1 - x0) * (y1 - y0) * (1 + 2 * margin) ** 2
        n_tiles = DEFAULT_TILES if n_tiles is None else n_tiles
        return tile_size or math.sqrt(whole / n_tiles / (HEX_AREA if self.name == "hexagon" else 1.0))

    def tiles(self, spark: SparkSession, bounds=DEFAULT_BOUNDS, n_tiles: int | None = None, tile_size: float | None = None, margin: float = 0.1) -> DataFrame:
        """(tile_id, i, j, aspect, cx, cy, rotation, flipped, geom): i and j are lattice coordinates."""
        x0, y0, x1, y1 = bounds
        w, h, s = (x1 - x0) * (1 + 2 * margin), (y1 - y0) * (1 + 2 * margin), self.size_of(bounds, n_tiles, tile_size, margin)
        x0, y0 = x0 - margin * (x1 - x0), y0 - margin * (y1 - y0)
        x, y = F.col("cx"), F.col("cy")
        common = [F.lit(0.0).alias("rotation"), F.lit(False).alias("flipped")]
        if self.name == "square":
            nx, ny = steps(w, s), steps(h, s)
            held = spark.range(nx * ny).select(F.col("id").alias("tile_id"), F.expr(f"id % {nx}").alias("i"), F.expr(f"id div {nx}").alias("j"))
            held = held.select("*", F.lit(0).alias("aspect"), (x0 + s / 2 + F.col("i") * s).alias("cx"), (y0 + s / 2 + F.col("j") * s).alias("cy"), *common)
            return held.withColumn("geom", G.box(x - s / 2, y - s / 2, x + s / 2, y + s / 2))
        if self.name == "hexagon":
            dx = s * math.sqrt(3)
            held = staggered(spark, x0, y0, w, h, dx, 1.5 * s, dx / 2)
            # Rows lean half a step each: axial coordinates make all six neighbours fixed offsets.
            held = held.select(F.col("id").alias("tile_id"), (F.col("col") - F.expr("row div 2")).alias("i"), F.col("row").alias("j"), F.lit(0).alias("aspect"), F.col("x").alias("cx"), F.col("y").alias("cy"), *common)
            return held.withColumn("geom", G.geom("Polygon", G.ring(G.place(G.symbol_points("hexagon"), x, y, F.lit(2.0 * s)))))
        one = self.unit() * s
        two, t1, t2 = self._pair(one, s)
        n1, n2 = (math.ceil(max(w, h) / max(float(np.linalg.norm(t)), 1e-10)) + 2 for t in (t1, t2))
        lattice = spark.range((2 * n1 + 1) * (2 * n2 + 1)).select(F.expr(f"id div {2 * n2 + 1} - {n1}").alias("i"), F.expr(f"id % {2 * n2 + 1} - {n2}").alias("j"))
        both = lattice.withColumn("aspect", F.explode(F.array(F.lit(0), F.lit(1))))
        ca, cb = _centroid(one), _centroid(two)
        base = lambda k: F.when(F.col("aspect") == 0, float(ca[k])).otherwise(float(cb[k])) + F.col("i") * float(t1[k]) + F.col("j") * float(t2[k])
        held = both.withColumns({"cx": base(0), "cy": base(1)}).where((x >= x0 - s) & (x <= x0 + w + s) & (y >= y0 - s) & (y <= y0 + h + s))
        held = held.withColumn("tile_id", (F.col("i") + n1) * (2 * (2 * n2 + 1)) + (F.col("j") + n2) * 2 + F.col("aspect"))
        around = lambda pts, c: F.array(*(G.point_of(x + float(px - c[0]), y + float(py - c[1])) for px, py in [*pts.tolist(), pts[0].tolist()]))
        ring = F.when(F.col("aspect") == 0, around(one, ca)).otherwise(around(two, cb))
        return held.select("tile_id", "i", "j", "aspect", "cx", "cy", (F.col("aspect") * 180.0).alias("rotation"), F.lit(False).alias("flipped"), G.geom("Polygon", G.ring(ring)).alias("geom"))

    def _pair(self, one: np.ndarray, s: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tile turned by half about an edge's middle, and the two translations of the pair."""
        n = len(one)
        turned = lambda pts, e: pts[e] + pts[(e + 1) % n] - pts
        if n == 3:
            longest = int(np.argmax([np.linalg.norm(one[(e + 1) % 3] - one[e]) for e in range(3)]))
            rest = [e for e in range(3) if e != longest]
            return turned(one, longest), *(one[(e + 1) % 3] - one[e] for e in rest)
        home = _centroid(one)
        moves = [_centroid(turned(turned(one, e), k)) - home for e in range(n) for k in range(n)]
        moves = sorted((v for v in moves if np.linalg.norm(v) > 0.01 * s), key=lambda v: float(np.linalg.norm(v)))
        other = next((v for v in moves[1:] if abs(moves[0][0] * v[1] - moves[0][1] * v[0]) > 0.01 * s), None)
        if other is None:
            raise ValueError("the prototile has no two independent translations")
        return turned(one, 0), moves[0], other

    def lattice_edges(self, tiles: DataFrame, diagonal: bool = False) -> DataFrame:
        """(src, dst): neighbours across an edge by lattice offsets; of squares the diagonal ones too, if asked."""
        offsets = {"square": [(1, 0), (-1, 0), (0, 1), (0, -1)], "hexagon": [(1, 0), (-1, 0), (0, 1), (0, -1), (-1, 1), (1, -1)]}[self.name]
        if diagonal and self.name == "square":
            offsets = offsets + [(1, 1), (1, -1), (-1, 1), (-1, -1)]
        steps_ = F.explode(F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in offsets))).alias("o")
        asked = tiles.select(F.col("tile_id").alias("src"), "i", "j", steps_).select("src", (F.col("i") + F.col("o.a")).alias("i"), (F.col("j") + F.col("o.b")).alias("j"))
        return asked.join(tiles.select(F.col("tile_id").alias("dst"), F.col("i").cast("long"), F.col("j").cast("long")), ["i", "j"]).select("src", "dst")


SQUARE, HEXAGON = Tiling("square"), Tiling("hexagon")


def triangle(kind: str = "equilateral", value: float | None = None) -> Tiling:
    if kind == "equilateral":
        return Tiling("triangle", ((0, 0), (1, 0), (0.5, math.sqrt(3) / 2)))
    if kind == "right_isosceles":
        return Tiling("triangle", ((0, 0), (1, 0), (0, 1)))
    if kind == "right":
        return Tiling("triangle", ((0, 0), (1, 0), (0, 1.0 if value is None else value)))
    if kind == "isosceles":
        half = math.radians((60.0 if value is None else value) / 2)
        return Tiling("triangle", ((-math.sin(half), 0), (math.sin(half), 0), (0, math.cos(half))))
    raise ValueError(f"unknown triangle {kind!r}")


def quadrilateral(kind: str = "parallelogram", **sizes: float) -> Tiling:
    get = sizes.get
    if kind == "parallelogram":
        turn, side = math.radians(get("angle", 60.0)), get("ratio", 1.0)
        dx, dy = side * math.cos(turn), side * math.sin(turn)
        return Tiling("quadrilateral", ((0, 0), (1, 0), (1 + dx, dy), (dx, dy)))
    if kind == "rectangle":
        height = get("ratio", 1.0)  # of the width
        return Tiling("quadrilateral", ((0, 0), (1, 0), (1, height), (0, height)))
    if kind == "rhombus":
        turn = math.radians(get("angle", 60.0))
        return Tiling("quadrilateral", ((0, 0), (1, 0), (1 + math.cos(turn), math.sin(turn)), (math.cos(turn), math.sin(turn))))
    if kind == "trapezoid":
        off, height = (1 - get("top_ratio", 0.5)) / 2, get("height", 1.0)
        return Tiling("quadrilateral", ((0, 0), (1, 0), (1 - off, height), (off, height)))
    raise ValueError(f"unknown quadrilateral {kind!r}")


def resolve(spec):
    """A tiling, or one by its name: the plain ones, presets and types (``ih41``) of isohedral ones."""
    from . import isohedral

    if isinstance(spec, Tiling | isohedral.Isohedral):
        return spec
    known = {"square": SQUARE, "hexagon": HEXAGON, "triangle": triangle(), "quadrilateral": quadrilateral()}
    if spec in known:
        return known[spec]
    if str(spec).lower() in isohedral.TYPES:
        return isohedral.Isohedral(str(spec).lower())
    if spec in isohedral.PRESETS:
        return isohedral.Isohedral.preset(spec)
    raise ValueError(f"unknown tiling {spec!r}; known: {', '.join([*known, *isohedral.TYPES, *isohedral.PRESETS])}")


def vertex_edges(tiles: DataFrame, tol: float = 1e-6, id_column: str = "tile_id") -> DataFrame:
    """(src, dst, shared): pairs of tiles, src < dst, with the number of corners they share within ``tol``.

    A corner joins the corners of its own and the eight cells around it on a grid of ``tol``, so
    corners on both sides of a rounding border still meet; then distances decide.
    """
    pts = tiles.select(F.col(id_column).alias("t"), F.explode(F.array_distinct(F.flatten(F.transform("geom.rings", lambda r: r["pts"])))).alias("p")).select("t", "p.x", "p.y")
    pts = pts.withColumns({"kx": F.floor(F.col("x") / tol), "ky": F.floor(F.col("y") / tol)})
    near = pts.select("t", "x", "y", "kx", F.explode(F.array(*(F.col("ky") + d for d in (-1, 0, 1)))).alias("ky"))
    near = near.select("t", "x", "y", F.explode(F.array(*(F.col("kx") + d for d in (-1, 0, 1)))).alias("kx"), "ky")
    near = near.withColumnsRenamed({"t": "src", "x": "sx", "y": "sy"})
    met = near.join(pts, ["kx", "ky"]).where((F.col("src") < F.col("t")) & (F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy")) <= tol))
    return met.groupBy("src", F.col("t").alias("dst")).agg(F.countDistinct("sx", "sy").alias("shared"))


def adjacency(tiles: DataFrame, kind: str = "edge", tol: float = 1e-6) -> DataFrame:
    """Pairs across an edge (two shared corners at least), or with ``vertex`` all that touch."""
    held = vertex_edges(tiles, tol)
    return held.where("shared >= 2") if kind == "edge" else held


def rotated(tiles: DataFrame, degrees: float) -> DataFrame:
    """Tiles turned about the origin."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    turn = lambda x, y: (x * c - y * s, x * s + y * c)
    cx, cy = turn(F.col("cx"), F.col("cy"))
    return tiles.withColumns({"cx": cx, "cy": cy, "rotation": F.col("rotation") + degrees, "geom": G.map_points(F.col("geom"), lambda p: G.point_of(*turn(p["x"], p["y"])))})
