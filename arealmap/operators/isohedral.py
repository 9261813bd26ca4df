"""Isohedral tilings whose symmetries are translations and half turns.

An edge marked T has a parallel partner, to which a translation carries it; an
edge marked C is its own image under a half turn about its middle.  With those
two kinds the tile, or the tile and its half turn, fills the plane by a lattice.
Types with glide reflections or turns of other orders are not in the table.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..kernels.shapes import spline

#: Type, its edges round the tile, and corners of a usual tile with them.
TYPES = {
    "ih1": ("TTTTTT", ((0, 0), (1, 0), (1.5, 0.8), (1, 1.6), (0, 1.6), (-0.5, 0.8))),
    "ih4": ("TCCTCC", ((0, 0), (1, 0), (1.5, 0.7), (1.1, 1.6), (0.1, 1.6), (-0.5, 0.9))),
    "ih41": ("TTTT", ((0, 0), (1, 0), (1.3, 1), (0.3, 1))),
    "ih46": ("CCCC", ((0, 0), (1.2, 0.1), (1, 1), (0.2, 0.9))),
    "ih47": ("TCTC", ((0, 0), (1, 0), (1.4, 1), (0.4, 1))),
    "ih84": ("CCC", ((0, 0), (1, 0), (0.4, 0.9))),
}
PRESETS = {
    "bricks": ("ih41", "parallelograms by translation"), "honeycomb": ("ih1", "hexagons by translation"), "kites": ("ih46", "quadrilaterals and their half turns"),
    "triangles": ("ih84", "triangles and their half turns"), "shingles": ("ih47", "two translated and two turned edges"), "waves": ("ih4", "hexagons with turned sides"),
}


def find_types(num_vertices: int | None = None, edges: str | None = None, aspects: int | None = None) -> list[str]:
    """Types by numbers of corners and aspects, and by kinds of edge they have."""
    return [k for k, (kinds, _) in TYPES.items() if (num_vertices is None or len(kinds) == num_vertices) and (edges is None or set(edges) <= set(kinds)) and (aspects is None or (2 if "C" in kinds else 1) == aspects)]


def describe(name: str) -> str:
    kinds, _ = TYPES[name]
    return f"{name}: {len(kinds)} corners, edges {kinds}, {2 if 'C' in kinds else 1} aspect(s)"


@dataclass(frozen=True)
class Isohedral:
    """``curves`` bends edges: control points (along, aside) from 0 to 1 of an edge's length; partners follow."""

    name: str
    corners: tuple[tuple[float, float], ...] = ()
    curves: dict[int, tuple[tuple[float, float], ...]] = field(default_factory=dict)
    samples: int = 100

    @classmethod
    def preset(cls, name: str, **changes) -> Isohedral:
        if name not in PRESETS:
            raise ValueError(f"unknown preset {name!r}; known: {', '.join(PRESETS)}")
        return cls(PRESETS[name][0], **changes)

    def to_dict(self) -> dict:
        return {"version": 1, "tiling_type": self.name, "corners": [list(p) for p in self.corners], "edge_curves": {str(k): [list(p) for p in v] for k, v in self.curves.items()}}

    @classmethod
    def from_dict(cls, told: dict) -> Isohedral:
        return cls(told["tiling_type"], tuple(map(tuple, told["corners"])), {int(k): tuple(map(tuple, v)) for k, v in told["edge_curves"].items()})

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.to_dict(), f)

    @classmethod
    def load(cls, path: str) -> Isohedral:
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(json.load(f))

    def info(self) -> dict:
        """Numbers of corners, aspects and edge kinds, and which corners move freely: the rest follow from the kinds."""
        kinds, pts = self.base()
        partners = {e: (e + len(kinds) // 2) % len(kinds) for e, k in enumerate(kinds) if k == "T"}
        tied = {(p + 1) % len(kinds) for e, p in partners.items() if e < p}
        return {"type": self.name, "num_vertices": len(kinds), "edges": kinds, "num_aspects": 2 if "C" in kinds else 1, "partners": partners, "free_corners": [k for k in range(len(kinds)) if k not in tied], "corners": pts.tolist()}

    def base(self) -> tuple[str, np.ndarray]:
        if self.name not in TYPES:
            raise ValueError(f"unknown type {self.name!r}; known: {', '.join(TYPES)}")
        kinds, usual = TYPES[self.name]
        pts = np.array(self.corners or usual, float)
        if len(pts) != len(kinds):
            raise ValueError(f"{self.name} has {len(kinds)} corners")
        n = len(kinds)
        for e, kind in enumerate(kinds):
            if kind == "T" and not np.allclose(pts[(e + 1) % n] - pts[e], -(pts[(e + n // 2 + 1) % n] - pts[(e + n // 2) % n])):
                raise ValueError(f"edge {e} and its partner must be parallel and of one length")
        return kinds, pts

    def lattice(self) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Two translations, and the centre of the half turn to the second aspect, if there is one."""
        kinds, pts = self.base()
        n = len(kinds)
        middle = (pts + np.roll(pts, -1, axis=0)) / 2
        turns = [middle[e] for e in range(n) if kinds[e] == "C"]
        moves = [middle[(e + n // 2) % n] - middle[e] for e in range(n) if kinds[e] == "T"]
        moves += [2 * (b - a) for k, a in enumerate(turns) for b in turns[k + 1 :]]
        moves.sort(key=lambda v: (round(float(np.hypot(*v)), 9), v.tolist()))
        other = next(v for v in moves[1:] if abs(moves[0][0] * v[1] - moves[0][1] * v[0]) > 1e-9)
        return moves[0], other, turns[0] if turns else None

    def tile(self) -> np.ndarray:
        """Outline of the tile, closed, with its bent edges."""
        kinds, pts = self.base()
        n, lines = len(kinds), {}
        for e in sorted(range(n), key=lambda e: (e not in self.curves, e)):
            if e in lines:
                continue
            a, b = pts[e], pts[(e + 1) % n]
            if e not in self.curves:
                line = np.array([a, b])
            else:
                d = b - a
                aside = np.array([-d[1], d[0]])
                control = np.array([(0.0, 0.0), *self.curves[e], (1.0, 0.0)])
                if kinds[e] == "C":  # the first half decides, the second is its half turn
                    half = np.array([p for p in control if p[0] < 0.5] + [(0.5, 0.0)])
                    control = np.concatenate([half, [(1, 0)] - half[::-1][1:]])
                bent = spline(control, self.samples)
                line = a + bent[:, :1] * d + bent[:, 1:] * aside
            lines[e] = line
            if kinds[e] == "T":
                partner = (e + n // 2) % n
                lines[partner] = (line + (pts[(partner + 1) % n] - a))[::-1]
        ring = np.concatenate([lines[e][:-1] for e in range(n)])
        return np.concatenate([ring, ring[:1]])

    def tiles(self, spark: SparkSession, bounds=(-1.0, -1.0, 1.0, 1.0), tile_size: float = 0.25, margin: float = 0.1) -> DataFrame:
        """(tile_id, i, j, aspect, cx, cy, rotation, geom); a tile has the area of a square of side ``tile_size``."""
        ring, (t1, t2, turn) = self.tile(), self.lattice()
        x, y = ring[:-1].T
        cross = x * np.roll(y, -1) - np.roll(x, -1) * y
        size = tile_size / math.sqrt(abs(cross.sum()) / 2)
        center = np.array([((v + np.roll(v, -1)) * cross).sum() for v in (x, y)]) / (3 * cross.sum())
        ring, t1, t2 = (ring - center) * size, t1 * size, t2 * size
        w, h = (bounds[2] - bounds[0]) * (1 + 2 * margin), (bounds[3] - bounds[1]) * (1 + 2 * margin)
        x0, y0 = bounds[0] - margin * (bounds[2] - bounds[0]), bounds[1] - margin * (bounds[3] - bounds[1])
        middle = np.array([x0 + w / 2, y0 + h / 2])
        # Lattice coordinates that reach every corner of the box.
        inverse = np.linalg.inv(np.column_stack([t1, t2]))
        reach = np.abs(inverse @ (np.array([[w, w], [h, -h]]) / 2)).max(1) + 3
        home = np.round(inverse @ middle).astype(int)
        ni, nj = (int(math.ceil(r)) for r in reach)
        lattice = spark.range((2 * ni + 1) * (2 * nj + 1)).select(F.expr(f"id div {2 * nj + 1} + {home[0] - ni}").alias("i"), F.expr(f"id % {2 * nj + 1} + {home[1] - nj}").alias("j"), "id")
        aspects = [np.zeros(2)] if turn is None else [np.zeros(2), 2 * (turn - center) * size]
        both = lattice.withColumn("aspect", F.explode(F.array(*map(F.lit, range(len(aspects))))))
        at = lambda k: F.col("i") * float(t1[k]) + F.col("j") * float(t2[k]) + (F.when(F.col("aspect") == 1, float(aspects[-1][k])).otherwise(0.0))
        held = both.withColumns({"cx": at(0), "cy": at(1)}).where((F.col("cx") >= x0 - tile_size) & (F.col("cx") <= x0 + w + tile_size) & (F.col("cy") >= y0 - tile_size) & (F.col("cy") <= y0 + h + tile_size))
        sign = F.when(F.col("aspect") == 1, -1.0).otherwise(1.0)
        pts = F.transform(F.array(*(G.point(float(a), float(b)) for a, b in ring)), lambda p: G.point_of(F.col("cx") + sign * p["x"], F.col("cy") + sign * p["y"]))
        return held.select((F.col("id") * 2 + F.col("aspect")).alias("tile_id"), "i", "j", "aspect", "cx", "cy", (F.col("aspect") * 180.0).alias("rotation"), G.geom("Polygon", G.ring(pts)).alias("geom"))
