"""Labels of the seed fewest steps away inside a map, by tiles that exchange their borders.

Active cells are put into square tiles, one row for each.  A round takes every tile
that got news, walks inside it until nothing gets nearer, and sends the cells
along its four sides that did to the tiles beyond them.  It ends when no tile
has news.  A tile that got none is handed on as it is, and no task ever holds more
than one tile and its neighbours' sides, however large the map is.

A walk goes from a cell's centre to the four beside it.  Of seeds equally far the one
with the smaller id counts.  Cells that no seed can walk to are labelled with the
nearest seed as the crow flies, with null steps.  Of seeds in one cell the smaller
id counts; seeds outside the map start from the nearest active cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .adjacency import _kept
from .fields import nearest_labels
from .grids import Grid

#: Cells along a tile's side.
TILE = 128
FAR = np.iinfo(np.int32).max // 2
ROW = "ty int, tx int, news boolean, active binary, steps binary, label binary"
NEWS = "ty int, tx int, side string, steps binary, label binary"


#: A tile's sides, and for each where the tile beyond it lies and which of its sides it touches.
SIDES = {"low": ((0, slice(None)), -1, 0, "high"), "high": ((-1, slice(None)), 1, 0, "low"), "left": ((slice(None), 0), 0, -1, "right"), "right": ((slice(None), -1), 0, 1, "left")}
STEP = ["kind", "ty", "tx", "news", "active", "steps", "label", "side"]


def _walk(active: np.ndarray, steps: np.ndarray, label: np.ndarray) -> None:
    """Least steps, then least label, of all cells of a tile in place; only cells beside a changed one are looked at again."""
    wave = np.argwhere(active & (steps < FAR))
    ny, nx = active.shape
    while len(wave):
        changed = np.zeros(active.shape, bool)
        for dy, dx in ((1, 0), (-1, 0), (0, 1), (0, -1)):
            y, x = wave[:, 0] + dy, wave[:, 1] + dx
            ok = (y >= 0) & (y < ny) & (x >= 0) & (x < nx)
            y, x, d, n = y[ok], x[ok], steps[wave[ok, 0], wave[ok, 1]] + 1, label[wave[ok, 0], wave[ok, 1]]
            better = active[y, x] & ((d < steps[y, x]) | ((d == steps[y, x]) & (n < label[y, x])))
            y, x = y[better], x[better]
            steps[y, x], label[y, x], changed[y, x] = d[better], n[better], True
        wave = np.argwhere(changed)


def _tiles(cells: DataFrame, seeds: DataFrame, tile: int) -> DataFrame:
    """Tiles (ROW) of active cells (iy, ix), with steps 0 where a seed is."""
    at = {"ty": F.floor(F.col("iy") / tile).cast("int"), "tx": F.floor(F.col("ix") / tile).cast("int")}
    starts = seeds.groupBy("iy", "ix").agg(F.min("site_id").cast("long").alias("seed"))
    marked = cells.select("iy", "ix").join(starts, ["iy", "ix"], "left").withColumns(at)

    def pack(key, rows):
        active, steps, label = np.zeros((tile, tile), bool), np.full((tile, tile), FAR, np.int32), np.full((tile, tile), np.iinfo(np.int64).max)
        y, x = rows["iy"].to_numpy() - key[0] * tile, rows["ix"].to_numpy() - key[1] * tile
        active[y, x] = True
        seeded = rows["seed"].notna().to_numpy()
        steps[y[seeded], x[seeded]] = 0
        label[y[seeded], x[seeded]] = rows["seed"][seeded].astype("int64")
        return pd.DataFrame([(key[0], key[1], bool(seeded.any()), active.tobytes(), steps.tobytes(), label.tobytes())], columns=["ty", "tx", "news", "active", "steps", "label"])

    # Nulls would make a column of doubles of the ids, so these travel as texts.
    return marked.select("ty", "tx", "iy", "ix", F.col("seed").cast("string").alias("seed")).groupBy("ty", "tx").applyInPandas(pack, ROW)


def _unpacked(row, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    of = lambda data, kind: np.frombuffer(data, kind).reshape(tile, tile).copy()
    return of(row.active, bool), of(row.steps, np.int32), of(row.label, np.int64)


def _step(tile: int):
    """A tile and the lines sent to it: the tile after a walk, and the lines that it sends on."""

    def run(key, rows, news):
        if not len(rows):  # nothing of the map lies there
            return pd.DataFrame([], columns=STEP)
        row = next(rows.itertuples())
        if not row.news and not len(news):
            return pd.DataFrame([("tile", row.ty, row.tx, False, row.active, row.steps, row.label, None)], columns=STEP)
        active, steps, label = _unpacked(row, tile)
        before = {} if row.news else {k: (steps[line].copy(), label[line].copy()) for k, (line, *_) in SIDES.items()}
        for x in news.itertuples():
            line, d, n = SIDES[x.side][0], np.frombuffer(x.steps, np.int32) + 1, np.frombuffer(x.label, np.int64)
            better = active[line] & ((d < steps[line]) | ((d == steps[line]) & (n < label[line])))
            steps[line], label[line] = np.where(better, d, steps[line]), np.where(better, n, label[line])
        _walk(active, steps, label)
        out = [("tile", row.ty, row.tx, False, row.active, steps.tobytes(), label.tobytes(), None)]
        for side, (line, dy, dx, other) in SIDES.items():
            s, n = steps[line], label[line]
            old = before.get(side)
            if (s < FAR).any() and not (old and np.array_equal(s, old[0]) and np.array_equal(n, old[1])):
                out.append(("line", row.ty + dy, row.tx + dx, True, None, s.tobytes(), n.tobytes(), other))
        return pd.DataFrame(out, columns=STEP)

    return run


def snapped(seeds: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """(site_id, iy, ix): the active cell that each seed (site_id, x, y) starts from, its own or else the nearest."""
    named = cells.select((F.col("iy").cast("long") * grid.sx + F.col("ix")).alias("site_id"), "x", "y")
    at = lambda c, start, step, n: F.least(F.greatest(F.floor((F.col(c) - start) / step), F.lit(0)), F.lit(n - 1)).cast("int")
    own = seeds.select("site_id", "x", "y", at("y", grid.ymin, grid.dy, grid.sy).alias("iy"), at("x", grid.xmin, grid.dx, grid.sx).alias("ix"))
    homes = own.join(cells.select("iy", "ix", F.lit(True).alias("in")), ["iy", "ix"], "left")
    inside = homes.where("in").select("site_id", "iy", "ix")
    out = homes.where("in is null").select("site_id", F.lit(0).alias("iy"), F.col("site_id").alias("ix"), "x", "y")
    if not out.take(1):
        return inside
    found = nearest_labels(out, named, listed=0)
    return inside.unionByName(found.select(F.col("ix").alias("site_id"), F.expr(f"int(label div {grid.sx})").alias("iy"), F.expr(f"int(label % {grid.sx})").alias("ix")))


def geodesic_labels(cells: DataFrame, seeds: DataFrame, grid: Grid, tile: int = TILE) -> DataFrame:
    """(iy, ix, label, steps) of active cells (iy, ix, x, y) of one map: the seed (site_id, x, y) fewest steps away."""
    cells = _kept(cells.select("iy", "ix", "x", "y"))
    state = _kept(_tiles(cells, snapped(seeds, cells, grid), tile))
    news = state.sparkSession.createDataFrame([], NEWS)
    while True:
        both = state.groupBy("ty", "tx").cogroup(news.groupBy("ty", "tx")).applyInPandas(_step(tile), "kind string, " + ROW + ", side string")
        both = _kept(both)
        state, news = both.where("kind = 'tile'").drop("kind", "side"), both.where("kind = 'line'").select("ty", "tx", "side", "steps", "label")
        if not news.take(1):
            break

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                active, steps, label = _unpacked(row, tile)
                y, x = np.nonzero(active & (steps < FAR))
                yield pd.DataFrame({"iy": row.ty * tile + y, "ix": row.tx * tile + x, "label": label[y, x], "steps": steps[y, x]})

    walked = state.mapInPandas(unpack, "iy int, ix int, label long, steps int")
    left = _kept(cells.join(walked.select("iy", "ix"), ["iy", "ix"], "left_anti"))
    if not left.take(1):
        return walked
    lone = nearest_labels(left, seeds).select("iy", "ix", F.col("label").cast("long").alias("label"), F.lit(None).cast("int").alias("steps"))
    return walked.unionByName(lone)


def ways(cells: DataFrame, labelled: DataFrame) -> DataFrame:
    """(iy, ix, label, steps, to_iy, to_ix): for each walked cell the cell before it on a shortest way from its seed, for a closer look at the field.

    Of several such cells the lower and then the left one.
    """
    held = labelled.where("steps is not null")
    beside = F.array(*(F.struct((F.col("iy") + dy).alias("iy"), (F.col("ix") + dx).alias("ix")) for dy, dx in ((-1, 0), (0, -1), (0, 1), (1, 0))))
    asked = held.where("steps > 0").select("iy", "ix", "label", "steps", F.explode(beside).alias("n")).select("iy", "ix", "label", "steps", F.col("n.iy").alias("to_iy"), F.col("n.ix").alias("to_ix"))
    before = held.select(F.col("iy").alias("to_iy"), F.col("ix").alias("to_ix"), F.col("label"), (F.col("steps") + 1).alias("steps"))
    found = asked.join(before, ["to_iy", "to_ix", "label", "steps"])
    first = found.withColumn("k", F.row_number().over(Window.partitionBy("iy", "ix").orderBy("to_iy", "to_ix"))).where("k = 1")
    start = held.where("steps = 0").select("iy", "ix", "label", "steps", F.lit(None).cast("int").alias("to_iy"), F.lit(None).cast("int").alias("to_ix"))
    return first.select(*start.columns).unionByName(start)
