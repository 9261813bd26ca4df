"""Cartograms as DataFrame functions: relational preparation, one solver task per map, relational results.

Regions are (map_id, region_id, value, geom) rows.  Maps are independent, so a cluster
works on as many at once as it has cores; inside a map the solvers are global by nature.
Every row of a solver's output names its kind; the parts are split into tables afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import geometry as G
from ..kernels import assign as A
from ..kernels import circles as C
from ..kernels import flow as L
from ..kernels import partition as S
from ..kernels import planar as P
from ..kernels import repair as R
from ..kernels import voronoi as V
from ..kernels.raster import poisson_velocity
from ..operators import adjacency, borders, history, measure, styling, tilings, topology
from ..sources import manifest


def with_map(regions: DataFrame) -> DataFrame:
    """Regions of one map get a name for it; names are texts."""
    return regions.withColumn("map_id", F.col("map_id").cast("string") if "map_id" in regions.columns else F.lit("map"))


SOLVED = f"kind string, map_id string, run_id int, iteration int, region_id long, status string, mean_log_error double, max_log_error double, log_error double, geom {G.GEOM}, x double, y double, seconds double, shape array<int>, rho array<double>, vx array<double>, vy array<double>, mask array<int>"


@dataclass
class FlowResult:
    """Tables of a flow: final regions, convergence, snapshots, and points carried along."""

    rows: DataFrame

    @property
    def regions(self) -> DataFrame:
        held = self.rows.where("kind = 'region'").select("map_id", "run_id", "iteration", "region_id", "geom", "log_error")
        return held.withColumn("_morph_error_pct", measure.error_pct(F.col("log_error")))

    @property
    def snapshots(self) -> DataFrame:
        return self.rows.where("kind = 'snapshot'").select("map_id", "run_id", "iteration", "region_id", "geom")

    @property
    def convergence(self) -> DataFrame:
        held = self.rows.where("kind = 'step'").select("map_id", "run_id", "iteration", "status", "mean_log_error", "max_log_error")
        pct = lambda c: (F.pow(F.lit(2.0), F.col(c)) - 1) * 100
        return held.withColumns({"mean_error_pct": pct("mean_log_error"), "max_error_pct": pct("max_log_error")})

    @property
    def points(self) -> DataFrame:
        """Where the points ended, run by run."""
        return self.rows.where("kind = 'point'").select("map_id", "run_id", F.col("region_id").alias("point_id"), "x", "y")

    @property
    def point_snapshots(self) -> DataFrame:
        return self.rows.where("kind = 'carried'").select("map_id", "run_id", "iteration", F.col("region_id").alias("point_id"), "x", "y")

    @property
    def fields(self) -> DataFrame:
        """(map_id, run_id, iteration, iy, ix, rho, vx, vy, geom_idx) of the snapshots, where ``save_internals`` is set."""
        held = self.rows.where("kind = 'field'").select("map_id", "run_id", "iteration", "shape", F.posexplode(F.arrays_zip("rho", "vx", "vy", "mask")).alias("k", "c"))
        return held.select("map_id", "run_id", "iteration", F.expr("int(k div shape[1])").alias("iy"), F.expr("int(k % shape[1])").alias("ix"), "c.rho", "c.vx", "c.vy", F.col("c.mask").alias("geom_idx"))

    @property
    def timings(self) -> DataFrame:
        """(map_id, run_id, phase, seconds): where a run's time went."""
        return self.rows.where("kind = 'phase'").select("map_id", "run_id", F.col("status").alias("phase"), "seconds")

    def at(self, *iterations: int) -> DataFrame:
        """(map_id, run_id, iteration, recorded, region_id, geom): every run's regions as they last stood at these iterations."""
        return history.as_of(self.snapshots, self._asked(iterations), ["map_id", "run_id"])

    def points_at(self, *iterations: int) -> DataFrame:
        return history.as_of(self.point_snapshots, self._asked(iterations), ["map_id", "run_id"])

    def errors_at(self, *iterations: int) -> DataFrame:
        """(map_id, run_id, iteration, recorded, status, errors): the last step at or before these iterations."""
        return history.as_of(self.convergence, self._asked(iterations), ["map_id", "run_id"])

    def _asked(self, iterations) -> DataFrame:
        runs = self.convergence.select("map_id", "run_id").distinct()
        return runs.withColumn("iteration", F.explode(F.array(*(F.lit(i).cast("int") for i in iterations))))

    def series(self, *variables: str) -> DataFrame:
        """(map_id, run_id, iteration, variable, value) of the errors, in long form."""
        return history.series(self.convergence, ["map_id", "run_id", "iteration"], list(variables or ("mean_log_error", "max_log_error", "mean_error_pct", "max_error_pct")))

    def density(self, regions: DataFrame, value: str = "value") -> DataFrame:
        """(map_id, run_id, iteration, region_id, density) of the snapshots: value by area."""
        named = with_map(regions).select("map_id", F.col("region_id").cast("long").alias("region_id"), F.col(value).cast("double").alias("v"))
        return self.snapshots.join(named, ["map_id", "region_id"]).select("map_id", "run_id", "iteration", "region_id", (F.col("v") / G.area(F.col("geom"))).alias("density"))


def _solve_flow(key: tuple, regions: pd.DataFrame, points: pd.DataFrame, options: L.Options, value: str, run_id: int, grids=None) -> pd.DataFrame:
    regions = regions.sort_values("region_id")
    shapes = [P.rings_of(g) for g in regions["geom"]]
    ids, values = regions["region_id"].to_numpy(), regions[value].to_numpy(float)
    density = values.sum() / regions["_area0"].sum() if "_area0" in regions else None
    extra = points[["x", "y"]].to_numpy(float) if points is not None and len(points) else None
    out, base = [], dict.fromkeys(["iteration", "region_id", "status", "mean_log_error", "max_log_error", "log_error", "geom", "x", "y", "seconds", "shape", "rho", "vx", "vy", "mask"]) | {"map_id": key[0]}
    for k, grid in enumerate(grids or [options.grid]):
        held = options.with_(grid=grid) if grid is not None else options
        found = L.solve(shapes, values, held, density, extra)
        shapes, extra, run = found.shapes, found.points if extra is not None else None, run_id + k
        last = len(found.series)
        out += [base | {"kind": "step", "run_id": run, "iteration": i, "status": found.status if i == last else L.RUNNING, "mean_log_error": m, "max_log_error": x} for i, m, x in found.series]
        for i, snap in found.snapshots:
            out += [base | {"kind": "snapshot", "run_id": run, "iteration": i, "region_id": r, "geom": P.to_geom(s)} for r, s in zip(ids, snap, strict=True)]
        for i, rho, vx, vy, mask in found.fields:
            out.append(base | {"kind": "field", "run_id": run, "iteration": i, "shape": list(rho.shape), "rho": rho.ravel(), "vx": vx.ravel(), "vy": vy.ravel(), "mask": mask.ravel()})
        out += [base | {"kind": "phase", "run_id": run, "status": phase, "seconds": t} for phase, t in found.timings.items()]
        if points is not None:
            for i, at in found.carried:
                out += [base | {"kind": "carried", "run_id": run, "iteration": i, "region_id": r, "x": x, "y": y} for r, (x, y) in zip(points["point_id"], at, strict=True)]
        out += [base | {"kind": "region", "run_id": run, "iteration": found.iterations, "region_id": r, "geom": P.to_geom(s), "log_error": e} for r, s, e in zip(ids, shapes, found.logs, strict=True)]
        if extra is not None:
            out += [base | {"kind": "point", "run_id": run, "region_id": r, "x": x, "y": y} for r, (x, y) in zip(points["point_id"], extra, strict=True)]
        if found.status == L.CONVERGED:
            break
    return pd.DataFrame(out)[[c.split(" ")[0] for c in SOLVED.split(f", geom {G.GEOM}")[0].split(", ")] + ["geom", "x", "y", "seconds", "shape", "rho", "vx", "vy", "mask"]]


def flow(regions: DataFrame, value: str = "value", options: L.Options = L.Options(), points: DataFrame | None = None, run_id: int = 1, grids=None) -> FlowResult:
    """Carry every map's borders along density-levelling flow; ``points`` (map_id, point_id, x, y) ride along.

    ``grids`` makes it a run per grid, coarse to fine, up to the first that converges.
    """
    held = with_map(regions)
    if options.prescale_components:
        held = with_map(adjacency.prescale(held, adjacency.components(held, adjacency.pairs(held)), value)).drop("component", "scale")
    chosen = held.select("map_id", F.col("region_id").cast("long").alias("region_id"), value, "geom", *(["_area0"] if "_area0" in held.columns else []))
    if points is None:
        rows = chosen.groupBy("map_id").applyInPandas(lambda key, x: _solve_flow(key, x, None, options, value, run_id, grids), SOLVED)
    else:
        rows = chosen.groupBy("map_id").cogroup(with_map(points).groupBy("map_id")).applyInPandas(lambda key, x, p: _solve_flow(key, x, p, options, value, run_id, grids), SOLVED)
    # All tables of a result come from one solve: it is kept, not repeated for each of them.
    return FlowResult(adjacency._kept(rows))


def multiresolution(regions: DataFrame, value: str = "value", min_resolution: int = 128, levels: int = 3, margin: float = 0.5, square: bool = True, options: L.Options = L.Options()) -> FlowResult:
    """Coarse to fine over doubled grids; the bounds of all maps together make the grids."""
    from ..operators.grids import multilevel
    from ..operators.vertices import total_bounds

    b = total_bounds(regions.drop("map_id") if "map_id" in regions.columns else regions).first()
    grids = multilevel((b.xmin, b.ymin, b.xmax, b.ymax), min_resolution, levels, margin, square)
    if not grids:
        raise ValueError("the map is too narrow for grids of this resolution")
    return flow(regions, value, options, grids=grids)


class Workflow:
    """Runs on runs: run 0 is the original, each further one starts from the last geometry, with the original target density."""

    def __init__(self, regions: DataFrame, value: str = "value", scale: float = 1.0):
        self.value, self.scale = value, scale
        self.original = with_map(regions).withColumn("region_id", F.col("region_id").cast("long"))
        self.results: list[FlowResult] = []
        #: The options of each run.
        self.options: list[L.Options] = []

    def save(self, path: str) -> int:
        """The original map, every run's rows and the runs' options, as one save of ``sources.manifest``."""
        tables = {"original": self.original} | {f"run{k}": x.rows for k, x in enumerate(self.results)}
        return manifest.save_run(path, tables, kind="workflow", value=self.value, scale=self.scale, runs=len(self.results), options=self.options)

    @classmethod
    def load(cls, spark, path: str, number: int | None = None) -> Workflow:
        """A saved workflow, to be gone on with."""
        tables, told = manifest.load_run(spark, path, number)
        if told.get("kind") != "workflow":
            raise ValueError("the save isn't a workflow's")
        out = cls(tables["original"], told["value"], told["scale"])
        out.results = [FlowResult(tables[f"run{k}"]) for k in range(told["runs"])]
        out.options = told["options"]
        return out

    def state(self) -> DataFrame:
        return measure.original_state(self.original, self.value, self.scale)

    def _latest(self) -> DataFrame:
        held = self.original.withColumn("_area0", G.area(F.col("geom")))
        if not self.results:
            return held
        last = self.results[-1].regions
        run = last.groupBy("map_id").agg(F.max("run_id").alias("run_id"))
        return held.drop("geom").join(last.join(run, ["map_id", "run_id"]).select("map_id", "region_id", "geom"), ["map_id", "region_id"])

    def morph(self, options: L.Options = L.Options(), **changes) -> FlowResult:
        self.results.append(flow(self._latest(), self.value, options.with_(**changes), run_id=len(self.results) + 1))
        self.options.append(options.with_(**changes))
        return self.results[-1]

    def morph_multiresolution(self, min_resolution: int = 128, levels: int = 3, margin: float = 0.5, square: bool = True, options: L.Options = L.Options(), **changes) -> FlowResult:
        """Coarse to fine from the last geometry; the levels together are one step of the workflow."""
        held = self._latest()
        self.results.append(multiresolution(held, self.value, min_resolution, levels, margin, square, options.with_(**changes)))
        self.options.append(options.with_(**changes))
        return self.results[-1]

    def pop(self, n: int = 1) -> None:
        if n > len(self.results):
            raise ValueError("the original state stays")
        del self.results[len(self.results) - n :], self.options[len(self.options) - n :]

    def reset(self) -> None:
        self.results.clear()
        self.options.clear()

    def convergence(self) -> DataFrame:
        if not self.results:
            raise ValueError("nothing has run yet")
        out = self.results[0].convergence
        for x in self.results[1:]:
            out = out.unionByName(x.convergence)
        return out

    def table(self) -> DataFrame:
        """Source columns with the latest geometry, its error and its density."""
        held = measure.with_errors(measure.per_map(self._latest().withColumn("area", G.area(F.col("geom"))), _v=F.sum(self.value), _a=F.sum("_area0")).withColumn("target_area", F.col(self.value) * F.col("_a") / F.col("_v")), "area", "target_area")
        return held.withColumn("_morph_error_pct", F.col("error_pct")).withColumn("_morph_density", F.col(self.value) / (F.col("area") * self.scale)).drop("_v", "_a", "_area0", "log_error", "error_pct")


def partition(regions: DataFrame, columns: list[str], method: str = "shrink", normalization: str | None = None, invert: bool = False, **options) -> DataFrame:
    """``geometry_<column>`` of each column's share of the region, and ``geometry_complement`` if any row has a rest.

    Fractions are relational; each row's cutting is its own, in Arrow batches.
    """
    held = measure.fractions(regions, columns, normalization, invert)
    rest = held.agg(F.max("f_complement")).first()[0] > 1e-9
    names = [*columns, "complement"] if rest else list(columns)
    shares = [f"f_{c}" for c in names]

    def run(batches):
        for batch in batches:
            out = [[] for _ in names]
            for g, *f in zip(batch.column("geom").to_pylist(), *(batch.column(c).to_pylist() for c in shares), strict=True):
                for k, part in enumerate(S.parts(P.rings_of(g), f, method, **options)):
                    out[k].append(P.to_geom(part) if part else None)
            kind = batch.schema.field("geom").type
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, kind) for x in out)], [*batch.schema.names, *(f"geometry_{c}" for c in names)])

    more = StructType.fromDDL(", ".join(f"`geometry_{c}` {G.GEOM}" for c in names))
    return held.mapInArrow(run, StructType([*held.schema.fields, *more.fields]))


def dot_density(regions: DataFrame, columns: list[str], n_dots: int = 100, normalization: str | None = None, invert: bool = False, seed: int = 0) -> DataFrame:
    """(x, y, category, original_index, value): dots inside each region, seeded by region and category, so any task may draw them."""
    counted = measure.dot_counts(regions, columns, n_dots, normalization, invert).where("geom is not null and dots > 0")
    counted = counted.withColumn("seed", F.abs(F.xxhash64(F.lit(seed), "region_id", "category")))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                pts = S.dots(P.rings_of(row["geom"]), row["dots"], row["seed"])
                n = len(pts)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(pts[:, 0]), pa.array(pts[:, 1]), pa.array([row["category"]] * n, pa.string()), pa.array([row["region_id"]] * n, pa.int64()), pa.array([row["value"]] * n, pa.float64())], ["x", "y", "category", "original_index", "value"])

    chosen = counted.select(F.col("region_id").cast("long").alias("region_id"), "category", "dots", "value", "geom", "seed")
    return chosen.mapInArrow(run, "x double, y double, category string, original_index long, value double")


def check_topology(regions: DataFrame) -> DataFrame:
    """Regions whose rings cross themselves or are degenerate."""

    def run(batches):
        for batch in batches:
            ids, bad = batch.column("region_id").to_pylist(), []
            for g in batch.column("geom").to_pylist():
                rings = P.rings_of(g)
                bad.append(not rings or any(P.ring_area(p) == 0 for _, _, p in rings) or P.crossing_segments(rings))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, b in zip(ids, bad, strict=True) if b], pa.int64())], ["region_id"])

    return regions.select(F.col("region_id").cast("long").alias("region_id"), "geom").mapInArrow(run, "region_id long")


LAYOUTS: dict[str, object] = {}


def register_layout(name: str):
    """Adds a layout: a function of positions, sizes, dense adjacency and options to new positions and what it tells of its run
    (``iterations``, ``converged``, and ``series`` of up to three numbers a step); positions alone will do."""

    def put(f):
        LAYOUTS[name] = f
        return f

    return put


@register_layout("physics")
def _physics(pos, radii, near, **o):
    return C.physics(pos, radii, near, C.PhysicsOptions(**o))


@register_layout("packing")
def _packing(pos, radii, near, **o):
    return C.packing(pos, radii, near, C.PackingOptions(**o))


LAYOUTS["topology"] = LAYOUTS["packing"]


@register_layout("centroid")
def _centroid(pos, radii, near, remove_overlap: bool = False, spacing: float = 0.05, **o):
    return C.resolve_overlaps(pos, radii, spacing, global_step=0.0, max_iterations=o.get("max_iterations", 200))[0] if remove_overlap else pos


def _dense(ids: np.ndarray, edges: pd.DataFrame) -> np.ndarray:
    at = {r: k for k, r in enumerate(ids.tolist())}
    out = np.zeros((len(ids), len(ids)))
    for s, d, w in zip(edges["src"], edges["dst"], edges["weight"], strict=True):
        if s in at and d in at:
            out[at[s], at[d]] = w
    return out


LAID = "kind string, map_id string, region_id long, x double, y double, size double, x0 double, y0 double, iteration int, a double, b double, c double, status string"


@dataclass
class LayoutResult:
    """Tables of a layout: places of the symbols, the run's numbers step by step, how it ended, and what it was made with."""

    rows: DataFrame
    made: dict | None = None

    def save(self, path: str) -> int:
        """Rows and what the layout was made with, as one save of ``sources.manifest``."""
        return manifest.save_run(path, {"rows": self.rows}, kind="layout", made=self.made)

    @classmethod
    def load(cls, spark, path: str, number: int | None = None) -> LayoutResult:
        tables, told = manifest.load_run(spark, path, number)
        if told.get("kind") != "layout":
            raise ValueError("the save isn't a layout's")
        return cls(tables["rows"], told["made"])

    @property
    def places(self) -> DataFrame:
        """(map_id, region_id, x, y, size, x0, y0, scale)"""
        return measure.layout_transforms(self.rows.where("kind = 'symbol'").select("map_id", "region_id", "x", "y", "size", "x0", "y0"))

    @property
    def history(self) -> DataFrame:
        """(map_id, iteration, a, b, c): of physics the overlaps, the fastest speed and the widest gap; of packing drift and jitter."""
        return self.rows.where("kind = 'step'").select("map_id", "iteration", "a", "b", "c")

    @property
    def status(self) -> DataFrame:
        """(map_id, status, iterations)"""
        return self.rows.where("kind = 'end'").select("map_id", "status", F.col("iteration").alias("iterations"))


def layout_result(regions: DataFrame, value: str | None = None, name: str = "physics", mode: str = "binary", edges: DataFrame | None = None, options: dict | None = None, **sizes) -> LayoutResult:
    """Symbols placed by a registered layout; one task per map."""
    if name not in LAYOUTS:
        raise ValueError(f"unknown layout {name!r}; known: {', '.join(LAYOUTS)}")
    held = with_map(regions).withColumn("region_id", F.col("region_id").cast("long"))
    prepared = measure.layout_input(held, value, **sizes).select("map_id", "region_id", "x", "y", "size")
    if edges is None:
        edges = adjacency.weights(held, adjacency.pairs(held), mode)
    elif "map_id" not in edges.columns:  # edges of regions whose maps have no names
        edges = edges.join(held.select(F.col("region_id").alias("src"), "map_id"), "src")
    edges = edges.select("map_id", "src", "dst", "weight")
    place, given = LAYOUTS[name], options or {}
    names = [c.split(" ")[0] for c in LAID.split(", ")]

    def run(key, rows, near):
        rows = rows.sort_values("region_id")
        pos, ids, sizes_ = rows[["x", "y"]].to_numpy(float), rows["region_id"].to_numpy(), rows["size"].to_numpy(float)
        found = place(pos, sizes_, _dense(ids, near), **given)
        new, info = found if isinstance(found, tuple) else (found, {"iterations": 0, "converged": True})
        base = dict.fromkeys(names) | {"map_id": key[0]}
        out = [base | {"kind": "symbol", "region_id": i, "x": p[0], "y": p[1], "size": s, "x0": q[0], "y0": q[1]} for i, p, q, s in zip(ids, new, pos, sizes_, strict=True)]
        out += [base | {"kind": "step", "iteration": k + 1} | dict(zip("abc", map(float, step), strict=False)) for k, step in enumerate(info.get("series", []))]
        out.append(base | {"kind": "end", "iteration": info["iterations"], "status": L.CONVERGED if info.get("converged", True) else L.COMPLETED})
        return pd.DataFrame(out)[names]

    made = {"layout": name, "value": value, "mode": mode, "options": given, "sizes": sizes}
    return LayoutResult(adjacency._kept(prepared.groupBy("map_id").cogroup(edges.groupBy("map_id")).applyInPandas(run, LAID)), made)


def layout(regions: DataFrame, value: str | None = None, name: str = "physics", mode: str = "binary", edges: DataFrame | None = None, options: dict | None = None, **sizes) -> DataFrame:
    """(map_id, region_id, x, y, size, x0, y0, scale) of ``layout_result``."""
    return layout_result(regions, value, name, mode, edges, options, **sizes).places


#: What the usual kinds of symbol cartograms are made of.
SYMBOL_PRESETS = {
    "dorling": {"layout": "physics", "options": {"compactness": 0.5}, "symbol": "circle"},
    "topology_preserving": {"layout": "packing", "options": {"topology_weight": 0.5}, "symbol": "circle"},
    "demers": {"tiling": "square", "symbol": "square"},
    "tile_map": {"tiling": "hexagon", "symbol": "hexagon"},
    "fast": {"layout": "physics", "options": {"max_iterations": 100, "tolerance": 1e-3}},
    "quality": {"layout": "physics", "options": {"max_iterations": 1000, "tolerance": 1e-5, "compactness": 0.5}},
}


@dataclass
class SymbolCartogram:
    """A layout, its symbols, and the style they have; ``restyle`` keeps the layout."""

    regions: DataFrame
    places: DataFrame
    symbols: DataFrame
    history: DataFrame | None = None
    status: DataFrame | None = None
    #: What the symbols were styled with, and the rules for single ones.
    style: dict | None = None
    rules: DataFrame | None = None
    made: dict | None = None

    def save(self, path: str) -> int:
        """Regions, places, the run's numbers and rules, with layout and style, as one save of ``sources.manifest``; symbols are made again."""
        tables = {k: v for k, v in (("regions", self.regions), ("places", self.places), ("history", self.history), ("status", self.status), ("rules", self.rules)) if v is not None}
        return manifest.save_run(path, tables, kind="symbols", style=self.style, made=self.made)

    @classmethod
    def load(cls, spark, path: str, number: int | None = None) -> SymbolCartogram:
        tables, told = manifest.load_run(spark, path, number)
        if told.get("kind") != "symbols":
            raise ValueError("the save isn't a symbol cartogram's")
        bare = cls(tables["regions"], tables["places"], tables["places"], tables.get("history"), tables.get("status"), made=told["made"])
        return bare.restyle(tables.get("rules"), **told["style"])

    def restyle(self, rules: DataFrame | None = None, symbol: str = "circle", fit_mode: str = "inside", canonical: str = "circle", **style) -> SymbolCartogram:
        shown = styling.symbols(styling.overrides(self.places.drop("scale"), rules, symbol, **style), canonical, fit_mode)
        return replace(self, symbols=shown, style={"symbol": symbol, "fit_mode": fit_mode, "canonical": canonical} | style, rules=rules)

    def table(self) -> DataFrame:
        """The source's columns beside each symbol."""
        return self.symbols.join(self.regions.withColumn("region_id", F.col("region_id").cast("long")).drop("geom"), "region_id")

    def displacements(self) -> DataFrame:
        """(region_id, dx, dy): from a region's centre to its symbol."""
        return self.places.select("region_id", (F.col("x") - F.col("x0")).alias("dx"), (F.col("y") - F.col("y0")).alias("dy"))


def symbol_cartogram(regions: DataFrame, value: str | None = None, preset: str | None = None, rules: DataFrame | None = None, **changes) -> SymbolCartogram:
    """A whole symbol cartogram by a preset, or by ``layout`` and ``options``, or ``tiling``, and ``symbol``."""
    if preset is not None and preset not in SYMBOL_PRESETS:
        raise ValueError(f"unknown preset {preset!r}; known: {', '.join(SYMBOL_PRESETS)}")
    chosen = {"symbol": "circle"} | (SYMBOL_PRESETS[preset] if preset else {"layout": "physics"}) | changes
    if "tiling" in chosen:
        found, history, status = grid_layout(regions, value, chosen["tiling"]), None, None
    else:
        laid = layout_result(regions, value, chosen["layout"], options=chosen.get("options"))
        found, history, status = laid.places, laid.history, laid.status
    return SymbolCartogram(regions, found, found, history, status, made=chosen | {"value": value}).restyle(rules, chosen["symbol"])


def modulate(cells: DataFrame, grid, step) -> DataFrame:
    """Velocity modulators over cells (iy, ix, vx, vy, geom_idx), density modulators over (iy, ix, rho, geom_idx, target); one field a task."""
    velocity = "vx" in cells.columns
    names = ["vx", "vy"] if velocity else ["rho"]

    def run(rows):
        rows = rows.sort_values(["iy", "ix"])
        fields = [rows[c].to_numpy(float).reshape(grid.sy, grid.sx) for c in names]
        mask = rows["geom_idx"].to_numpy().reshape(grid.sy, grid.sx)
        out = step(*fields, grid, mask) if velocity else (step(*fields, grid, mask, float(rows["target"].iloc[0])),)
        return pd.DataFrame({"iy": rows["iy"], "ix": rows["ix"], **{c: x.ravel() for c, x in zip(names, out, strict=True)}})

    return cells.groupBy(F.lit("").alias("one")).applyInPandas(run, "iy int, ix int, " + ", ".join(f"{c} double" for c in names))


def velocity_field(cells: DataFrame, grid, along_x: float = 1.0, along_y: float = 1.0) -> DataFrame:
    """(iy, ix, vx, vy): the flow that levels densities (iy, ix, rho), periodic; one field a task, since its Fourier transform needs all of it."""

    def run(rows):
        rows = rows.sort_values(["iy", "ix"])
        vx, vy = poisson_velocity(rows["rho"].to_numpy(float).reshape(grid.sy, grid.sx), grid.dx, grid.dy, along_x, along_y)
        return pd.DataFrame({"iy": rows["iy"], "ix": rows["ix"], "vx": vx.ravel(), "vy": vy.ravel()})

    return cells.groupBy(F.lit("").alias("one")).applyInPandas(run, "iy int, ix int, vx double, vy double")


def assign(costs: DataFrame) -> DataFrame:
    """(map_id, i, j) of least total cost, each i with a j of its own, from (map_id, i, j, cost); a pair without a cost is not allowed."""

    def run(key, rows):
        table = rows.pivot(index="i", columns="j", values="cost")
        cost = table.to_numpy(float)
        # No cost that is there adds up to one that is not.
        cost = np.where(np.isnan(cost), np.nansum(np.abs(cost)) + 1, cost)
        return pd.DataFrame({"map_id": key[0], "i": table.index.to_numpy(), "j": table.columns.to_numpy()[A.least_cost(cost)]})

    return with_map(costs).groupBy("map_id").applyInPandas(run, "map_id string, i long, j long")


def tile_hops(edges: DataFrame) -> DataFrame:
    """(map_id, i, j, hops): steps between all tiles of a map over its edges (i, j); tiles out of reach have no row."""

    def run(key, rows):
        ids = np.unique(np.concatenate([rows["i"], rows["j"]]))
        near = np.zeros((len(ids), len(ids)), bool)
        a, b = np.searchsorted(ids, rows["i"]), np.searchsorted(ids, rows["j"])
        near[a, b] = near[b, a] = True
        steps = A.hops(near)
        i, j = np.nonzero(steps < len(ids))
        return pd.DataFrame({"map_id": key[0], "i": ids[i], "j": ids[j], "hops": steps[i, j]})

    return with_map(edges).groupBy("map_id").applyInPandas(run, "map_id string, i long, j long, hops int")


def tile_repairs(placed: DataFrame, edges: DataFrame, real_holes: int = 0) -> DataFrame:
    """(region_id, tile_id) with empty tiles inside the map filled: of placed (region_id, tile_id) and edges (i, j) between tiles."""

    def run(key, rows, near):
        rows = rows.sort_values("region_id")
        ids = np.unique(np.concatenate([near["i"], near["j"], rows["tile_id"]]))
        links = np.zeros((len(ids), len(ids)), bool)
        a, b = np.searchsorted(ids, near["i"]), np.searchsorted(ids, near["j"])
        links[a, b] = links[b, a] = True
        found = A.fill_holes(np.searchsorted(ids, rows["tile_id"]), links, real_holes)
        return pd.DataFrame({"region_id": rows["region_id"], "tile_id": ids[found]})

    return placed.groupBy(F.lit("").alias("one")).cogroup(edges.groupBy(F.lit("").alias("one"))).applyInPandas(run, "region_id long, tile_id long")


def moving_stats(series: DataFrame, window: float = 20, adaptive: bool = True) -> DataFrame:
    """(iteration, mean, variance) of a run's values (iteration, v): exponential, as the simulators watch their steps."""

    def run(rows):
        rows, held, out = rows.sort_values("iteration"), C.MovingStats(window, adaptive), []
        for v in rows["v"].to_numpy(float):
            mean = held.update(np.array([v]))
            out.append((mean[0], held.var[0]))
        return pd.DataFrame({"iteration": rows["iteration"], "mean": [x[0] for x in out], "variance": [x[1] for x in out]})

    return series.groupBy(F.lit("").alias("one")).applyInPandas(run, "iteration int, mean double, variance double")


#: Tiles of one map, whose hops and costs one task holds.
MOST_TILES = 8192


def grid_layout(regions: DataFrame, value: str | None = None, tiling: str | tilings.Tiling = "square", spacing: float = 0.0, fill_holes: bool = True, fix_islands: bool = True, real_holes: int = 0, **weights) -> DataFrame:
    """(map_id, region_id, tile_id, x, y, size, x0, y0, scale): one tile for each region of one map.

    Tiles are as large as the largest symbol; bounds grow until they hold twice as many as there are regions.
    """
    chosen = tilings.resolve(tiling)
    held = with_map(regions).withColumn("region_id", F.col("region_id").cast("long"))
    prepared = measure.layout_input(held, value).select("map_id", "region_id", "x", "y", "size")
    from ..operators.vertices import total_bounds

    b = total_bounds(held.drop("map_id")).first()
    n, largest = prepared.agg(F.count("*"), F.max("size")).first()
    side = (2 * largest if chosen.name in ("square", "ih41") else largest * 2 / 3**0.5) * (1 + spacing)
    w, h = b.xmax - b.xmin, b.ymax - b.ymin
    grow = max(1.0, (2 * n * side * side * (1 if chosen.name != "hexagon" else 2.598) / (w * h)) ** 0.5)
    cx, cy = (b.xmin + b.xmax) / 2, (b.ymin + b.ymax) / 2
    box = (cx - grow * w / 2, cy - grow * h / 2, cx + grow * w / 2, cy + grow * h / 2)
    tiles = chosen.tiles(held.sparkSession, box, tile_size=side, margin=0.0).select("tile_id", "cx", "cy", "geom")
    if tiles.count() > MOST_TILES:
        raise ValueError(f"a tile map has {MOST_TILES} tiles at most: its assignment compares all with all regions in one task")
    touching = tilings.vertex_edges(tiles, side * 0.01)
    listed = tiles.select("tile_id", "cx", "cy").toPandas().sort_values("tile_id")  # a tiling is of the map's own size
    pairs = touching.toPandas()
    at = {t: k for k, t in enumerate(listed["tile_id"].tolist())}
    edges, corners = np.zeros((len(at), len(at)), bool), np.zeros((len(at), len(at)), bool)
    for s, d, k in zip(pairs["src"], pairs["dst"], pairs["shared"], strict=True):
        (edges if k >= 2 else corners)[[at[s], at[d]], [at[d], at[s]]] = True
    centers, ids = listed[["cx", "cy"]].to_numpy(float), listed["tile_id"].to_numpy()
    near = adjacency.weights(held, adjacency.pairs(held), "binary")

    def run(key, rows, links):
        rows = rows.sort_values("region_id")
        pos, dense = rows[["x", "y"]].to_numpy(float), _dense(rows["region_id"].to_numpy(), links)
        found = A.to_tiles(pos, centers, dense, edges, corners, **weights)
        found = A.fill_holes(found, edges, real_holes) if fill_holes else found
        found = A.join_islands(found, edges, centers, dense) if fix_islands else found
        return pd.DataFrame({"map_id": key[0], "region_id": rows["region_id"].to_numpy(), "tile_id": ids[found], "x": centers[found, 0], "y": centers[found, 1], "size": float(largest), "x0": pos[:, 0], "y0": pos[:, 1]})

    placed = prepared.groupBy("map_id").cogroup(near.groupBy("map_id")).applyInPandas(run, "map_id string, region_id long, tile_id long, x double, y double, size double, x0 double, y0 double")
    return measure.layout_transforms(placed)


CELLS = f"kind string, map_id string, region_id long, iteration int, x double, y double, area_cv double, movement double, repaired int, geom {G.GEOM}"


@dataclass
class VoronoiResult:
    """Tables of a relaxation: cells, convergence, snapshots of seeds (and cells), and what repairs did."""

    rows: DataFrame
    weight: str | None = None

    @property
    def cells(self) -> DataFrame:
        return self.rows.where("kind = 'cell'").select("map_id", "region_id", "x", "y", "geom")

    @property
    def convergence(self) -> DataFrame:
        return self.rows.where("kind = 'step'").select("map_id", "iteration", "area_cv", "movement", "repaired")

    @property
    def snapshots(self) -> DataFrame:
        return self.rows.where("kind = 'snapshot'").select("map_id", "iteration", "region_id", "x", "y", "geom")

    def errors(self, regions: DataFrame) -> DataFrame:
        """Cells beside their regions' columns, with the area's deviation from its share in per cent."""
        named = self.cells.join(with_map(regions).withColumn("region_id", F.col("region_id").cast("long")).drop("geom", "x", "y"), ["map_id", "region_id"])
        return measure.area_errors(named.withColumn("area", G.area(F.col("geom"))), "area", self.weight)

    def repair_report(self, regions: DataFrame, before: DataFrame, group: str | None = None) -> DataFrame:
        """(what, before, after): broken neighbourhoods, turned directions and stray regions of other cells and of these."""
        out = None
        for what, a, b in ((k, x, y) for (k, x), (_, y) in zip(analyze(regions, before, group).items(), analyze(regions, self.cells, group).items(), strict=True)):
            bad = (lambda df: df.where("misaligned")) if what == "orientation" else (lambda df: df)
            one = bad(a).agg(F.count("*").alias("before")).join(bad(b).agg(F.count("*").alias("after"))).select(F.lit(what).alias("what"), "before", "after")
            out = one if out is None else out.unionByName(one)
        return out


def voronoi(regions: DataFrame, options: V.Options = V.Options(), weight: str | None = None, group: str | None = None, boundary: str = "union", repair_stages: tuple[str, ...] | None = ()) -> tuple[DataFrame, DataFrame]:
    """(cells, convergence) of ``voronoi_result``."""
    found = voronoi_result(regions, options, weight, group, boundary, repair_stages)
    return found.cells, found.convergence


def voronoi_result(regions: DataFrame, options: V.Options = V.Options(), weight: str | None = None, group: str | None = None, boundary: str = "union", repair_stages: tuple[str, ...] | None = ()) -> VoronoiResult:
    """Each region's cell (map_id, region_id, x, y, geom), and each iteration's area variation; one task per map.

    ``repair_stages`` permutes regions among the finished cells: () for none, None for the usual stages.
    """
    held = with_map(regions).withColumn("region_id", F.col("region_id").cast("long"))
    if weight is not None and held.where(~(F.col(weight) > 0)).take(1):
        raise ValueError("weights must be above 0")
    pairs = adjacency.pairs(held).select("map_id", "i", "j")
    chosen = held.select("map_id", "region_id", "geom", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), (F.col(group).cast("string") if group else F.lit("")).alias("grp"))

    def run(key, rows, near):
        rows = rows.sort_values("region_id")
        shapes, ids = [P.rings_of(g) for g in rows["geom"]], rows["region_id"].to_numpy()
        at = {r: k for k, r in enumerate(ids.tolist())}
        links = np.array([(at[i], at[j]) for i, j in zip(near["i"], near["j"], strict=True)], int).reshape(-1, 2)
        seeds = np.array([P.centroid(s) for s in shapes])
        for k, s in enumerate(shapes):  # a centre outside its region gives way to a point inside
            if not P.contains(s, seeds[k : k + 1, 0], seeds[k : k + 1, 1])[0]:
                inner = S.dots(s, 1, int(ids[k]))
                seeds[k] = inner[0] if len(inner) else seeds[k]
        groups = rows["grp"].to_numpy() if group else None
        field, series = V.solve(seeds, V.outer(shapes, boundary), options, rows["w"].to_numpy(float) if weight else None, links, groups)
        cells, slot = field.cells(), np.arange(len(ids))
        if repair_stages is None or repair_stages:
            slot = R.repair(len(ids), field.touching(), links, groups, seeds, field.seeds, repair_stages)
        base = dict.fromkeys(["region_id", "iteration", "x", "y", "area_cv", "movement", "repaired", "geom"]) | {"map_id": key[0]}
        out = [base | {"kind": "cell", "region_id": r, "x": field.seeds[slot[k], 0], "y": field.seeds[slot[k], 1], "geom": P.to_geom(cells[slot[k]])} for k, r in enumerate(ids)]
        out += [base | {"kind": "step", "iteration": i, "area_cv": cv, "movement": m, "repaired": n} for i, cv, m, n in series]
        for i, at, held in field.snapshots:
            out += [base | {"kind": "snapshot", "iteration": i, "region_id": r, "x": at[k, 0], "y": at[k, 1], "geom": P.to_geom(held[k]) if held else None} for k, r in enumerate(ids)]
        return pd.DataFrame(out)[["kind", "map_id", "region_id", "iteration", "x", "y", "area_cv", "movement", "repaired", "geom"]]

    return VoronoiResult(adjacency._kept(chosen.groupBy("map_id").cogroup(pairs.groupBy("map_id")).applyInPandas(run, CELLS)), weight)


def outline(regions: DataFrame, spec: str = "union") -> DataFrame:
    """(map_id, geom): the outer boundary that cells are laid in: the map's own, its hull, its bounds, or a circle of its area."""

    return borders.outline(with_map(regions).select(F.col("map_id").cast("string").alias("map_id"), "region_id", "geom"), spec)


def analyze(regions: DataFrame, cells: DataFrame, group: str | None = None) -> dict[str, DataFrame]:
    """What the cells lost: neighbours that part, directions that turn, groups that fall apart."""
    keys = measure.map_keys(regions)
    after = adjacency.pairs(cells if keys else cells.drop("map_id"), min_tolerances=2.0)
    regions = with_map(regions) if keys else regions
    before = adjacency.pairs(regions)
    ids = regions.select(*keys, F.col("region_id").cast("long").alias("region_id"), *([F.col(group).alias("grp")] if group else []), G.centroid(F.col("geom")).alias("c"))
    kept = before.drop("shared_len").join(after.drop("shared_len"), [*keys, "i", "j"])
    at = ids.select(*keys, "region_id", "c.x", "c.y")
    out = {"violated": topology.violations(before, after), "orientation": topology.orientation(kept, at, cells.select(*keys, "region_id", "x", "y"))}
    if group:
        out["satellites"] = topology.satellites(ids.select(*keys, "region_id", "grp"), after)
    return out


def make_groups_contiguous(regions: DataFrame, group: str, passes: int = 20) -> DataFrame:
    """(map_id, region_id, cell_id): regions permuted among the map's own shapes so that groups hang together."""
    held = with_map(regions).withColumn("region_id", F.col("region_id").cast("long"))
    pairs = adjacency.pairs(held).select("map_id", "i", "j")

    def run(key, rows, near):
        rows = rows.sort_values("region_id")
        ids = rows["region_id"].to_numpy()
        at = {r: k for k, r in enumerate(ids.tolist())}
        links = R.links_of(len(ids), [(at[i], at[j]) for i, j in zip(near["i"], near["j"], strict=True)])
        slot = R.contiguity(np.arange(len(ids)), rows["grp"].to_numpy(), links, passes)
        return pd.DataFrame({"map_id": key[0], "region_id": ids, "cell_id": ids[slot]})

    return held.select("map_id", "region_id", F.col(group).alias("grp")).groupBy("map_id").cogroup(pairs.groupBy("map_id")).applyInPandas(run, "map_id string, region_id long, cell_id long")


def simplify(regions: DataFrame, tolerance: float, min_island: float | None = None, min_hole: float | None = None, outer: bool = True) -> DataFrame:
    """Every map's coverage simplified, shared borders once, arc by arc (``operators.borders``); islands and holes under the squares of the given sides go first, but no region goes whole."""
    held = with_map(regions).withColumn("map_id", F.col("map_id").cast("string")).withColumn("region_id", F.col("region_id").cast("long"))
    if min_island is not None or min_hole is not None:
        held = held.withColumn("geom", G.drop_small(F.col("geom"), (min_island or 0.0) ** 2, (min_hole or 0.0) ** 2))
    return held.drop("geom").join(borders.simplify(held.select("map_id", "region_id", "geom"), tolerance, outer), ["map_id", "region_id"])


def interpolate(a: DataFrame, b: DataFrame, t: float) -> DataFrame:
    """(region_id, geom): shapes between two states of the same regions; rings that differ in points are resampled."""
    from ..kernels.shapes import blend

    both = a.select(F.col("region_id").cast("long").alias("region_id"), F.col("geom").alias("ga")).join(b.select(F.col("region_id").cast("long").alias("region_id"), F.col("geom").alias("gb")), "region_id")

    def run(batches):
        for batch in batches:
            out = []
            for x, y in zip(batch.column("ga").to_pylist(), batch.column("gb").to_pylist(), strict=True):
                same = x["kind"].removeprefix("Multi") == y["kind"].removeprefix("Multi")
                # Kinds that can't blend change half way.
                out.append(P.to_geom(blend(P.rings_of(x), P.rings_of(y), t)) if same else (x if t < 0.5 else y))
            yield pa.RecordBatch.from_arrays([batch.column("region_id"), pa.array(out, batch.schema.field("ga").type)], ["region_id", "geom"])

    return both.mapInArrow(run, f"region_id long, geom {G.GEOM}")
