"""Borders as tables: chains of edges, shared arcs, and the outline of a whole map.

Regions of a coverage share their vertices.  Every edge is a row; edges are put in
order by pointer jumping (each round doubles how far a row sees), so a ring or an
arc of n edges takes about log2(n) joins and no map passes through one task.
Points are compared after rounding to ``DIGITS`` places.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..kernels import planar as P
from ..kernels.shapes import thin
from .adjacency import _kept, near_boxes
from .measure import map_keys
from .rasters import ring_edges

DIGITS = 9


def numbered(df: DataFrame) -> DataFrame:
    """``df`` written once, with an ``id`` for each row that stays the same from then on."""
    return _kept(df.withColumn("id", F.monotonically_increasing_id()))


def chained(links: DataFrame) -> DataFrame:
    """(id, last, left, low) of (id, next): the end of its chain and the steps to it; in a ring ``last`` is null and ``low`` its least id.

    A row joins the row it points at and takes over that row's pointer.  Open chains end when all
    pointers are gone; rings when no pointer went and no least id fell in a round.
    """
    held = _kept(links.select("id", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("step"), F.col("id").alias("last"), F.lit(0).cast("long").alias("left"), F.col("id").alias("low")))
    state = None
    while True:
        open_, low = held.agg(F.count("next"), F.sum(F.when(F.col("next").isNotNull(), F.col("low").cast("decimal(38,0)")))).first()
        if not open_ or (open_, low) == state:
            break
        state = (open_, low)
        to = held.select(F.col("id").alias("_id"), F.col("next").alias("_next"), F.col("last").alias("_last"), F.col("left").alias("_left"), F.col("step").alias("_step"), F.col("low").alias("_low"))
        met = held.where("next is not null").join(to, F.col("next") == F.col("_id"))
        # ``step`` tells how far ``next`` is; what it knows of its own way comes on top.
        moved = met.select("id", F.col("_next").alias("next"), (F.col("step") + F.col("_step")).alias("step"), F.col("_last").alias("last"), (F.col("step") + F.col("_left")).alias("left"), F.least("low", "_low").alias("low"))
        held = _kept(moved.unionByName(held.where("next is null")))
    return held.select("id", F.when(F.col("next").isNull(), F.col("last")).alias("last"), "left", "low")


def _xy(x: str, y: str) -> Column:
    rounded = lambda c: F.round(c, DIGITS) + F.lit(0.0)  # noqa: E731 - no negative zero
    return F.struct(rounded(x).alias("x"), rounded(y).alias("y"))


def _edges(regions: DataFrame) -> DataFrame:
    """(map_id, region_id, part, sign, ring, seq, a, b) with rounded ends; maps without a name have one."""
    held = ring_edges(regions if map_keys(regions) else regions.withColumn("map_id", F.lit("map")))
    return held.select("map_id", "region_id", "part", "sign", "ring", "seq", _xy("ax", "ay").alias("a"), _xy("bx", "by").alias("b")).where("a <> b")


def _owned(edges: DataFrame) -> DataFrame:
    """(map_id, lo, hi, n, who): every undirected edge once, how often it stands there, and the regions that have it."""
    both = edges.select("map_id", "region_id", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    return both.groupBy("map_id", "lo", "hi").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("region_id")).alias("who"))


def _closed(pts: Column) -> Column:
    return F.concat(pts, F.slice(pts, 1, 1))


def _turn(pts: Column) -> Column:
    """Twice the signed area of a closed ring, positive where it runs counterclockwise; about its own first point, so far-off maps lose no digits."""
    o = pts[0]
    pairs = F.zip_with(F.slice(pts, 1, F.size(pts) - 1), F.slice(pts, 2, F.size(pts) - 1), lambda p, q: (p["x"] - o["x"]) * (q["y"] - o["y"]) - (q["x"] - o["x"]) * (p["y"] - o["y"]))
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def _holds(pts: Column, x: Column, y: Column) -> Column:
    """Whether a closed ring holds a point, by crossings to its right."""
    across = lambda p, q: ((p["y"] <= y) != (q["y"] <= y)) & (x < p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / F.when(q["y"] != p["y"], q["y"] - p["y"]))
    hits = F.zip_with(F.slice(pts, 1, F.size(pts) - 1), F.slice(pts, 2, F.size(pts) - 1), lambda p, q: F.when(across(p, q), 1).otherwise(0))
    return F.aggregate(hits, F.lit(0), lambda s, v: s + v) % 2 == 1


def outline_edges(regions: DataFrame) -> DataFrame:
    """(map_id, a, b): edges that stand once in their map, the map's inside on their left."""
    edges = _edges(regions)
    # A ring may run either way: its own area says which side its region is on.
    ring = ["map_id", "region_id", "ring"]
    ax, ay, bx, by = F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y")
    first = edges.groupBy(*ring).agg(F.min_by("a", "seq").alias("o"))
    moment = (ax - F.col("o.x")) * (by - F.col("o.y")) - (bx - F.col("o.x")) * (ay - F.col("o.y"))
    ways = edges.join(first, ring).groupBy(*ring).agg((F.sum(moment) * F.max("sign") > 0).alias("left"))
    facing = edges.join(ways, ring).select("map_id", F.when(F.col("left"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("left"), F.col("b")).otherwise(F.col("a")).alias("b"))
    once = facing.groupBy("map_id", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.count("*").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
    return once.where("n = 1").select("map_id", "a", "b")


def outline_rings(regions: DataFrame) -> DataFrame:
    """(map_id, ring, sign, pts) of the outline of each map: exteriors counterclockwise, holes clockwise.

    Where several borders meet in a point, each edge goes on along the first border clockwise from the
    way it came, which bounds the same piece of the map, so pieces that touch at a corner stay apart.
    """
    edges = numbered(outline_edges(regions))
    back = F.atan2(F.col("a.y") - F.col("b.y"), F.col("a.x") - F.col("b.x"))
    ahead = F.atan2(F.col("b.y") - F.col("a.y"), F.col("b.x") - F.col("a.x"))
    ends = edges.select("map_id", F.col("b").alias("p"), back.alias("angle"), F.col("id").alias("came"), F.lit(None).cast("long").alias("goes"))
    starts = edges.select("map_id", F.col("a").alias("p"), ahead.alias("angle"), F.lit(None).cast("long").alias("came"), F.col("id").alias("goes"))
    at = Window.partitionBy("map_id", "p")
    # Clockwise from an arrival is down from its angle; below the lowest departure the highest follows.
    below = F.last("goes", ignorenulls=True).over(at.orderBy("angle", F.col("came").isNull()).rowsBetween(Window.unboundedPreceding, -1))
    highest = F.max_by("goes", F.when(F.col("goes").isNotNull(), F.col("angle"))).over(at)
    links = ends.unionByName(starts).withColumn("next", F.coalesce(below, highest)).where("came is not null").select(F.col("came").alias("id"), "next")
    links = _kept(links)
    rings = chained(links).select("id", "low")
    # Each ring is opened before its least edge and counted from there.
    opened = links.join(rings, "id").select("id", F.when(F.col("next") != F.col("low"), F.col("next")).alias("next"))
    placed = chained(opened).select("id", "left").join(rings, "id").join(edges, "id")
    pts = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("left")).alias("k"), "a"))), lambda e: e["a"])
    held = placed.groupBy("map_id", F.col("low").alias("ring")).agg(pts.alias("pts")).withColumn("pts", _closed(F.col("pts")))
    return held.where(F.size("pts") >= 4).select("map_id", "ring", F.signum(_turn(F.col("pts"))).cast("tinyint").alias("sign"), "pts")


def _exteriors_of(rings: DataFrame) -> DataFrame:
    """(hole, ring): the smallest exterior of its map that holds each hole."""
    box = F.struct(F.array_min("pts.x").alias("xmin"), F.array_min("pts.y").alias("ymin"), F.array_max("pts.x").alias("xmax"), F.array_max("pts.y").alias("ymax"))
    near = near_boxes(rings.select("map_id", F.col("ring").alias("region_id"), box.alias("b"), F.lit(0.0).alias("tol"))).select("i", "j")
    one = rings.select("ring", "sign", "pts")
    hole = one.where("sign < 0").select(F.col("ring").alias("hole"), F.col("pts")[0].alias("p"), F.col("pts")[1].alias("q"))
    outer = one.where("sign > 0").select("ring", "pts", _turn(F.col("pts")).alias("size"))
    pairs = near.select(F.col("i").alias("hole"), F.col("j").alias("ring")).unionByName(near.select(F.col("j").alias("hole"), F.col("i").alias("ring")))
    # The middle of a hole's edge: a corner may be an exterior's corner too.
    mid = lambda c: (F.col(f"p.{c}") + F.col(f"q.{c}")) / 2
    inside = pairs.join(hole, "hole").join(outer, "ring").where(_holds(F.col("pts"), mid("x"), mid("y")))
    return inside.groupBy("hole").agg(F.min_by("ring", "size").alias("ring"))


def union_outline(regions: DataFrame) -> DataFrame:
    """(map_id, geom): the outline of each map, every piece with its holes; of rings alike in size the one with the smaller first point goes first."""
    rings = _kept(outline_rings(regions))
    homes = rings.where("sign > 0").select(F.col("ring").alias("own"), "ring").unionByName(_exteriors_of(rings).select(F.col("hole").alias("own"), "ring"))
    sizes = rings.where("sign > 0").select(F.col("ring").alias("home"), _turn(F.col("pts")).alias("size"), F.col("pts")[0].alias("first"))
    held = rings.join(homes.select(F.col("own").alias("ring"), F.col("ring").alias("home")), "ring").join(sizes, "home")
    order = F.struct((-F.col("size")).alias("size"), "first", "home", (-F.col("sign")).alias("hole"), F.col("pts")[0].alias("start"), "sign", "pts")
    listed = held.groupBy("map_id").agg(F.array_sort(F.collect_list(order)).alias("all"))
    heads = F.transform(F.filter("all", lambda r: r["sign"] > 0), lambda r: r["home"])
    ring = lambda r: F.struct((F.array_position(F.col("heads"), r["home"]) - 1).cast("int").alias("part"), r["sign"].alias("sign"), r["pts"].alias("pts"))
    kind = F.when(F.size("heads") > 1, "MultiPolygon").otherwise("Polygon")
    return listed.withColumn("heads", heads).select("map_id", F.struct(kind.alias("kind"), F.transform("all", ring).alias("rings")).alias("geom"))


def _hulls(shape: DataFrame, by: list[str]) -> DataFrame:
    """(map_id, pts): the hull of each group's points."""

    def run(rows):
        import numpy as np
        import pandas as pd

        pts = np.concatenate([np.array([(p["x"], p["y"]) for p in x]) for x in rows["pts"]])
        return pd.DataFrame({"map_id": rows["map_id"].iloc[:1], "pts": [[{"x": a, "y": b} for a, b in P.hull(pts).tolist()]]})

    return shape.groupBy(*by).applyInPandas(run, f"map_id string, pts array<{G.POINT}>")


#: Regions whose hull one task makes before hulls are joined up.
HULL_ROWS = 4096


def outline(regions: DataFrame, spec: str = "union") -> DataFrame:
    """(map_id, geom): each map's own outline, its bounds, a circle of its area about their middle, or its hull.

    The hull is made of the hulls of ``HULL_ROWS`` regions at a time, then of what is left of these.
    """
    held = regions if map_keys(regions) else regions.withColumn("map_id", F.lit("map"))
    if spec == "union":
        return union_outline(held)
    if spec == "convex_hull":
        pts = held.select("map_id", F.flatten("geom.rings.pts").alias("pts")).where(F.size("pts") > 0)
        parts = held.groupBy("map_id").agg(F.ceil(F.count("*") / HULL_ROWS).alias("n"))
        dealt = pts.join(parts, "map_id").withColumn("part", F.pmod(F.xxhash64("pts"), "n"))
        whole = _hulls(_hulls(dealt.select("map_id", "part", "pts"), ["map_id", "part"]), ["map_id"])
        return whole.select("map_id", G.geom("Polygon", G.ring(F.col("pts"))).alias("geom"))
    b = held.select("map_id", G.bounds(F.col("geom")).alias("b"), G.area(F.col("geom")).alias("area"))
    b = b.groupBy("map_id").agg(F.min("b.xmin").alias("x0"), F.min("b.ymin").alias("y0"), F.max("b.xmax").alias("x1"), F.max("b.ymax").alias("y1"), F.sum("area").alias("area"))
    if spec == "bbox":
        return b.select("map_id", G.box(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))).alias("geom"))
    if spec != "circle":
        raise ValueError("an outline is the union, convex_hull, bbox or circle")
    turn = lambda k: k * (2 * 3.141592653589793 / 128)
    r = F.sqrt(F.col("area") / 3.141592653589793)
    pts = F.transform(F.sequence(F.lit(0), F.lit(128)), lambda k: G.point_of((F.col("x0") + F.col("x1")) / 2 + r * F.cos(turn(k)), (F.col("y0") + F.col("y1")) / 2 + r * F.sin(turn(k))))
    return b.select("map_id", G.geom("Polygon", G.ring(pts)).alias("geom"))


def _nodes(owned: DataFrame) -> DataFrame:
    """(map_id, p): points where arcs end, as other than two edges meet there or the regions along the border change."""
    at = owned.select("map_id", F.col("lo").alias("p"), "who").unionByName(owned.select("map_id", F.col("hi").alias("p"), "who"))
    met = at.groupBy("map_id", "p").agg(F.count("*").alias("n"), F.min("who").alias("one"), F.max("who").alias("other"))
    return met.where("n <> 2 or one <> other").select("map_id", "p")


def _links(halves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, next) of directed edges, two to every edge: on across each point that is no node, but not back."""
    inner = halves.join(nodes, (halves["map_id"] == nodes["map_id"]) & (halves["b"] == nodes["p"]), "left_anti")
    out = halves.select(F.col("map_id").alias("_map"), F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("id").alias("next"))
    on = inner.join(out, (F.col("map_id") == F.col("_map")) & (F.col("b") == F.col("_a")) & (F.col("a") != F.col("_b"))).select("id", "next")
    return halves.select("id").join(on, "id", "left")


def _arcs_of(halves: DataFrame, found: DataFrame) -> DataFrame:
    """(map_id, who, pts) of the chains that end; each comes once in either direction, the one that is the smaller list of points stays."""
    placed = found.where("last is not null").join(halves, "id")
    steps = F.array_sort(F.collect_list(F.struct((-F.col("left")).alias("k"), "a", "b")))
    lines = placed.groupBy("map_id", "last").agg(F.first("who").alias("who"), steps.alias("e"))
    pts = F.concat(F.transform("e", lambda s: s["a"]), F.slice(F.transform("e", lambda s: s["b"]), -1, 1))
    return lines.select("map_id", "who", pts.alias("pts")).where(F.col("pts") <= F.reverse("pts"))


def arcs(regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(map_id, who, pts) of the borders between nodes, each once, and (map_id, p) of the nodes.

    A ring without a node is cut in two: at its least point, and at the point farthest from that (the smaller of several).
    """
    owned = _kept(_owned(_edges(regions)))
    nodes = _kept(_nodes(owned))
    two = owned.select("map_id", "who", F.col("lo").alias("a"), F.col("hi").alias("b")).unionByName(owned.select("map_id", "who", F.col("hi").alias("a"), F.col("lo").alias("b")))
    halves = numbered(two)
    found = _kept(chained(_links(halves, nodes)))
    lines = _arcs_of(halves, found)
    loose = found.where("last is null").select("id", "low")
    if loose.take(1):
        ringed = _kept(halves.join(loose, "id"))
        least = ringed.groupBy("low").agg(F.min("a").alias("o"))
        d2 = F.pow(F.col("a.x") - F.col("o.x"), F.lit(2.0)) + F.pow(F.col("a.y") - F.col("o.y"), F.lit(2.0))
        far = ringed.join(least, "low").groupBy("map_id", "low").agg(F.min("o").alias("o"), F.min(F.struct((-d2).alias("d"), "a")).alias("f"))
        cuts = far.select("map_id", F.col("o").alias("p")).unionByName(far.select("map_id", F.col("f.a").alias("p"))).distinct()
        rings = ringed.drop("low")
        lines = lines.unionByName(_arcs_of(rings, chained(_links(rings, cuts))))
        nodes = nodes.unionByName(cuts)
    return _kept(lines), nodes


def simplify(regions: DataFrame, tolerance: float, outer: bool = True) -> DataFrame:
    """(map_id, region_id, geom): every border simplified once, whichever regions share it, so neighbours still fit.

    Arcs are rows, thinned one by one, and put into the rings that run along them, either way.  Rings
    that fall under three points go, a region without rings has no geometry.  Borders of the map
    itself stay as they are unless ``outer``.
    """
    regions = regions.withColumn("map_id", F.col("map_id").cast("string") if map_keys(regions) else F.lit("map"))
    lines, _ = arcs(regions)

    def run(batches):
        for batch in batches:
            out = []
            for pts, who in zip(batch.column("pts").to_pylist(), batch.column("who").to_pylist(), strict=True):
                out.append(pts if len(who) == 1 and not outer else [{"x": x, "y": y} for x, y in thin(_points(pts), tolerance**2).tolist()])
            yield pa.RecordBatch.from_arrays([batch.column("map_id"), batch.column("pts"), pa.array(out, batch.schema.field("pts").type)], ["map_id", "pts", "kept"])

    done = _kept(lines.mapInArrow(run, f"map_id string, pts array<{G.POINT}>, kept array<{G.POINT}>"))
    heads = done.select(F.col("map_id").alias("_map"), F.col("pts")[0].alias("_a"), F.col("pts")[1].alias("_b"), "kept")
    tails = done.select(F.col("map_id").alias("_map"), F.element_at("pts", -1).alias("_a"), F.element_at("pts", -2).alias("_b"), F.reverse("kept").alias("kept"))
    edges = _edges(regions)
    ways = heads.unionByName(tails)
    # An edge that starts an arc brings the arc with it, but for its last point, which the next arc brings.
    along = edges.join(ways, (edges["map_id"] == ways["_map"]) & (edges["a"] == ways["_a"]) & (edges["b"] == ways["_b"]))
    stretch = F.struct("seq", F.slice("kept", 1, F.size("kept") - 1).alias("pts"))
    rings = along.groupBy("map_id", "region_id", "ring", "part", "sign").agg(F.array_sort(F.collect_list(stretch)).alias("s")).withColumn("pts", F.flatten(F.col("s.pts"))).where(F.size("pts") >= 3)
    ring = F.struct("ring", "part", "sign", _closed(F.col("pts")).alias("pts"))
    whole = rings.groupBy("map_id", "region_id").agg(F.array_sort(F.collect_list(ring)).alias("rings"))
    bare = F.transform("rings", lambda r: F.struct(r["part"].alias("part"), r["sign"].alias("sign"), r["pts"].alias("pts")))
    kind = F.when(F.size(F.array_distinct("rings.part")) > 1, "MultiPolygon").otherwise("Polygon")
    out = whole.select("map_id", "region_id", F.struct(kind.alias("kind"), bare.alias("rings")).alias("geom"))
    return regions.select("map_id", "region_id").join(out, ["map_id", "region_id"], "left")


def _points(pts: list) -> object:
    import numpy as np

    return np.array([(p["x"], p["y"]) for p in pts], float)
