"""What became of neighbourhoods and groups, and how tight groups are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .adjacency import components
from .measure import map_keys


def violations(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pairs (i, j) that were neighbours and are not any more."""
    ids = [*map_keys(before), "i", "j"]
    return before.select(*ids).join(after.select(*ids), ids, "left_anti")


def orientation(pairs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(i, j, cosine, misaligned): how far the line between two regions has turned; without a line the cosine is 0."""
    keys = map_keys(pairs)
    at = lambda df, k, n: df.select(*keys, F.col("region_id").alias(k), F.col("x").alias(n + "x"), F.col("y").alias(n + "y"))
    held = pairs.select(*keys, "i", "j")
    for df, n in ((before, "b"), (after, "a")):
        held = held.join(at(df, "i", n + "i"), [*keys, "i"]).join(at(df, "j", n + "j"), [*keys, "j"])
    d = {n + k: F.col(f"{n}j{k}") - F.col(f"{n}i{k}") for n in "ba" for k in "xy"}
    sizes = F.hypot(d["bx"], d["by"]) * F.hypot(d["ax"], d["ay"])
    cosine = F.when(sizes > 0, (d["bx"] * d["ax"] + d["by"] * d["ay"]) / sizes).otherwise(F.lit(0.0))
    return held.select(*keys, "i", "j", cosine.alias("cosine")).withColumn("misaligned", F.col("cosine") <= 0)


def satellites(regions: DataFrame, edges: DataFrame) -> DataFrame:
    """(region_id, grp, component): regions apart from the largest component of their group; of equal ones the one with the smallest id is the main one."""
    keys = map_keys(regions)
    names = regions.select(*keys, "region_id", "grp")
    named = lambda k, g: names.select(*keys, F.col("region_id").alias(k), F.col("grp").alias(g))
    inside = edges.select(*keys, "i", "j").join(named("i", "gi"), [*keys, "i"]).join(named("j", "gj"), [*keys, "j"]).where("gi = gj")
    parts = components(names, inside).join(names, [*keys, "region_id"])
    sizes = parts.groupBy(*keys, "grp", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy(*keys, "grp").agg(F.max_by(F.col("component"), F.struct("n", -F.col("component"))).alias("main"))
    return parts.join(main, [*keys, "grp"]).where("component <> main").select(*keys, "region_id", "grp", "component")


def compactness(cells: DataFrame) -> DataFrame:
    """(region_id, score): squared distance to the plain mean of the group's centroids, by the group's mean of it."""
    center = cells.groupBy("grp").agg(F.avg("x").alias("gx"), F.avg("y").alias("gy"))
    held = cells.join(center, "grp").withColumn("d2", F.pow(F.col("x") - F.col("gx"), 2) + F.pow(F.col("y") - F.col("gy"), 2))
    mean = held.groupBy("grp").agg(F.avg("d2").alias("m"))
    return held.join(mean, "grp").select("region_id", "grp", F.when(F.col("m") > 0, F.col("d2") / F.col("m")).otherwise(F.lit(0.0)).alias("score"))


def convex_hull_input(regions: DataFrame) -> DataFrame:
    """Extreme points by direction: a bounded set whose hull is close to the map's, for outer boundaries."""
    pts = regions.select(F.explode(F.flatten(F.transform("geom.rings", lambda r: r["pts"]))).alias("p")).select("p.x", "p.y")
    import math

    turns = [2 * math.pi * k / 64 for k in range(64)]
    tops = [F.max_by(F.struct("x", "y"), F.col("x") * math.cos(t) + F.col("y") * math.sin(t)) for t in turns]
    return pts.agg(F.array_distinct(F.array(*tops)).alias("pts"))
