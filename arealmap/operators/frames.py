"""Frames of animations: where each frame lies between keyframes, and its rings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G


def progress(spark: SparkSession, n: int) -> DataFrame:
    """(frame, progress): n frames from 0 to 1."""
    return spark.range(n).select(F.col("id").alias("frame"), (F.col("id") / max(1, n - 1)).alias("progress"))


def _bracket(frames: DataFrame, series: DataFrame, decreasing: bool) -> DataFrame:
    """The interval of the series that each frame's value falls in, and the share of it."""
    order = Window.orderBy("idx")
    spans = series.withColumns({"nxt": F.lead("v").over(order)}).where("nxt is not null")
    ends = series.agg(F.min_by("v", "idx").alias("v0"), F.max_by("v", "idx").alias("v1"), F.max("idx").alias("last"), F.min("idx").alias("start"))
    wanted = frames.join(F.broadcast(ends)).withColumn("at", F.col("v0") + F.col("progress") * (F.col("v1") - F.col("v0")))
    inside = (F.col("at") <= F.col("v")) & (F.col("at") >= F.col("nxt")) if decreasing else (F.col("at") >= F.col("v")) & (F.col("at") < F.col("nxt"))
    met = wanted.join(F.broadcast(spans), inside, "left")
    share = F.when(F.col("nxt") == F.col("v"), F.lit(0.0)).otherwise((F.col("at") - F.col("v")) / (F.col("nxt") - F.col("v")))
    place = F.col("idx") + F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    # The first bracket of a decreasing series, the last start of an increasing one.
    pick = (F.min if decreasing else F.max)(F.struct(F.col("idx"), place.alias("place"))).alias("p")
    held = met.groupBy("frame", "progress").agg(pick, F.max("last").alias("last"), F.max("start").alias("start"))
    return held.select("frame", "progress", F.when(F.col("progress") <= 0, F.col("start").cast("double")).otherwise(F.coalesce("p.place", F.col("last").cast("double"))).alias("position"))


def linear_over(frames: DataFrame, series: DataFrame, decreasing: bool = False) -> DataFrame:
    """(frame, progress, position): fractional index at which a metric (idx, v) has gone as far as the progress.  The series of one run is short."""
    return _bracket(frames, series, decreasing)


def by_weights(frames: DataFrame, series: DataFrame) -> DataFrame:
    """(frame, progress, position): each step between keyframes takes time by its weight (idx, w); negative weights count 0."""
    order = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    w = F.greatest("w", F.lit(0.0))
    steps = series.select("idx", w.alias("w")).withColumns({"to": F.sum("w").over(order), "total": F.sum("w").over(whole)})
    share = steps.select("idx", ((F.col("to") - F.col("w")) / F.col("total")).alias("lo"), (F.col("to") / F.col("total")).alias("hi")).where("hi > lo")
    met = frames.join(F.broadcast(share), (F.col("progress") >= F.col("lo")) & ((F.col("progress") < F.col("hi")) | ((F.col("progress") >= 1) & (F.col("hi") >= 1 - 1e-12))))
    place = F.col("idx") + F.least(F.greatest((F.col("progress") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0))
    return met.groupBy("frame", "progress").agg(F.max(place).alias("position"))


def hold(frames: DataFrame, n_keyframes: int, held: int) -> DataFrame:
    """Positions that rest ``held`` frames at each keyframe between linear moves."""
    total = frames.count()
    move = max(1, (total - held * n_keyframes) // max(1, n_keyframes - 1))
    cycle = held + move
    inside = F.col("frame") % cycle
    place = F.floor(F.col("frame") / cycle) + F.greatest((inside - held + 1) / F.lit(float(move + 1)), F.lit(0.0))
    return frames.withColumn("position", F.least(place, F.lit(float(n_keyframes - 1))))


def region_frames(frames: DataFrame, snapshots: DataFrame, interpolation: str = "linear") -> DataFrame:
    """(frame, region_id, geom): rings of each frame from snapshots (idx, region_id, geom) of equal vertex counts."""
    last = snapshots.agg(F.max("idx").alias("top"))
    held = frames.join(F.broadcast(last)).withColumn("i0", F.least(F.floor("position"), F.col("top") - 1).cast("long"))
    held = held.withColumn("i0", F.greatest("i0", F.lit(0))).withColumn("t", F.col("position") - F.col("i0"))
    if interpolation == "nearest":
        held = held.withColumn("t", F.round("t"))
    a = snapshots.select(F.col("idx").alias("i0"), "region_id", F.col("geom").alias("ga"))
    b = snapshots.select((F.col("idx") - 1).alias("i0"), "region_id", F.col("geom").alias("gb"))
    both = held.join(a.join(b, ["i0", "region_id"], "left"), "i0")
    ring = F.zip_with(F.col("ga.rings"), F.col("gb.rings"), lambda p, q: F.struct(p["part"].alias("part"), p["sign"].alias("sign"), G.lerp(p["pts"], q["pts"], F.col("t")).alias("pts")))
    geom = F.when(F.col("gb").isNull(), F.col("ga")).otherwise(F.struct(F.col("ga.kind").alias("kind"), ring.alias("rings")))
    return both.select("frame", "region_id", geom.alias("geom"))


def workflow_series(convergence: DataFrame) -> DataFrame:
    """Runs after one another: ``step`` is the iteration plus the lengths of all runs before."""
    lengths = convergence.groupBy("run_id").agg(F.max("iteration").alias("n"))
    order = Window.orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lengths.withColumn("offset", F.coalesce(F.sum("n").over(order), F.lit(0)))
    return convergence.join(F.broadcast(offsets.select("run_id", "offset")), "run_id").withColumn("step", F.col("iteration") + F.col("offset"))
