"""Histories as of any iteration: what a run last recorded at or before it, and series by variable."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recorded(snapshots: DataFrame, asked: DataFrame, keys: list[str], at: str = "iteration") -> DataFrame:
    """(keys, at, recorded): for each asked (keys, at) the last recorded one at or before it; null where there is none.

    Iterations are put in one order with those asked for, so nothing is compared that isn't beside it; keys
    are runs, and a run's rows here are its iterations, not its regions.
    """
    had = snapshots.select(*keys, at).distinct().select(*keys, at, F.col(at).alias("recorded"), F.lit(False).alias("_asked"))
    want = asked.select(*keys, at).distinct().select(*keys, at, F.lit(None).cast(dict(snapshots.dtypes)[at]).alias("recorded"), F.lit(True).alias("_asked"))
    along = Window.partitionBy(*keys).orderBy(at, "_asked").rowsBetween(Window.unboundedPreceding, 0)
    found = had.unionByName(want).withColumn("recorded", F.last("recorded", ignorenulls=True).over(along))
    return found.where("_asked").drop("_asked")


def as_of(snapshots: DataFrame, asked: DataFrame, keys: list[str], at: str = "iteration") -> DataFrame:
    """The snapshots' rows as they stood at each asked (keys, at): its columns with the asked ``at``, and ``recorded``, when they were taken.

    Asked before the first snapshot a run has no rows.
    """
    found = recorded(snapshots, asked, keys, at).where("recorded is not null").withColumnRenamed(at, "_at")
    rows = snapshots.withColumnRenamed(at, "recorded")
    return rows.join(found, [*keys, "recorded"]).withColumnRenamed("_at", at)


def series(snapshots: DataFrame, ids: list[str], variables: list[str]) -> DataFrame:
    """(ids, variable, value): one row for each number of each row, nulls left out."""
    pairs = F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in variables))
    return snapshots.select(*ids, F.inline(pairs)).where("value is not null")


def changes(long: DataFrame, keys: list[str], at: str = "iteration") -> DataFrame:
    """(..., change): beside each value of a long series how far it went since the one before in its run."""
    along = Window.partitionBy(*keys, "variable").orderBy(at)
    return long.withColumn("change", F.col("value") - F.lag("value").over(along))
