"""Errors of a map whose values arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import measure

#: Windows of one batch that are broadcast.
BROADCAST_WINDOWS = 10_000


def windowed_values(events: DataFrame, region: str, value: str, ts: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, region_id, value): values by region and event-time window; rows later than the watermark are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), F.col(region).alias("region_id")).agg(F.sum(value).alias("value"))


def errors_of_batch(regions: DataFrame, values: DataFrame, map_column: str = "map_id") -> DataFrame:
    """Original-state errors of every window of a batch: each window is a map of its own."""
    named = values.withColumn(map_column, F.col("window.start").cast("string")).select(map_column, "region_id", "value")
    windows = named.select(map_column).distinct()
    # Every window has every region; the windows of a batch are the few, and are counted before they are handed round.
    whole = regions.select("region_id", "geom").crossJoin(F.broadcast(windows) if windows.count() <= BROADCAST_WINDOWS else windows)
    return measure.original_state(whole.join(named, [map_column, "region_id"], "left").fillna(0.0, ["value"]))


def stream_errors(regions: DataFrame, values: DataFrame, sink, checkpoint: str):
    """Writes each finished window's errors through ``sink(DataFrame, batch id)``; replayed batches give the same rows."""
    put = lambda df, epoch: sink(errors_of_batch(regions, df), epoch)
    return values.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put).start()
