"""Rollups of a stream of readings: the bucket statistics of ``operators.grids``, on fixed windows of time.

An addition for live feeds.  Medians and tolerances of the batch operators depend on a whole window and have no streaming form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(stream: DataFrame, width: str, late: str) -> DataFrame:
    """Count, mean and extremes per series and window of ``width``; readings later than ``late`` are left out.

    ``stream`` has ``dataset_id, timestamp, value``; windows start at multiples of the width.
    """
    held = stream.withWatermark("timestamp", late)
    made = held.groupBy("dataset_id", F.window("timestamp", width).alias("w")).agg(F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))
    return made.select("dataset_id", F.unix_millis("w.start").alias("start_ms"), "count", "mean", "min_value", "max_value")


def threshold_alerts(stream: DataFrame, above: float, late: str, quiet: str) -> DataFrame:
    """Sessions of readings above a threshold; one ends after ``quiet`` without another (a fixed tolerance)."""
    hits = stream.where(F.col("value") > above).withWatermark("timestamp", late)
    made = hits.groupBy("dataset_id", F.session_window("timestamp", quiet).alias("w")).agg(F.count(F.lit(1)).alias("points"), F.max("value").alias("peak_value"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    return made.select("dataset_id", F.unix_millis("first").alias("start_ms"), F.unix_millis("last").alias("end_ms"), "points", "peak_value")
