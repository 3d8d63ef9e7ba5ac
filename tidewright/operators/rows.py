"""Rows of series: outliers, intervals and gaps, flat lines, previews, the viewer's reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.scalar import GAP_FACTOR, median_interval
from tidewright.plans.frames import ID, previous, quantiles, running

IQR_MULTIPLIER = 1.5
FLAT_LEAST = 10
SPARK_POINTS = 60


def top(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first rows of each series; Spark keeps no more than these per task before it shuffles."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(ID).orderBy(*order))).where(F.col("place") <= limit)


def bounds(series: DataFrame, multiplier: float = IQR_MULTIPLIER) -> DataFrame:
    """Quartiles and the fence around them."""
    if multiplier < 0:
        raise ValueError("the multiplier must not be negative")
    found = quantiles(series, "value", [0.25, 0.5, 0.75], [F.count(F.lit(1)).alias("row_count")])
    q1, q3 = F.col("q")[0], F.col("q")[2]
    return found.select(ID, "row_count", q1.alias("q1"), F.col("q")[1].alias("median"), q3.alias("q3"), (q1 - multiplier * (q3 - q1)).alias("lower"), (q3 + multiplier * (q3 - q1)).alias("upper"))


def _fenced(series: DataFrame, multiplier: float) -> DataFrame:
    fence = bounds(series, multiplier).withColumnRenamed(ID, "b_id")
    away = F.greatest(F.col("lower") - F.col("value"), F.col("value") - F.col("upper"), F.lit(0.0))
    return series.join(fence, F.col(ID) == F.col("b_id")).withColumn("deviation", away)


def outliers(series: DataFrame, multiplier: float = IQR_MULTIPLIER, limit: int | None = None) -> DataFrame:
    """Rows outside the fence, farthest first; all of them, or the first ``limit`` of each series."""
    found = _fenced(series, multiplier).where("deviation > 0").select(ID, "ts_ms", "seq", "value", "deviation")
    return top(found, limit, F.desc("deviation"), F.col("ts_ms"), F.col("seq")) if limit else found


def inliers(series: DataFrame, multiplier: float = IQR_MULTIPLIER) -> DataFrame:
    return _fenced(series, multiplier).where("deviation = 0").select(ID, "ts_ms", "value", "seq")


def intervals(series: DataFrame) -> DataFrame:
    """Median gap (equal time stamps included, whole ms), 95th percentile, extremes (both without), and the number of equal time stamps."""
    gap = previous(series, ["ts_ms"]).select(ID, (F.col("ts_ms") - F.col("prev")["ts_ms"]).alias("gap")).withColumn("real", F.when(F.col("gap") > 0, F.col("gap")))
    aggregates = [F.count(F.lit(1)).alias("row_count"), F.min("real").alias("min_ms"), F.max("real").alias("max_ms"),
        F.coalesce(F.sum(F.when(F.col("gap") == 0, 1).otherwise(0)), F.lit(0)).cast("long").alias("duplicate_timestamps")]
    middle = quantiles(gap, "gap", [0.5], aggregates)
    high = quantiles(gap, "real", [0.95], name="h").withColumnRenamed(ID, "h_id")
    whole = lambda c: F.floor(c).cast("long")
    return middle.join(high, F.col(ID) == F.col("h_id")).select(ID, "row_count", F.coalesce(whole(F.col("q")[0]), F.lit(0).cast("long")).alias("median_ms"),
        whole(F.col("h")[0]).alias("p95_ms"), "min_ms", "max_ms", "duplicate_timestamps")


def gaps(series: DataFrame, limit: int | None = None) -> DataFrame:
    """Intervals over five times the median, longest first."""
    middle = median_interval(series).withColumnRenamed(ID, "m_id")
    step = previous(series, ["ts_ms"]).where("prev IS NOT NULL").select(ID, F.col("prev")["ts_ms"].alias("start_ms"), F.col("ts_ms").alias("end_ms"))
    found = step.join(middle, F.col(ID) == F.col("m_id")).withColumn("duration_ms",
        F.col("end_ms") - F.col("start_ms")).where((F.col("interval_ms") > 0) & (F.col("duration_ms") > GAP_FACTOR * F.col("interval_ms")))
    found = found.select(ID, "start_ms", "end_ms", "duration_ms")
    return top(found, limit, F.desc("duration_ms"), F.col("start_ms")) if limit else found


def flatlines(series: DataFrame, least: int = FLAT_LEAST, limit: int | None = None) -> DataFrame:
    """Runs of at least so many equal values, longest first."""
    held = previous(series, ["value"])
    changed = F.col("prev").isNull() | (F.col("prev")["value"] != F.col("value"))
    runs = running(held.withColumn("changed", changed).drop("prev"), F.col("changed"), "run").groupBy(ID, "run").agg(F.min("ts_ms").alias("start_ms"),
        F.max("ts_ms").alias("end_ms"), F.min("value").alias("value"), F.count(F.lit(1)).alias("count"))
    found = runs.where(F.col("count") >= least).select(ID, "start_ms", "end_ms", "value", "count")
    return top(found, limit, F.desc("count"), F.col("start_ms")) if limit else found


def preview(series: DataFrame, limit: int = 20) -> DataFrame:
    """The first rows of each series in stored order; 20 for a limit of 0 or less, 200 at most."""
    return top(series, min(limit, 200) if limit > 0 else 20, F.col("seq"), F.col("ts_ms"))


def readings(series: DataFrame) -> DataFrame:
    """Finite readings in time order, with their place from 0."""
    finite = series.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    return running(finite, F.lit(True), "place").withColumn("place", F.col("place") - 1).select(ID, "place", "ts_ms", "value")


def sparkline(series: DataFrame, points: int = SPARK_POINTS) -> DataFrame:
    """Means of at most ``points`` buckets of neighbouring rows, by place; short series row by row."""
    rows = readings(series)
    size = rows.groupBy(ID).agg(F.count(F.lit(1)).alias("n")).withColumnRenamed(ID, "n_id")
    bucket = F.when(F.col("n") <= points, F.col("place")).otherwise(F.floor((F.col("place") * points + (points - 1)) / F.col("n"))).cast("long")
    return rows.join(size, F.col(ID) == F.col("n_id")).groupBy(ID, bucket.alias("bucket")).agg(F.avg("value").alias("mean"))
