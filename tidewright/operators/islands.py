"""Stretches of neighbouring readings: events and anomalous episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.rows import IQR_MULTIPLIER, bounds, top
from tidewright.operators.scalar import baseline_dist, median_interval
from tidewright.plans.frames import ID, previous, quantiles, running

TOLERANCE = 3
CONDITIONS = ("above", "below", "between", "outside")


def condition(kind: str, threshold: float | None = None, lower: float | None = None, upper: float | None = None) -> tuple[Column, Column, Column]:
    """Direction of a matching reading (null: none), its deviation, and what a peak is ordered by."""
    v = F.col("value")
    if kind not in CONDITIONS:
        raise ValueError(f"unknown condition {kind!r}: one of {', '.join(CONDITIONS)}")
    if kind in ("above", "below"):
        if threshold is None:
            raise ValueError(f"{kind} needs a threshold")
        hit, away = (v > threshold, v - threshold) if kind == "above" else (v < threshold, threshold - v)
        return F.when(hit, F.lit(kind)), away, away
    if lower is None or upper is None:
        raise ValueError(f"{kind} needs a lower and an upper bound")
    if lower > upper:
        raise ValueError("the lower bound is above the upper one")
    if kind == "between":
        return F.when(v.between(lower, upper), F.lit("within")), F.lit(0.0), v
    away = F.greatest(lower - v, v - upper)
    return F.when(v < lower, F.lit("below")).when(v > upper, F.lit("above")), away, away


def _islands(rows: DataFrame, starts: Column) -> DataFrame:
    """One row per stretch; ``rows`` has direction, deviation and rank (what its peak is ordered by; the first on ties)."""
    marked = running(rows.withColumn("starts", starts).drop("prev"), F.col("starts"), "island").where("direction IS NOT NULL")
    best = F.max(F.struct(F.col("rank"), (-F.col("ts_ms")).alias("t"), (-F.col("seq")).alias("s"), F.col("value"), F.col("deviation")))
    made = marked.groupBy(ID, "island", "direction").agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.count(F.lit(1)).alias("points"), best.alias("p"))
    return made.select(ID, "direction", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "points",
        F.col("p.value").alias("peak_value"), (-F.col("p.t")).alias("peak_ts_ms"), F.col("p.deviation").alias("peak_deviation"))


def _breaks(tolerance: Column) -> Column:
    """Whether a matching reading opens a stretch, given the reading before it."""
    p = F.col("prev")
    late = (tolerance > 0) & ((F.col("ts_ms") - p["ts_ms"]) > tolerance)
    return p.isNull() | p["direction"].isNull() | (p["direction"] != F.col("direction")) | late


def events(series: DataFrame, kind: str, limit: int | None = None, **bound: float) -> DataFrame:
    """Stretches of readings that match; they end at a reading that doesn't, at a change of direction and at gaps over three median intervals."""
    direction, away, rank = condition(kind, **bound)
    near = median_interval(series).withColumnRenamed(ID, "m_id")
    rows = series.withColumns({"direction": direction, "deviation": away, "rank": rank})
    rows = previous(rows, ["ts_ms", "direction"]).join(near, F.col(ID) == F.col("m_id"))
    starts = F.col("direction").isNotNull() & _breaks(F.col("interval_ms") * TOLERANCE)
    found = _islands(rows.drop("m_id"), starts)
    return top(found, limit, F.desc("duration_ms"), F.desc("points"), F.col("start_ms")) if limit else found


def event_totals(series: DataFrame, kind: str, **bound: float) -> DataFrame:
    """Points and time in events, as counts and shares."""
    found = events(series, kind, **bound).groupBy(F.col(ID).alias("e_id")).agg(F.count(F.lit(1)).alias("events"), F.sum("points").alias("points"), F.sum("duration_ms").alias("ms"))
    whole = series.groupBy(ID).agg(F.count(F.lit(1)).alias("row_count"), (F.max("ts_ms") - F.min("ts_ms")).alias("span_ms"))
    joined = whole.join(found, F.col(ID) == F.col("e_id"), "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    share = F.coalesce(n("ms") * 100 / F.nullif("span_ms", F.lit(0)), F.lit(0.0))
    return joined.select(ID, n("events").alias("total_events"), n("points").alias("points_matching"),
        (n("points") * 100 / F.col("row_count")).alias("points_percent"), n("ms").alias("time_in_events_ms"), share.alias("time_percent"))


def before(series: DataFrame, subject: DataFrame) -> DataFrame:
    """The default baseline: what precedes the subject's first reading."""
    first = subject.groupBy(F.col(ID).alias("s_id")).agg(F.min("ts_ms").alias("first_ms"))
    return series.join(first, F.col(ID) == F.col("s_id")).where("ts_ms < first_ms").select(*series.columns)


def _against(subject: DataFrame, baseline: DataFrame, multiplier: float) -> DataFrame:
    fence = bounds(baseline, multiplier).select(F.col(ID).alias("b_id"), "lower", "upper")
    v = F.col("value")
    direction = F.when(v < F.col("lower"), "below").when(v > F.col("upper"), "above")
    away = F.greatest(F.col("lower") - v, v - F.col("upper"))
    return subject.join(fence, F.col(ID) == F.col("b_id")).withColumns({"direction": direction, "deviation": away, "rank": away})


def episodes(subject: DataFrame, baseline: DataFrame, multiplier: float = IQR_MULTIPLIER, limit: int | None = None) -> DataFrame:
    """Stretches of readings outside the baseline's fence; readings inside it are bridged as long as the gap allows."""
    near = median_interval(subject).withColumnRenamed(ID, "m_id")
    odd = _against(subject, baseline, multiplier).where("direction IS NOT NULL").select(ID, "ts_ms", "seq", "value", "direction", "deviation", "rank")
    rows = previous(odd, ["ts_ms", "direction"]).join(near, F.col(ID) == F.col("m_id")).drop("m_id")
    found = _islands(rows, _breaks(F.col("interval_ms") * TOLERANCE))
    return top(found, limit, F.desc("peak_deviation"), F.col("start_ms")) if limit else found


def compare_to_baseline(subject: DataFrame, baseline: DataFrame, multiplier: float = IQR_MULTIPLIER) -> DataFrame:
    """The baseline's distribution and fence, the subject's summary, and how much of it lies outside."""
    base = baseline_dist(baseline).select(F.col(ID).alias("d_id"), *[F.col(c).alias(f"baseline_{c}") for c in ("row_count", "median", "q1", "q3", "p05", "p95", "mean", "stddev")])
    fence = bounds(baseline, multiplier).select(F.col(ID).alias("f_id"), "lower", "upper")
    own = quantiles(_against(subject, baseline, multiplier), "value", [0.5], [F.count(F.lit(1)).alias("row_count"), F.min("value").alias("min_value"),
        F.max("value").alias("max_value"), F.avg("value").alias("mean"), F.count("direction").alias("points_outside")])
    own = own.withColumn("median", F.col("q")[0]).drop("q").withColumn("percent_outside", F.col("points_outside") * 100 / F.col("row_count"))
    return own.join(base, F.col(ID) == F.col("d_id")).join(fence, F.col(ID) == F.col("f_id")).drop("d_id", "f_id")
