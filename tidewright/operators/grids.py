"""Readings on a grid of time: profiles, resampling, seasons, correlation and lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.scalar import seconds
from tidewright.plans.frames import ID, average_ranks, quantiles

# The widths that an automatic grid chooses from, in milliseconds.
WIDTHS_MS = (1_000, 5_000, 15_000, 30_000, 60_000, 300_000, 900_000, 1_800_000, 3_600_000, 10_800_000, 21_600_000, 43_200_000, 86_400_000, 604_800_000)
PROFILE_BUCKETS, CORRELATE_BUCKETS, LAG_BUCKETS, LAG_SHIFTS = 48, 100, 200, 500
AGGREGATES = {"mean": F.avg, "min": F.min, "max": F.max, "median": None}
HOUR, DAY = 3_600_000, 86_400_000
# Names of the positions in a week.
DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def pick_width(span_ms: int, most: int) -> int:
    """The narrowest width with at most so many buckets over the span; the widest if none has."""
    return next((w for w in WIDTHS_MS if span_ms // w + 1 <= most), WIDTHS_MS[-1])


def width_column(span: Column, most: int) -> Column:
    return F.coalesce(*[F.when(F.floor(span / F.lit(w)) + 1 <= most, F.lit(w)) for w in WIDTHS_MS], F.lit(WIDTHS_MS[-1])).cast("long")


def auto_width(series: DataFrame, most: int = PROFILE_BUCKETS) -> DataFrame:
    spans = series.groupBy(ID).agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"))
    return spans.withColumn("width_ms", width_column(F.col("end_ms") - F.col("start_ms"), most))


def _placed(series: DataFrame, width_ms: int | None, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their bucket from the series' first reading, and the grids."""
    if width_ms is not None and width_ms <= 0:
        raise ValueError("the bucket must be at least a millisecond")
    grid = auto_width(series, most)
    if width_ms is not None:
        grid = grid.withColumn("width_ms", F.lit(width_ms).cast("long"))
    grid = grid.withColumnRenamed(ID, "g_id")
    bucket = F.floor((F.col("ts_ms") - F.col("start_ms")) / F.col("width_ms")).cast("long")
    return series.join(grid, F.col(ID) == F.col("g_id")).withColumn("bucket", bucket), grid


def profile(series: DataFrame, width_ms: int | None = None) -> DataFrame:
    """Count, mean and extremes of every bucket, empty ones too."""
    rows, grid = _placed(series, width_ms, PROFILE_BUCKETS)
    if width_ms is not None and grid.where(F.floor((F.col("end_ms") - F.col("start_ms")) / F.col("width_ms")) + 1 > PROFILE_BUCKETS).limit(1).count():
        raise ValueError(f"more than {PROFILE_BUCKETS} buckets; take a wider one")
    made = rows.groupBy(F.col(ID).alias("r_id"), F.col("bucket").alias("r_bucket")).agg(F.count(F.lit(1)).alias("c"), F.avg("value").alias("mean"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"))
    last = F.floor((F.col("end_ms") - F.col("start_ms")) / F.col("width_ms"))
    dense = grid.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    joined = dense.join(made, (F.col("g_id") == F.col("r_id")) & (F.col("bucket") == F.col("r_bucket")), "left")
    return joined.select(F.col("g_id").alias(ID), "bucket", (F.col("start_ms") + F.col("bucket") * F.col("width_ms")).alias("start_ms"),
        F.coalesce("c", F.lit(0).cast("long")).alias("count"), "mean", "min_value", "max_value")


def resample(series: DataFrame, width_ms: int, how: str = "mean") -> DataFrame:
    """One reading per bucket that has any, at the bucket's start."""
    if how not in AGGREGATES:
        raise ValueError(f"unknown aggregate {how!r}: one of {', '.join(AGGREGATES)}")
    rows, _ = _placed(series, width_ms, PROFILE_BUCKETS)
    at = (F.col("start_ms") + F.col("bucket") * F.col("width_ms")).alias("at_ms")
    if how == "median":
        # a bucket may hold more values than a task: exact quantiles of any size, a bucket in the place of a series
        named = rows.select(F.struct(F.col(ID).alias("id"), "bucket", at).alias(ID), "value")
        made = quantiles(named, "value", [0.5]).select(F.col(f"{ID}.id").alias(ID), f"{ID}.bucket", f"{ID}.at_ms", F.col("q")[0].alias("value"))
    else:
        made = rows.groupBy(ID, "bucket", at).agg(AGGREGATES[how]("value").alias("value"))
    return made.select(ID, F.col("at_ms").alias("ts_ms"), "value", F.col("bucket").alias("seq"))


def position(period: str) -> tuple[Column, int, int]:
    """The place of a time within the period, how many places there are, and the period in ms."""
    if period == "hour_of_day":
        return F.pmod(F.floor(F.col("ts_ms") / HOUR), F.lit(24)).cast("int"), 24, DAY
    if period == "day_of_week":
        return F.pmod(F.floor(F.col("ts_ms") / DAY) + 4, F.lit(7)).cast("int"), 7, 7 * DAY
    raise ValueError(f"unknown period {period!r}: hour_of_day or day_of_week")


def label(period: str, at: Column) -> Column:
    if period == "hour_of_day":
        return F.concat(F.lpad(at.cast("string"), 2, "0"), F.lit(":00"))
    return F.array(*map(F.lit, DAY_NAMES))[at]


def seasonal(series: DataFrame, period: str) -> DataFrame:
    """Mean, extremes and count of each position, empty ones too."""
    at, places, _ = position(period)
    made = series.groupBy(F.col(ID).alias("r_id"), at.alias("r_at")).agg(F.count(F.lit(1)).alias("c"), F.avg("value").alias("mean"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"))
    dense = series.select(ID).distinct().withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(places - 1))))
    joined = dense.join(made, (F.col(ID) == F.col("r_id")) & (F.col("position") == F.col("r_at")), "left")
    return joined.select(ID, "position", label(period, F.col("position")).alias("label"), F.coalesce("c", F.lit(0).cast("long")).alias("count"), "mean", "min_value", "max_value")


def cycle_strength(series: DataFrame, period: str) -> DataFrame:
    """The share of the variance that lies between positions (null for a constant series), and the periods spanned."""
    at, _, length = position(period)
    by_place = series.groupBy(ID, at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"), F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"))
    total = by_place.groupBy(ID).agg(F.sum("n").alias("row_count"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"),
        F.sum(F.col("n") * F.col("v")).alias("inside"), ((F.max("hi") - F.min("lo")) / length).alias("span_periods")).withColumnRenamed(ID, "t_id")
    between = by_place.join(total, F.col(ID) == F.col("t_id")).groupBy(ID, "row_count", "inside", "span_periods").agg(F.sum(F.col("n") * (F.col("m") - F.col("grand")) ** 2).alias("between"))
    whole = F.col("inside") + F.col("between")
    return between.select(ID, "row_count", (F.col("between") / F.nullif(whole, F.lit(0.0))).alias("cycle_strength"), "span_periods")


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson's r as an aggregate; null if a side is constant."""
    spread = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))
    r = F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))
    return F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r)


def overlap(a: DataFrame, b: DataFrame, most: int, width_ms: int | None = None, start_ms: int | None = None, end_ms: int | None = None) -> tuple[int, int, int]:
    """Shared window and bucket width of two series (a driver value: two one-row aggregates).

    An explicit start or end takes the place of the shared one.
    """
    ends = lambda s: s.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    (a_lo, a_hi), (b_lo, b_hi) = ends(a), ends(b)
    if a_lo is None or b_lo is None:
        raise ValueError("a series is empty")
    lo, hi = start_ms if start_ms is not None else max(a_lo, b_lo), end_ms if end_ms is not None else min(a_hi, b_hi)
    if lo > hi:
        raise ValueError("the two series don't overlap")
    if width_ms is None:
        inside = [x for s in (a, b) for x in ends(s.where(F.col("ts_ms").between(lo, hi))) if x is not None]
        width_ms = pick_width(max(inside) - min(inside) if inside else 0, most)
    if width_ms <= 0:
        raise ValueError("the bucket must be at least a millisecond")
    return lo, hi, width_ms


def bucket_means(series: DataFrame, lo: int, hi: int, width_ms: int) -> DataFrame:
    rows = series.where(F.col("ts_ms").between(lo, hi))
    return rows.groupBy(F.floor((F.col("ts_ms") - lo) / F.lit(width_ms)).cast("long").alias("bucket")).agg(F.avg("value").alias("mean"))


def aligned(a: DataFrame, b: DataFrame, lo: int, hi: int, width_ms: int) -> DataFrame:
    return bucket_means(a, lo, hi, width_ms).withColumnRenamed("mean", "x").join(bucket_means(b, lo, hi, width_ms).withColumnRenamed("mean", "y"), "bucket")


def correlate(a: DataFrame, b: DataFrame, width_ms: int | None = None, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Pearson and Spearman of the bucket means of two series; at least two shared buckets."""
    pairs = aligned(a, b, *overlap(a, b, CORRELATE_BUCKETS, width_ms, start_ms, end_ms))
    ranks = average_ranks(average_ranks(pairs, "x", "rx"), "y", "ry")
    return ranks.agg(F.count(F.lit(1)).alias("aligned"), safe_corr("x", "y").alias("pearson"), safe_corr("rx", "ry").alias("spearman"))


def lag_scan(a: DataFrame, b: DataFrame, shifts: int | None = None, width_ms: int | None = None, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Pearson of a against b shifted by every whole number of buckets up to ``shifts`` each way; null below three pairs.

    Default: a quarter of the window's buckets.  The grid is cut into stretches of the largest shift: a bucket meets those of its own
    stretch and the two beside it, so that three copies of a row are shuffled and not one for each shift.
    """
    lo, hi, width = overlap(a, b, LAG_BUCKETS, width_ms, start_ms, end_ms)
    most = min(LAG_SHIFTS, max(1, shifts if shifts is not None else ((hi - lo) // width + 1) // 4))
    stretch = F.floor(F.col("bucket") / most)
    left = bucket_means(a, lo, hi, width).select("bucket", F.col("mean").alias("x"), stretch.alias("stretch"))
    right = bucket_means(b, lo, hi, width).select(F.col("bucket").alias("b_bucket"), F.col("mean").alias("y"), F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch"))
    met = left.join(right, "stretch").withColumn("shift", F.col("b_bucket") - F.col("bucket")).where(F.col("shift").between(-most, most))
    found = met.groupBy("shift").agg(F.count(F.lit(1)).alias("aligned"), safe_corr("x", "y").alias("r"))
    return found.select("shift", seconds(F.col("shift") * width).alias("lag_s"), "aligned", F.when(F.col("aligned") >= 3, F.col("r")).alias("pearson"))


def best_lag(scan: DataFrame) -> DataFrame:
    """The shift with the strongest correlation (to nine digits; the smallest on ties), beside the one at zero."""
    strength = F.round(F.abs("pearson"), 9)
    best = F.max_by(F.struct("shift", "lag_s", "pearson", "aligned"), F.when(F.col("pearson").isNotNull(), F.struct(strength, -F.col("shift"))))
    zero = lambda c: F.max(F.when(F.col("shift") == 0, F.col(c)))
    found = scan.agg(best.alias("b"), zero("pearson").alias("pearson_at_zero"), zero("aligned").alias("aligned_at_zero"))
    return found.select(F.col("b.shift").alias("best_shift"), F.col("b.lag_s").alias("best_lag_s"), F.col("b.pearson").alias("pearson_at_best"),
        F.col("b.aligned").alias("aligned_at_best"), "pearson_at_zero", F.coalesce("aligned_at_zero", F.lit(0)).alias("aligned_at_zero"))

