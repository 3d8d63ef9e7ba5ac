"""One row per series: summaries, distributions, rates, integrals, trends, comparisons, single readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.plans.frames import ID, STRETCH, previous, quantiles, small, stretched

# The percentile ladder of a distribution.
LADDER = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
LADDER_NAMES = ("p05", "p10", "p25", "p50", "p75", "p90", "p95", "p99")
GAP_FACTOR = 5


def seconds(ms: Column) -> Column:
    return ms / F.lit(1000.0)


def _extreme(kind: str) -> list[Column]:
    """The extreme value and where it is first reached."""
    if kind == "min":
        best = F.min(F.struct("value", "ts_ms"))
        return [best["value"].alias("min_value"), best["ts_ms"].alias("min_ts_ms")]
    best = F.max(F.struct(F.col("value"), (-F.col("ts_ms")).alias("back")))
    return [best["value"].alias("max_value"), (-best["back"]).alias("max_ts_ms")]


def summary_stats(series: DataFrame) -> DataFrame:
    aggregates = [F.count(F.lit(1)).alias("row_count"), F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), *_extreme("min"), *_extreme("max"),
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("stddev")]
    return quantiles(series, "value", [0.5], aggregates).withColumn("median", F.col("q")[0]).drop("q")


def overview(series: DataFrame) -> DataFrame:
    """What is known of each series at a glance; of equal last time stamps the latest stored row counts."""
    last = F.max_by("value", F.struct("ts_ms", "seq"))
    return series.groupBy(ID).agg(
        F.count(F.lit(1)).alias("row_count"), F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), last.alias("last_value"), F.max("ts_ms").alias("last_ts_ms"),
        F.avg("value").alias("mean"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.stddev_pop("value").alias("stddev"),
    )


def percentiles(series: DataFrame) -> DataFrame:
    aggregates = [F.count(F.lit(1)).alias("row_count"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("stddev")]
    found = quantiles(series, "value", LADDER, aggregates)
    return found.select(ID, "row_count", "min_value", "max_value", "mean", "stddev", *[F.col("q")[i].alias(n) for i, n in enumerate(LADDER_NAMES)])


def bins_of(count: Column) -> Column:
    """The automatic number of bins."""
    return F.least(F.greatest(F.round(F.sqrt(count)), F.lit(3.0)), F.lit(12.0)).cast("int")


def histogram(series: DataFrame, bins: int | None = None) -> DataFrame:
    """Equal-width bins, empty ones too; a constant series has one bin of width 0."""
    if bins is not None and bins > 40:
        raise ValueError("at most 40 bins")
    ends = series.groupBy(ID).agg(F.count(F.lit(1)).alias("row_count"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    number = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.lit(bins) if bins else bins_of(F.col("row_count")))
    ends = ends.withColumn("bins", number).withColumn("bin_width", (F.col("hi") - F.col("lo")) / F.col("bins"))
    place = F.when(F.col("bin_width") == 0, 0).otherwise(F.least(F.floor((F.col("value") - F.col("lo")) / F.nullif("bin_width", F.lit(0.0))), F.col("bins") - 1)).cast("int")
    counts = series.join(ends, ID).select(F.col(ID).alias("c_id"), place.alias("c_bin")).groupBy("c_id", "c_bin").agg(F.count(F.lit(1)).alias("c"))
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    joined = grid.join(counts, (F.col(ID) == F.col("c_id")) & (F.col("bin") == F.col("c_bin")), "left")
    n = F.coalesce("c", F.lit(0).cast("long"))
    lower = F.col("lo") + F.col("bin") * F.col("bin_width")
    upper = F.when(F.col("bin") == F.col("bins") - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * F.col("bin_width"))
    return joined.select(ID, "bin", lower.alias("lower"), upper.alias("upper"), n.alias("count"), (n * 100 / F.col("row_count")).alias("percent"), "bin_width")


def baseline_dist(series: DataFrame) -> DataFrame:
    aggregates = [F.count(F.lit(1)).alias("row_count"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("stddev")]
    found = quantiles(series, "value", [0.5, 0.25, 0.75, 0.05, 0.95], aggregates)
    return found.select(ID, "row_count", "mean", "stddev", *[F.col("q")[i].alias(n) for i, n in enumerate(("median", "q1", "q3", "p05", "p95"))])


def median_interval(series: DataFrame) -> DataFrame:
    """``dataset_id, interval_ms``: the median gap between neighbours, equal time stamps included, in whole ms; 0 for one row."""
    gaps = previous(series, ["ts_ms"]).select(ID, (F.col("ts_ms") - F.col("prev")["ts_ms"]).alias("gap"))
    found = quantiles(gaps, "gap", [0.5])
    return found.select(ID, F.coalesce(F.floor(F.col("q")[0]), F.lit(0)).cast("long").alias("interval_ms"))


def rate_of_change(series: DataFrame) -> DataFrame:
    """Extreme rates between neighbours (first one on ties); neighbours at one time don't count.  Series without a rate have no row."""
    step = previous(series).where("prev IS NOT NULL").select(ID, "ts_ms", "seq", (F.col("ts_ms") - F.col("prev")["ts_ms"]).alias("dt"),
        (F.col("value") - F.col("prev")["value"]).alias("dv")).where("dt > 0")
    step = step.withColumn("rate", F.col("dv") / seconds(F.col("dt")))
    rise = F.max(F.struct(F.col("rate"), (-F.col("ts_ms")).alias("t"), (-F.col("seq")).alias("s")))
    fall = F.min(F.struct("rate", "ts_ms", "seq"))
    found = quantiles(step, "dt", [0.5], [rise.alias("rise"), fall.alias("fall"), F.avg(F.abs("rate")).alias("mean_abs_rate")])
    return found.select(
        ID, F.col("rise")["rate"].alias("max_rise"), (-F.col("rise")["t"]).alias("max_rise_ts_ms"), F.col("fall")["rate"].alias("max_fall"), F.col("fall")["ts_ms"].alias("max_fall_ts_ms"),
        "mean_abs_rate", seconds(F.col("q")[0]).alias("median_interval_s"),
    )


def integrate(series: DataFrame) -> DataFrame:
    """Trapezoids; a gap is longer than five median intervals.  Series of one instant have no row."""
    step = previous(series).where("prev IS NOT NULL").withColumn("dt", F.col("ts_ms") - F.col("prev")["ts_ms"]).withColumn("area", (F.col("value") + F.col("prev")["value"]) / 2 * seconds(F.col("dt")))
    middle = quantiles(step, "dt", [0.5]).select(ID, F.floor(F.col("q")[0]).alias("middle"))
    gap = (F.col("middle") > 0) & (F.col("dt") > GAP_FACTOR * F.col("middle"))
    total = step.join(middle, ID).groupBy(ID).agg(
        F.sum("area").alias("integral"), seconds(F.sum("dt")).alias("duration_s"), F.sum(F.when(gap, 1).otherwise(0)).cast("long").alias("large_gaps"),
            seconds(F.sum(F.when(gap, F.col("dt")).otherwise(0))).alias("gap_s")
    )
    total = total.where("duration_s > 0")
    return total.select(ID, "integral", (F.col("integral") / 3600).alias("integral_hours"), (F.col("integral") / F.col("duration_s")).alias("time_weighted_mean"), "duration_s", "large_gaps", "gap_s")


def fit_trend(series: DataFrame) -> DataFrame:
    """Least squares over hours since the first reading; no row for a single instant.

    The direction is that of the 95 % interval of the slope; two readings are flat.
    """
    first = series.groupBy(ID).agg(F.min("ts_ms").alias("t0")).withColumnRenamed(ID, "f_id")
    x = (F.col("ts_ms") - F.col("t0")) / F.lit(3_600_000.0)
    sums = series.join(first, F.col(ID) == F.col("f_id")).withColumn("x", x).groupBy(ID).agg(
        F.count(F.lit(1)).alias("n"), F.regr_sxx("value", "x").alias("sxx"), F.regr_sxy("value", "x").alias("sxy"), F.regr_syy("value", "x").alias("syy"), F.max("x").alias("hours")
    ).where("sxx > 0")
    slope = F.col("sxy") / F.col("sxx")
    left = F.greatest(F.lit(0.0), F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"))
    margin = F.when(F.col("n") >= 3, 1.96 * F.sqrt(left / (F.greatest(F.col("n"), F.lit(3)) - 2) / F.col("sxx")))
    direction = F.when(slope - margin > 0, "increasing").when(slope + margin < 0, "decreasing").otherwise("flat")
    r2 = F.when(F.col("syy") > 0, F.col("sxy") * F.col("sxy") / (F.col("sxx") * F.nullif("syy", F.lit(0.0)))).otherwise(0.0)
    return sums.select(ID, "n", slope.alias("slope_per_hour"), (slope * 24).alias("slope_per_day"), r2.alias("r2"), (F.col("hours") * 3600).alias("duration_s"), direction.alias("direction"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each pair of a series of a and one of b, which should be few: summaries are compared, not rows."""
    names = ["row_count", "mean", "stddev", "min_value", "max_value", "median"]
    left = summary_stats(a).select(F.col(ID).alias("a_id"), *[F.col(n).alias(f"a_{n}") for n in names])
    right = summary_stats(b).select(F.col(ID).alias("b_id"), *[F.col(n).alias(f"b_{n}") for n in names])
    difference = F.col("b_mean") - F.col("a_mean")
    return left.crossJoin(right).select(
        "*", difference.alias("mean_difference"), (difference * 100 / F.nullif("a_mean", F.lit(0.0))).alias("mean_pct_change"),
            (F.col("b_stddev") / F.nullif("a_stddev", F.lit(0.0))).alias("stddev_ratio")
    )


def value_at(series: DataFrame, instants: DataFrame) -> DataFrame:
    """The readings around each instant of ``instants (dataset_id, at_ms)``: nearest (earlier on ties) and interpolated.

    Probes and readings are merged in time order, so any number of probes costs one pass.  On equal
    time stamps the last stored reading stands before, the first at the instant itself.
    """
    rows = series.select(ID, "ts_ms", "seq", F.lit(0).alias("probe"), F.struct("ts_ms", "value").alias("r"))
    # the reading before: strictly earlier; the one after: at the instant or later
    asked = instants.select(ID, F.col("at_ms").alias("ts_ms"), F.lit(-(1 << 63)).cast("long").alias("seq"), F.lit(1).alias("probe"), F.lit(None).cast("struct<ts_ms:bigint,value:double>").alias("r"))
    merged = rows.unionByName(asked)
    if small(series):
        parts = [ID]
    else:
        merged, parts = stretched(merged), [ID, STRETCH]
    # both look back, one of them in reverse order: a frame that looks ahead costs its length at every row
    order = Window.partitionBy(*parts).orderBy("ts_ms", F.desc("probe"), "seq")
    back = Window.partitionBy(*parts).orderBy(F.desc("ts_ms"), "probe", F.desc("seq"))
    before = F.last("r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("r", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    met = merged.withColumns({"before": before, "after": after}).where("probe = 1").withColumnRenamed("ts_ms", "at_ms")
    if STRETCH in merged.columns:
        # what lies in other stretches: their last and first readings
        held = F.when(F.col("probe") == 0, F.struct("ts_ms", "seq"))
        ends = merged.groupBy(ID, STRETCH).agg(F.max_by("r", held).alias("l"), F.min_by("r", held).alias("f"))
        across = Window.partitionBy(ID).orderBy(STRETCH)
        ends = ends.withColumns({"earlier": F.last("l", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)),
            "later": F.last("f", ignorenulls=True).over(Window.partitionBy(ID).orderBy(F.desc(STRETCH)).rowsBetween(Window.unboundedPreceding, -1))})
        met = met.join(ends.select(ID, STRETCH, "earlier", "later"), [ID, STRETCH]).withColumns({"before": F.coalesce("before", "earlier"), "after": F.coalesce("after", "later")})
    b, a, at = F.col("before"), F.col("after"), F.col("at_ms")
    first = a.isNull() | (b.isNotNull() & ((at - b["ts_ms"]) <= (a["ts_ms"] - at)))
    nearest = F.when(first, b).otherwise(a)
    share = (at - b["ts_ms"]) / F.nullif(a["ts_ms"] - b["ts_ms"], F.lit(0))
    between = F.when(a["ts_ms"] == at, a["value"]).when(b.isNotNull() & a.isNotNull(), b["value"] + (a["value"] - b["value"]) * share)
    return met.withColumn("n", nearest).where("n IS NOT NULL").select(ID, "at_ms", F.col("n.ts_ms").alias("nearest_ts_ms"),
        F.col("n.value").alias("nearest_value"), seconds(F.col("n.ts_ms") - at).alias("offset_s"), between.alias("interpolated"))
