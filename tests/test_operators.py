"""Operators on hand-made series."""

import math

import pytest

from tidewright.operators import grids, islands, rows, scalar
from tidewright.plans import frames

MINUTE = 60_000


@pytest.fixture(params=["plain", "large"])
def form(request, monkeypatch):
    if request.param == "large":
        monkeypatch.setattr(frames, "SMALL", 0)
        monkeypatch.setattr(frames, "STRETCH_MS", 2 * MINUTE)


def series(spark, values, step=MINUTE, times=None, name="s"):
    data = [(name, times[i] if times else i * step, float(v), i) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "dataset_id string, ts_ms long, value double, seq long")


def test_summary(spark, form):
    r = scalar.summary_stats(series(spark, [1, 2, 3, 4, 100])).first()
    assert (r["mean"], r.median, r.max_ts_ms) == (22, 3, 4 * MINUTE)
    assert r.stddev == pytest.approx(math.sqrt(1522))
    r = scalar.summary_stats(series(spark, [7, 7], times=[2000, 1000])).first()
    assert (r.min_ts_ms, r.max_ts_ms) == (1000, 1000)


def test_outliers(spark, form):
    b = rows.bounds(series(spark, [1, 2, 3, 4, 100])).first()
    assert (b.q1, b.median, b.q3, b.lower, b.upper) == (2, 3, 4, -1, 7)
    s = series(spark, [1, 2, 3, 4, 100, -50])
    assert [(r.value, r.deviation) for r in rows.outliers(s, limit=5).orderBy("place").collect()] == [(100, 92.5), (-50, 47.5)]
    assert rows.inliers(s).count() == 4
    with pytest.raises(ValueError):
        rows.bounds(s, -1)


def test_rates(spark, form):
    r = scalar.rate_of_change(series(spark, [0, 10, 5], times=[0, 1000, 3000])).first()
    assert (r.max_rise, r.max_rise_ts_ms, r.max_fall, r.mean_abs_rate, r.median_interval_s) == (10, 1000, -2.5, 6.25, 1.5)
    assert scalar.rate_of_change(series(spark, [0, 100, 101], times=[0, 0, 1000])).first().max_rise == 1
    assert scalar.rate_of_change(series(spark, [1])).count() == 0


def test_trend(spark):
    r = scalar.fit_trend(series(spark, range(11))).first()
    assert (r.direction, round(r.slope_per_hour, 9), round(r.slope_per_day, 6), round(r.r2, 9)) == ("increasing", 60, 1440, 1)
    assert scalar.fit_trend(series(spark, [10, 11, 9, 11, 9, 10])).first().direction == "flat"
    assert scalar.fit_trend(series(spark, [1, 9])).first().direction == "flat"
    assert scalar.fit_trend(series(spark, [5, 5, 5])).first().r2 == 0
    assert scalar.fit_trend(series(spark, [1, 2], times=[5, 5])).count() == 0


def test_profile_and_widths(spark):
    s = series(spark, [1, 3, 10, 20], times=[0, 50, 100, 150])
    assert [(r["count"], r["mean"], r.min_value, r.max_value) for r in grids.profile(s, 100).orderBy("bucket").collect()] == [(2, 2, 1, 3), (2, 15, 10, 20)]
    assert [r["count"] for r in grids.profile(series(spark, [1, 2], times=[0, 250]), 100).orderBy("bucket").collect()] == [1, 0, 1]
    assert grids.pick_width(23 * 3_600_000, 48) == 30 * MINUTE
    with pytest.raises(ValueError):
        grids.profile(series(spark, [1, 2, 3, 4, 100]), 1)


def test_median_interval(spark, form):
    assert scalar.median_interval(series(spark, [0] * 4, times=[0, 100, 200, 500])).first().interval_ms == 100
    assert scalar.median_interval(series(spark, [0])).first().interval_ms == 0


def test_distribution(spark, form):
    s = series(spark, range(100))
    p = scalar.percentiles(s).first()
    assert (p.p25, p.p50, p.p75) == (24.75, 49.5, 74.25)
    assert [r["count"] for r in scalar.histogram(s, 10).collect()] == [10] * 10
    assert scalar.histogram(s).count() == 10 and scalar.histogram(series(spark, [1, 2])).count() == 3
    assert [(r["count"], r.bin_width) for r in scalar.histogram(series(spark, [7, 7, 7])).collect()] == [(3, 0)]
    with pytest.raises(ValueError):
        scalar.histogram(s, 41)


def test_events(spark, form):
    s = series(spark, [5, 6, 12, 15, 11, 6, 5, 6, 20, 5])
    e = islands.events(s, "above", 10, threshold=10).orderBy("place").collect()
    assert [(r.start_ms, r.end_ms, r.points, r.peak_value, r.peak_deviation) for r in e] == [(120_000, 240_000, 3, 15, 5), (480_000, 480_000, 1, 20, 10)]
    t = islands.event_totals(s, "above", threshold=10).first()
    assert (t.points_matching, t.time_in_events_ms, t.total_events) == (4, 120_000, 2)
    assert islands.events(series(spark, [20] * 4, times=[0, MINUTE, 60 * MINUTE, 61 * MINUTE]), "above", threshold=10).count() == 2
    assert sorted(r.direction for r in islands.events(series(spark, [-5, 50, 5]), "outside", lower=0, upper=10).collect()) == ["above", "below"]
    assert [(r.points, r.peak_value) for r in islands.events(series(spark, [1, 5, 7, 20]), "between", lower=4, upper=10).collect()] == [(2, 7)]
    for bad in (("above", {}), ("between", {"lower": 3, "upper": 1}), ("near", {"threshold": 1})):
        with pytest.raises(ValueError):
            islands.condition(bad[0], **bad[1])


@pytest.mark.parametrize(("subject", "want"), [([30, 30, 108, 109, 112, 30], [(3, 112)]), ([108, 30, 110], [(2, 110)]), ([108, 30, 30, 30, 30, 110], [(1, 108), (1, 110)])])
def test_baseline(spark, form, subject, want):
    base = series(spark, [29, 31] * 20)
    found = islands.episodes(series(spark, subject), base).orderBy("start_ms").collect()
    assert [(r.points, r.peak_value) for r in found] == want
    assert islands.compare_to_baseline(series(spark, subject), base).first().points_outside == sum(p for p, _ in want)


def test_quality(spark, form):
    s = series(spark, [1, 2, 3, 4, 5], times=[0, MINUTE, 2 * MINUTE, 32 * MINUTE, 33 * MINUTE])
    assert [r.duration_ms for r in rows.gaps(s).collect()] == [30 * MINUTE]
    assert [r["count"] for r in rows.flatlines(series(spark, [0, *[5] * 10, 1])).collect()] == [10]
    assert rows.intervals(series(spark, [1, 1, 1], times=[0, 0, MINUTE])).first().duplicate_timestamps == 1


def test_correlation(spark):
    a = [math.sin(i) * 3 for i in range(10)]
    run = lambda b: grids.correlate(series(spark, a), series(spark, b), MINUTE).first()
    assert round(run([2 * x + 5 for x in a]).pearson, 9) == 1
    assert round(run([-x for x in a]).pearson, 9) == -1
    cubed = run([x**3 for x in a])
    assert round(cubed.spearman, 9) == 1 and cubed.pearson < 1
    assert run([4] * 10).pearson is None


def test_lag(spark):
    a, b = series(spark, [math.sin(i / 5) for i in range(100)]), series(spark, [math.sin((i - 4) / 5) for i in range(100)])
    scan = grids.lag_scan(a, b, 10, MINUTE)
    best = grids.best_lag(scan).first()
    assert scan.count() == 21 and best.best_shift == 4 and best.pearson_at_best > 0.999
    assert grids.best_lag(grids.lag_scan(series(spark, [5] * 100), b, 10, MINUTE)).first().best_shift is None


def test_seasons(spark):
    start, hour = 1_782_864_000_000, 3_600_000  # 2026-07-01, UTC
    s = series(spark, [i % 24 for i in range(72)], times=[start + i * hour for i in range(72)])
    p = grids.seasonal(s, "hour_of_day").orderBy("position").collect()
    assert [r["count"] for r in p] == [3] * 24 and p[5].label == "05:00"
    c = grids.cycle_strength(s, "hour_of_day").first()
    assert round(c.cycle_strength, 9) == 1 and 2.9 <= c.span_periods <= 3
    day = grids.seasonal(series(spark, [1], times=[start + 12 * hour]), "day_of_week").where("count > 0").first()
    assert (day.position, day.label) == (3, "Wednesday")
    assert grids.cycle_strength(series(spark, [5, 5]), "hour_of_day").first().cycle_strength is None


def test_integral(spark, form):
    r = scalar.integrate(series(spark, [2] * 61)).first()
    assert (r.integral, r.time_weighted_mean) == (7200, 2)
    r = scalar.integrate(series(spark, [0, 10], times=[0, 10_000])).first()
    assert (r.integral, r.time_weighted_mean) == (50, 5)
    r = scalar.integrate(series(spark, [1] * 5, times=[0, MINUTE, 2 * MINUTE, 32 * MINUTE, 33 * MINUTE])).first()
    assert (r.large_gaps, r.gap_s) == (1, 1800)
    assert scalar.integrate(series(spark, [1, 2], times=[7, 7])).count() == 0


def test_value_at(spark, form):
    def at(s, t):
        return scalar.value_at(s, spark.createDataFrame([("s", t)], "dataset_id string, at_ms long")).first()

    r = at(series(spark, [10, 20], times=[0, 100_000]), 25_000)
    assert (r.interpolated, r.nearest_ts_ms, r.offset_s) == (12.5, 0, -25)
    assert at(series(spark, [1, 2], times=[0, 100]), 50).nearest_ts_ms == 0
    tied = series(spark, [1, 2, 3], times=[0, 5, 5])
    assert (at(tied, 5).interpolated, at(tied, 5).nearest_value, at(tied, 6).nearest_value) == (2, 2, 3)
    assert at(tied, 9).interpolated is None


def test_compare(spark):
    r = scalar.compare(series(spark, [8, 12]), series(spark, [8, 16])).first()
    assert (r.mean_difference, r.mean_pct_change, r.stddev_ratio) == (2, 20, 2)
    r = scalar.compare(series(spark, [0, 0]), series(spark, [2, 8])).first()
    assert (r.mean_difference, r.mean_pct_change, r.stddev_ratio) == (5, None, None)


def test_sparkline_takes_places(spark):
    short = series(spark, range(60))
    assert [r["mean"] for r in rows.sparkline(short).orderBy("bucket").collect()] == list(range(60))
    assert rows.sparkline(series(spark, range(121))).count() == 60


def test_empty_series(spark):
    empty = series(spark, [1]).where("false")
    for f in (scalar.summary_stats, scalar.percentiles, scalar.rate_of_change, scalar.integrate, scalar.fit_trend, rows.bounds, rows.intervals, rows.gaps, rows.flatlines, rows.sparkline, grids.profile, grids.auto_width, scalar.histogram):
        assert f(empty).count() == 0
