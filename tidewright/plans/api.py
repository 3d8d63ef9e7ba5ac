"""The eager interface: one call per operation, a plain dict as the answer.

Validates, fills in defaults, applies the caps on lists, adds warnings (``caveats``) and raises where the lazy
operators would give no row.  All work on rows is done by the operators.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.times import duration_ms, stamp_ms, stamp_text, window_ms
from tidewright.operators import grids, islands, rows, scalar
from tidewright.sources.store import Store

LISTED, LISTED_MOST, TEN, BINS_MOST = 20, 100, 10, 40


def _round(x: float | None, digits: int) -> float | None:
    return None if x is None else round(x, digits)


def _present(**fields: Any) -> dict:
    return {k: v for k, v in fields.items() if v is not None}


def _width_text(ms: int) -> str:
    h, rest = divmod(ms, 3_600_000)
    m, rest = divmod(rest, 60_000)
    s = f"{rest / 1000:g}s"
    return f"{h}h{m}m{s}" if h else f"{m}m{s}" if m else s


class Engine:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.store = Store(spark, root)

    # --- helpers

    def _rows(self, dataset_id: str, start: str = "", end: str = "") -> tuple[DataFrame, dict, dict]:
        """The window's rows, the catalog entry, and the window's count and range."""
        series = self.store.read(dataset_id, *window_ms(start, end))
        found = series.agg(F.count(F.lit(1)).alias("row_count"), F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms")).first()
        if not found.row_count:
            raise ValueError(f"no rows of {dataset_id} between {start or 'its start'} and {end or 'its end'}")
        return series, self.store.entry(dataset_id), found.asDict()

    @staticmethod
    def _range(lo: int, hi: int) -> dict:
        return {"start": stamp_text(lo), "end": stamp_text(hi)}

    def _head(self, entry: dict, s: dict) -> dict:
        return {"id": entry["id"], "row_count": s["row_count"], "analyzed_range": self._range(s["start_ms"], s["end_ms"])}

    @staticmethod
    def _one(df: DataFrame, problem: str) -> Row:
        found = df.first()
        if found is None:
            raise ValueError(problem)
        return found

    @staticmethod
    def _limit(limit: int) -> int:
        return LISTED if limit <= 0 else min(limit, LISTED_MOST)

    def _ref(self, e: dict) -> dict:
        return _present(id=e["id"], origin=e.get("origin"))

    # --- store

    def greet(self, name: str) -> dict:
        return {"greeting": f"Hi {name}"}

    def ingest_csv(self, path: str, name: str = "", timestamp_col: str = "", value_cols: list[str] | None = None, units: dict[str, str] | None = None) -> dict:
        made = self.store.ingest_csv(path, name or None, timestamp_col or None, value_cols, units)
        sets = [_present(dataset_id=e["id"], column=e["source_column"], unit=e.get("unit"), row_count=e["row_count"], time_range=e["time_range"]) for e in made]
        return {"group": made[0]["id"].split("/")[0], "detected": {"timestamp_column": made[0]["timestamp_column"], "value_columns": [e["source_column"] for e in made]}, "datasets": sets}

    def list_datasets(self) -> dict:
        keys = ("id", "kind", "source_column", "unit", "row_count", "time_range", "source_path", "created_at")
        return {"datasets": [{**{k: e[k] for k in keys if k in e}, "size_bytes": self.store.size(i)} for i, e in sorted(self.store.catalog().items())]}

    def describe_dataset(self, id: str) -> dict:  # noqa: A002
        e = self.store.entry(id)
        keys = ("id", "kind", "source_column", "unit", "row_count", "time_range", "source_path", "created_at", "origin")
        parent = self._ref(self.store.entry(e["parent_id"])) if e["parent_id"] else None
        return {**{k: e[k] for k in keys if k in e}, "size_bytes": self.store.size(id), "parent": parent, "children": [self._ref(c) for c in self.store.children(id)]}

    def preview_dataset(self, id: str, limit: int = 0) -> dict:  # noqa: A002
        e = self.store.entry(id)
        found = rows.preview(self.store.read(id), limit).orderBy("place").collect()
        return {"dataset_id": id, "returned": len(found), "row_count": e["row_count"], "rows": [{"timestamp": r.ts_ms, "value": r.value} for r in found]}

    def copy_dataset(self, id: str, name: str = "") -> dict:  # noqa: A002
        return self.describe_dataset(self.store.copy(id, name or None)["id"])

    def dataset_graph(self, format: str = "mermaid") -> dict:  # noqa: A002
        if format == "mermaid":
            return {"format": format, "mermaid": self.store.mermaid()}
        if format == "json":
            return {"format": format, "graph": self.store.graph()}
        raise ValueError(f"unknown format {format!r}: mermaid or json")

    def server_info(self) -> dict:
        return {
            "store_dir": self.store.files.root,
            "files": self.store.files.listing(),
            "storage_format": "parquet",
            "supported_ingest_formats": ["csv"],
            "capabilities": ["ingest", "catalog and lineage", "analysis of one series", "analysis of several series"],
        }

    def remove_outliers(self, id: str, name: str = "", start: str = "", end: str = "", iqr_multiplier: float = 0) -> dict:  # noqa: A002
        k = self._multiplier(iqr_multiplier)
        series, _, s = self._rows(id, start, end)
        fence = rows.bounds(series, k).first()
        made = self.store.remove_outliers(id, k, name or None, *window_ms(start, end))
        return {**self.describe_dataset(made["id"]), "rows_removed": s["row_count"] - made["row_count"], "bounds": {"lower": fence.lower, "upper": fence.upper}, "iqr_multiplier": k}

    def resample(self, id: str, bucket: str, agg: str = "mean", name: str = "", start: str = "", end: str = "") -> dict:  # noqa: A002
        width = duration_ms(bucket)
        _, _, s = self._rows(id, start, end)
        made = self.store.resample(id, width, agg or "mean", name or None, *window_ms(start, end))
        return {**self.describe_dataset(made["id"]), "bucket": _width_text(width), "agg": agg or "mean", "source_row_count": s["row_count"]}

    # --- one series

    @staticmethod
    def _multiplier(k: float) -> float:
        if k < 0:
            raise ValueError("iqr_multiplier must not be negative")
        return k or rows.IQR_MULTIPLIER

    def _side(self, entry: dict, series: DataFrame) -> dict:
        s = scalar.summary_stats(series).first().asDict()
        ends = {m: {"value": s[f"{m}_value"], "timestamp": stamp_text(s[f"{m}_ts_ms"])} for m in ("min", "max")}
        return {**self._head(entry, s), **ends, "mean": s["mean"], "median": s["median"], "stddev": s["stddev"], **_present(unit=entry.get("unit"))}

    def summary_stats(self, id: str, start: str = "", end: str = "") -> dict:  # noqa: A002
        series, entry, _ = self._rows(id, start, end)
        return self._side(entry, series)

    def rate_of_change(self, id: str, start: str = "", end: str = "") -> dict:  # noqa: A002
        series, entry, s = self._rows(id, start, end)
        r = self._one(scalar.rate_of_change(series), "rates need two rows at different times")
        unit = f"{entry['unit']}/second" if entry.get("unit") else "per second"
        return {
            **self._head(entry, s),
            "max_rise": {"rate": r.max_rise, "timestamp": stamp_text(r.max_rise_ts_ms)},
            "max_fall": {"rate": r.max_fall, "timestamp": stamp_text(r.max_fall_ts_ms)},
            "mean_abs_rate": r.mean_abs_rate,
            "unit": unit,
            "median_sample_interval_seconds": r.median_interval_s,
        }

    def detect_outliers(self, id: str, start: str = "", end: str = "", iqr_multiplier: float = 0, limit: int = 0) -> dict:  # noqa: A002
        if limit < 0:
            raise ValueError("limit must not be negative")
        k = self._multiplier(iqr_multiplier)
        series, entry, s = self._rows(id, start, end)
        fence = rows.bounds(series, k).first()
        total = rows.outliers(series, k).count()
        found = rows.outliers(series, k, self._limit(limit)).orderBy("place").collect()
        return {
            **self._head(entry, s),
            "iqr_multiplier": k,
            "quartiles": {"q1": fence.q1, "median": fence.median, "q3": fence.q3},
            "bounds": {"lower": fence.lower, "upper": fence.upper},
            "total_outliers": total,
            "percent": round(100 * total / s["row_count"], 2),
            "outliers": [{"timestamp": stamp_text(r.ts_ms), "value": r.value, "deviation": r.deviation} for r in found],
        }

    def profile(self, id: str, start: str = "", end: str = "", bucket: str = "") -> dict:  # noqa: A002
        width = duration_ms(bucket) if bucket else None
        series, entry, s = self._rows(id, start, end)
        found = grids.profile(series, width).orderBy("bucket").collect()
        width = width or grids.pick_width(s["end_ms"] - s["start_ms"], grids.PROFILE_BUCKETS)
        made = [_present(start=stamp_text(r.start_ms), mean=r["mean"], min=r.min_value, max=r.max_value) | {"count": r["count"]} for r in found]
        return {**self._head(entry, s), "bucket": _width_text(width), "bucket_count": len(made), "buckets": made, **_present(unit=entry.get("unit")), "caveats": []}

    def fit_trend(self, id: str, start: str = "", end: str = "") -> dict:  # noqa: A002
        series, entry, s = self._rows(id, start, end)
        t = self._one(scalar.fit_trend(series), "a trend needs two rows at different times")
        caveats = []
        if t.n < 10:
            caveats.append(f"only {t.n} points: fewer than 10 rarely make a trend")
        if t.duration_s < 48 * 3600:
            caveats.append("the window is shorter than 48 hours: a daily cycle can look like a trend")
        if t.r2 < 0.3:
            caveats.append("r_squared is below 0.3: a line fits poorly")
        return {**self._head(entry, s), "direction": t.direction, "slope_per_hour": t.slope_per_hour, "slope_per_day": t.slope_per_day, "r_squared": t.r2,
            "window_duration_seconds": t.duration_s, **_present(unit=entry.get("unit")), "caveats": caveats}

    def compare_to_baseline(self, id: str, start: str = "", end: str = "", baseline_id: str = "", baseline_start: str = "", baseline_end: str = "", iqr_multiplier: float = 0) -> dict:  # noqa: A002
        k = self._multiplier(iqr_multiplier)
        subject, entry, s = self._rows(id, start, end)
        if baseline_id or baseline_start or baseline_end:
            base = self.store.read(baseline_id or id, *window_ms(baseline_start, baseline_end))
        else:
            base = islands.before(self.store.read(id), subject)
        base = base.withColumn("dataset_id", F.lit(id))
        b = scalar.summary_stats(base).first()
        if b is None:
            raise ValueError("the baseline has no rows")
        r = islands.compare_to_baseline(subject, base, k).first()
        total = islands.episodes(subject, base, k)
        found = islands.episodes(subject, base, k, TEN).orderBy("place").collect()
        caveats = []
        if r.baseline_row_count < 30:
            caveats.append(f"the baseline has {r.baseline_row_count} rows only: what is typical is uncertain")
        if r.row_count < 4:
            caveats.append(f"the subject has {r.row_count} rows only")
        base_keys = ("median", "q1", "q3", "p05", "p95", "mean", "stddev")
        return {
            **self._head(entry, s),
            "baseline_id": baseline_id or id,
            "baseline_range": self._range(b.start_ms, b.end_ms),
            "baseline_row_count": r.baseline_row_count,
            "baseline": {c: r[f"baseline_{c}"] for c in base_keys},
            "bounds": {"lower": r.lower, "upper": r.upper},
            "subject": {"min": r.min_value, "max": r.max_value, "mean": r["mean"], "median": r["median"]},
            "points_outside": r.points_outside,
            "pct_outside": round(r.percent_outside, 2),
            "total_episodes": total.count(),
            "episodes": [{"start": stamp_text(x.start_ms), "end": stamp_text(x.end_ms), "direction": x.direction, "point_count": x.points,
                "peak_value": x.peak_value, "peak_timestamp": stamp_text(x.peak_ts_ms), "peak_deviation": x.peak_deviation} for x in found],
            **_present(unit=entry.get("unit")),
            "caveats": caveats,
        }

    def data_quality(self, id: str, start: str = "", end: str = "") -> dict:  # noqa: A002
        series, entry, s = self._rows(id, start, end)
        q = rows.intervals(series).first()
        gaps, flats = rows.gaps(series), rows.flatlines(series)
        sec = lambda ms: (ms or 0) / 1000
        return {
            **self._head(entry, s),
            "median_interval_seconds": sec(q.median_ms),
            "interval_p95_seconds": sec(q.p95_ms),
            "min_interval_seconds": sec(q.min_ms),
            "max_interval_seconds": sec(q.max_ms),
            "total_gaps": gaps.count(),
            "gaps": [{"start": stamp_text(g.start_ms), "end": stamp_text(g.end_ms), "duration_seconds": g.duration_ms / 1000} for g in rows.gaps(series, TEN).orderBy("place").collect()],
            "total_flatlines": flats.count(),
            "flatlines": [{"start": stamp_text(g.start_ms), "end": stamp_text(g.end_ms), "value": g.value,
                "point_count": g["count"]} for g in rows.flatlines(series, limit=TEN).orderBy("place").collect()],
            "duplicate_timestamps": q.duplicate_timestamps,
            **_present(unit=entry.get("unit")),
            "caveats": ["fewer than 3 points: intervals say little"] if s["row_count"] < 3 else [],
        }

    def find_events(self, id: str, condition: str, threshold: float | None = None, lower: float | None = None, upper: float | None = None, start: str = "",
        end: str = "", limit: int = 0) -> dict:  # noqa: A002
        bound = {"threshold": threshold} if condition in ("above", "below") else {"lower": lower, "upper": upper}
        islands.condition(condition, **bound)
        series, entry, s = self._rows(id, start, end)
        t = islands.event_totals(series, condition, **bound).first()
        found = islands.events(series, condition, self._limit(limit), **bound).orderBy("place").collect()
        single = sum(x.points == 1 for x in found)
        made = []
        for x in found:
            away = None if condition == "between" else x.peak_deviation
            made.append({"start": stamp_text(x.start_ms), "end": stamp_text(x.end_ms), "duration_seconds": x.duration_ms / 1000, "direction": x.direction,
                "point_count": x.points, "peak_value": x.peak_value, "peak_timestamp": stamp_text(x.peak_ts_ms), **_present(peak_deviation=away)})
        return {
            **self._head(entry, s),
            "condition": condition,
            **_present(**bound),
            "points_matching": t.points_matching,
            "pct_points": round(t.points_percent, 2),
            "time_in_events_seconds": t.time_in_events_ms / 1000,
            "pct_time": round(t.time_percent, 2),
            "total_events": t.total_events,
            "events": made,
            **_present(unit=entry.get("unit")),
            "caveats": [f"{single} of the events listed are single points, whose duration is zero"] if single else [],
        }

    def distribution(self, id: str, start: str = "", end: str = "", bins: int = 0) -> dict:  # noqa: A002
        if bins > BINS_MOST:
            raise ValueError(f"at most {BINS_MOST} bins")
        series, entry, s = self._rows(id, start, end)
        p = scalar.percentiles(series).first()
        h = scalar.histogram(series, bins if bins > 0 else None).orderBy("bin").collect()
        return {
            **self._head(entry, s),
            "min": p.min_value,
            "max": p.max_value,
            "mean": p["mean"],
            "stddev": p.stddev,
            "percentiles": {n: p[n] for n in scalar.LADDER_NAMES},
            "bin_width": h[0].bin_width,
            "histogram": [{"lower": b.lower, "upper": b.upper, "count": b["count"], "pct": round(b.percent, 2)} for b in h],
            **_present(unit=entry.get("unit")),
            "caveats": ["every value is the same: the histogram has one bin"] if p.min_value == p.max_value else [],
        }

    def seasonal_profile(self, id: str, period: str, start: str = "", end: str = "") -> dict:  # noqa: A002
        grids.position(period)
        series, entry, s = self._rows(id, start, end)
        places = grids.seasonal(series, period).orderBy("position").collect()
        c = grids.cycle_strength(series, period).first()
        empty = sum(p["count"] == 0 for p in places)
        caveats = ["positions are in UTC"]
        if c.span_periods < 2:
            caveats.append(f"the window holds {c.span_periods:.1f} periods: it takes two to show a repetition")
        if empty:
            caveats.append(f"{empty} positions are empty")
        if c.cycle_strength is None:
            caveats.append("a constant series has no cycle strength")
        made = [{"position": p.position, "label": p.label, "count": p["count"], **_present(mean=p["mean"], min=p.min_value, max=p.max_value)} for p in places]
        return {**self._head(entry, s), "period": period, "positions": made, **_present(cycle_strength=_round(c.cycle_strength, 6)),
            "span_periods": c.span_periods, **_present(unit=entry.get("unit")), "caveats": caveats}

    def integrate(self, id: str, start: str = "", end: str = "") -> dict:  # noqa: A002
        series, entry, s = self._rows(id, start, end)
        t = self._one(scalar.integrate(series), "an integral needs two rows at different times")
        caveats = [f"{t.large_gaps} gaps of {t.gap_s:.0f} s in all ({100 * t.gap_s / t.duration_s:.1f} % of the window) count as straight lines"] if t.large_gaps else []
        return {**self._head(entry, s), "integral_value_seconds": t.integral, "integral_value_hours": t.integral_hours,
            "time_weighted_mean": t.time_weighted_mean, "duration_seconds": t.duration_s, **_present(unit=entry.get("unit")), "caveats": caveats}

    def value_at(self, id: str, at: str, max_distance: str = "") -> dict:  # noqa: A002
        instant = stamp_ms(at)
        if instant is None:
            raise ValueError("at is required")
        series, entry, s = self._rows(id)
        probe = series.sparkSession.createDataFrame([(id, instant)], "dataset_id string, at_ms long")
        r = scalar.value_at(series, probe).first()
        away = abs(r.offset_s)
        if max_distance and away * 1000 > duration_ms(max_distance):
            raise ValueError(f"the nearest reading is {away:g} s away, more than {max_distance}")
        middle = scalar.median_interval(series).first().interval_ms
        caveats = []
        if not s["start_ms"] <= instant <= s["end_ms"]:
            caveats.append("the instant is outside the series: nothing is interpolated")
        if middle > 0 and away * 1000 > middle:
            caveats.append(f"the nearest reading is {away:.0f} s away; the median interval is {middle / 1000:.0f} s")
        return {"id": id, "at": stamp_text(instant), "nearest": {"timestamp": stamp_text(r.nearest_ts_ms), "value": r.nearest_value},
            "offset_seconds": r.offset_s, **_present(interpolated=r.interpolated, unit=entry.get("unit")), "caveats": caveats}

    # --- several series

    def overview(self, prefix: str = "") -> dict:
        held = {i: e for i, e in sorted(self.store.catalog().items()) if i.startswith(prefix)}
        told = {r.dataset_id: r for r in scalar.overview(self.store.read_many(list(held))).collect()} if held else {}
        out = []
        for i, e in held.items():
            r = told.get(i)
            live = _present(last_value=r.last_value, last_timestamp=stamp_text(r.last_ts_ms), mean=r["mean"], min=r.min_value, max=r.max_value, stddev=r.stddev) if r else {}
            out.append({**_present(id=i, unit=e.get("unit"), origin=e.get("origin")), "row_count": e["row_count"], "time_range": e["time_range"], **live})
        return {"dataset_count": len(out), "channels": out}

    def compare_datasets(self, id_a: str, id_b: str, start_a: str = "", end_a: str = "", start_b: str = "", end_b: str = "") -> dict:
        (a, ea, _), (b, eb, _) = self._rows(id_a, start_a, end_a), self._rows(id_b, start_b, end_b)
        r = scalar.compare(a, b).first()
        caveats = []
        if ea.get("unit") != eb.get("unit"):
            caveats.append(f"the units differ: {ea.get('unit')} and {eb.get('unit')}")
        if r.mean_pct_change is None:
            caveats.append("the mean of side A is 0: no mean_pct_change")
        if r.stddev_ratio is None:
            caveats.append("the stddev of side A is 0: no stddev_ratio")
        return {"a": self._side(ea, a), "b": self._side(eb, b), "mean_difference": r.mean_difference, **_present(mean_pct_change=r.mean_pct_change, stddev_ratio=r.stddev_ratio), "caveats": caveats}

    def _two(self, id_a: str, id_b: str, start: str, end: str, bucket: str, most: int) -> tuple[DataFrame, DataFrame, dict, dict, tuple[int, int, int]]:
        a, b = self.store.read(id_a), self.store.read(id_b)
        grid = grids.overlap(a, b, most, duration_ms(bucket) if bucket else None, *window_ms(start, end))
        return a, b, self.store.entry(id_a), self.store.entry(id_b), grid

    def correlate(self, id_a: str, id_b: str, start: str = "", end: str = "", bucket: str = "") -> dict:
        a, b, ea, eb, (lo, hi, width) = self._two(id_a, id_b, start, end, bucket, grids.CORRELATE_BUCKETS)
        r = grids.correlate(a, b, width, lo, hi).first()
        if r.aligned < 2:
            raise ValueError(f"{r.aligned} aligned samples; a correlation needs two")
        inside = lambda s: s.where(F.col("ts_ms").between(lo, hi)).count()
        caveats = []
        if r.aligned < 10:
            caveats.append(f"only {r.aligned} aligned samples: the correlation is uncertain")
        if r.pearson is None or r.spearman is None:
            caveats.append("a constant series has no correlation")
        return {
            "id_a": id_a, "id_b": id_b, "row_count_a": inside(a), "row_count_b": inside(b), "analyzed_range": self._range(lo, hi), "bucket": _width_text(width), "aligned_samples": r.aligned,
            **_present(pearson=_round(r.pearson, 6), spearman=_round(r.spearman, 6), unit_a=ea.get("unit"), unit_b=eb.get("unit")), "caveats": caveats,
        }

    def find_lag(self, id_a: str, id_b: str, start: str = "", end: str = "", bucket: str = "", max_lag: str = "") -> dict:
        a, b, ea, eb, (lo, hi, width) = self._two(id_a, id_b, start, end, bucket, grids.LAG_BUCKETS)
        shifts = -(-duration_ms(max_lag) // width) if max_lag else ((hi - lo) // width + 1) // 4
        shifts = min(grids.LAG_SHIFTS, max(1, shifts))
        r = grids.best_lag(grids.lag_scan(a, b, shifts, width, lo, hi)).first()
        caveats = []
        if r.best_shift is None:
            caveats.append("no lag has a defined correlation: too few aligned samples or a constant series")
        else:
            if abs(r.pearson_at_best) < 0.3:
                caveats.append("the best lag correlates weakly: the series may have nothing in common")
            if abs(r.best_shift) == shifts:
                caveats.append("the best lag is at the edge of what was scanned: a larger max_lag may find a better one")
            if r.aligned_at_best < 10:
                caveats.append(f"only {r.aligned_at_best} aligned samples at the best lag")
        return {
            "id_a": id_a, "id_b": id_b, "analyzed_range": self._range(lo, hi), "bucket": _width_text(width), "max_lag_scanned_seconds": shifts * width / 1000,
            **_present(best_lag_seconds=r.best_lag_s, pearson_at_best_lag=_round(r.pearson_at_best, 6)), "aligned_samples_at_best_lag": r.aligned_at_best or 0,
            **_present(pearson_at_zero_lag=_round(r.pearson_at_zero, 6)), "aligned_samples_at_zero_lag": r.aligned_at_zero or 0,
                **_present(unit_a=ea.get("unit"), unit_b=eb.get("unit")), "caveats": caveats,
        }
