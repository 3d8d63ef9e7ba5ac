"""Every operator as a query over the driver's tables, with the SQL that says the same.

Floats are rounded to six digits on both sides (sums of areas to three): engines add up in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.times import duration_ms, stamp_text
from tidewright.operators import grids, islands, rows, scalar
from tidewright.plans.api import Engine
from tidewright.sources import series as S
from tidewright.sources.files import work_dir
from tidewright.sources.store import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Windows of the driver's events (2024-01-10 and 2024-01-20, UTC).
SPLIT_MS, LATE_MS = 1_704_844_800_000, 1_705_708_800_000
HOUR_MS = 3_600_000
PROBES = (SPLIT_MS, SPLIT_MS + 12_345_678, LATE_MS)

EVENTS = "S AS (SELECT 'events/' || event_type AS dataset_id, epoch_us(ts) // 1000 AS ts_ms, value, event_id AS seq FROM events)"
ORDERS = "S AS (SELECT 'orders/' || o_orderpriority AS dataset_id, epoch_us(o_orderdate) // 1000 AS ts_ms, o_totalprice AS value, o_orderkey AS seq FROM orders)"
LINES = "S AS (SELECT 'lineitem/' || l_returnflag AS dataset_id, epoch_us(l_shipdate) // 1000 AS ts_ms, l_extendedprice AS value, (l_orderkey * 8 + l_linenumber) * 100000000 + round(l_extendedprice * 100)::BIGINT AS seq FROM lineitem)"
LAGGED = "L AS (SELECT *, lag(ts_ms) OVER w AS pt, lag(value) OVER w AS pv FROM S WINDOW w AS (PARTITION BY dataset_id ORDER BY ts_ms, seq))"
MIDDLE = "M AS (SELECT dataset_id, coalesce(floor(quantile_cont((ts_ms - pt)::DOUBLE, 0.5)), 0)::BIGINT AS mid FROM L GROUP BY dataset_id)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def query(name: str, run: Query, sql: str | None = None, digits: int = 6) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(run(spark, sf_dir), digits)
    if sql:
        SQL[name] = sql


def one(series: DataFrame, dataset_id: str) -> DataFrame:
    return series.where(F.col("dataset_id") == dataset_id)


def pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two series to correlate: the first two event types in the alphabet."""
    a, b = ("events/click", "events/error")
    e = S.events(spark, sf_dir)
    return one(e, a), one(e, b)


# --- one row per series -------------------------------------------------------------------------------------------

_SUMMARY = f"""SELECT dataset_id, count(*) AS row_count, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, {r("min(value)")} AS min_value,
arg_min(ts_ms, {{'a': value, 'b': ts_ms}}) AS min_ts_ms, {r("max(value)")} AS max_value, arg_max(ts_ms, {{'a': value, 'b': -ts_ms}}) AS max_ts_ms,
{r("avg(value)")} AS mean, {r("stddev_pop(value)")} AS stddev, {r("quantile_cont(value, 0.5)")} AS median FROM S"""
query("summary_stats", lambda s, d: scalar.summary_stats(S.events(s, d)), f"WITH {EVENTS} {_SUMMARY} GROUP BY dataset_id")
query("summary_stats_lineitem", lambda s, d: scalar.summary_stats(S.lineitem(s, d)), f"WITH {LINES} {_SUMMARY} GROUP BY dataset_id")
query("window_summary", lambda s, d: scalar.summary_stats(S.events(s, d, SPLIT_MS, LATE_MS)), f"WITH {EVENTS} {_SUMMARY} WHERE ts_ms BETWEEN {SPLIT_MS} AND {LATE_MS} GROUP BY dataset_id")
query(
    "overview",
    lambda s, d: scalar.overview(S.orders(s, d)),
    f"""WITH {ORDERS} SELECT dataset_id, count(*) AS row_count, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, {r("arg_max(value, {'a': ts_ms, 'b': seq})")} AS last_value, max(ts_ms) AS last_ts_ms,
{r("avg(value)")} AS mean, {r("min(value)")} AS min_value, {r("max(value)")} AS max_value, {r("stddev_pop(value)")} AS stddev FROM S GROUP BY dataset_id""",
)
query("overview_prefix", lambda s, d: scalar.overview(S.events(s, d).where(F.col("dataset_id").startswith("events/c"))),
    f"""WITH {EVENTS} SELECT dataset_id, count(*) AS row_count, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms,
{r("arg_max(value, {'a': ts_ms, 'b': seq})")} AS last_value, max(ts_ms) AS last_ts_ms,
{r("avg(value)")} AS mean, {r("min(value)")} AS min_value, {r("max(value)")} AS max_value, {r("stddev_pop(value)")} AS stddev FROM S WHERE starts_with(dataset_id, 'events/c') GROUP BY dataset_id""")
_LADDER = ", ".join(f"{r(f'quantile_cont(value, {q})')} AS {n}" for q, n in zip(scalar.LADDER, scalar.LADDER_NAMES, strict=True))
query("distribution_percentiles", lambda s, d: scalar.percentiles(S.events(s, d)),
    f"WITH {EVENTS} SELECT dataset_id, count(*) AS row_count, {r('min(value)')} AS min_value, {r('max(value)')} AS max_value, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS stddev, {_LADDER} FROM S GROUP BY dataset_id")
_HISTOGRAM = f"""E AS (SELECT dataset_id, count(*) AS n, min(value) AS lo, max(value) AS hi FROM S GROUP BY dataset_id),
B AS (SELECT *, CASE WHEN hi = lo THEN 1 ELSE %s END AS bins FROM E), W AS (SELECT *, (hi - lo) / bins AS w FROM B),
C AS (SELECT dataset_id, CASE WHEN w = 0 THEN 0 ELSE least(floor((value - lo) / w)::INT, bins - 1) END AS bin, count(*) AS c FROM S JOIN W USING (dataset_id) GROUP BY ALL),
G AS (SELECT *, unnest(range(0, bins))::INT AS bin FROM W)
SELECT G.dataset_id, G.bin, {r("lo + G.bin * w")} AS lower, {r("CASE WHEN G.bin = bins - 1 THEN hi ELSE lo + (G.bin + 1) * w END")} AS upper, coalesce(c,
0) AS count, {r("coalesce(c, 0) * 100.0::DOUBLE / n")} AS percent, {r("w")} AS bin_width
FROM G LEFT JOIN C ON G.dataset_id = C.dataset_id AND G.bin = C.bin"""
query("distribution_histogram", lambda s, d: scalar.histogram(S.events(s, d)), f"WITH {EVENTS}, " + _HISTOGRAM % "least(greatest(round(sqrt(n)), 3), 12)::INT")
query("distribution_histogram_40", lambda s, d: scalar.histogram(S.lineitem(s, d), 40), f"WITH {LINES}, " + _HISTOGRAM % "40")
query(
    "baseline_dist",
    lambda s, d: scalar.baseline_dist(S.events(s, d, None, SPLIT_MS - 1)),
    f"""WITH {EVENTS} SELECT dataset_id, count(*) AS row_count, {r("avg(value)")} AS mean, {r("stddev_pop(value)")} AS stddev,
{r("quantile_cont(value, 0.5)")} AS median, {r("quantile_cont(value, 0.25)")} AS q1,
{r("quantile_cont(value, 0.75)")} AS q3, {r("quantile_cont(value, 0.05)")} AS p05, {r("quantile_cont(value, 0.95)")} AS p95 FROM S WHERE ts_ms < {SPLIT_MS} GROUP BY dataset_id""",
)
_RATES = f"""R AS (SELECT *, ts_ms - pt AS dt, (value - pv) / ((ts_ms - pt) / 1000.0::DOUBLE) AS rate FROM L WHERE pt IS NOT NULL AND ts_ms > pt)
SELECT dataset_id, {r("max(rate)")} AS max_rise, arg_max(ts_ms, {{'a': rate, 'b': -ts_ms, 'c': -seq}}) AS max_rise_ts_ms, {r("min(rate)")} AS max_fall,
arg_min(ts_ms, {{'a': rate, 'b': ts_ms, 'c': seq}}) AS max_fall_ts_ms,
{r("avg(abs(rate))")} AS mean_abs_rate, {r("quantile_cont(dt::DOUBLE, 0.5) / 1000.0::DOUBLE")} AS median_interval_s FROM R GROUP BY dataset_id"""
query("rate_of_change", lambda s, d: scalar.rate_of_change(S.events(s, d)), f"WITH {EVENTS}, {LAGGED}, {_RATES}")
query("rate_of_change_ties", lambda s, d: scalar.rate_of_change(S.orders(s, d)), f"WITH {ORDERS}, {LAGGED}, {_RATES}")
query(
    "integrate",
    lambda s, d: scalar.integrate(S.events(s, d)),
    f"""WITH {EVENTS}, {LAGGED}, {MIDDLE}, A AS (SELECT dataset_id, sum((value + pv) / 2 * ((ts_ms - pt) / 1000.0::DOUBLE)) AS i, sum(ts_ms - pt) / 1000.0::DOUBLE AS s,
sum(CASE WHEN mid > 0 AND ts_ms - pt > 5 * mid THEN 1 ELSE 0 END)::BIGINT AS g,
sum(CASE WHEN mid > 0 AND ts_ms - pt > 5 * mid THEN ts_ms - pt ELSE 0 END) / 1000.0::DOUBLE AS gs FROM L JOIN M USING (dataset_id) WHERE pt IS NOT NULL
GROUP BY dataset_id)
SELECT dataset_id, {r("i", 3)} AS integral, {r("i / 3600", 3)} AS integral_hours, {r("i / s", 3)} AS time_weighted_mean, {r("s", 3)} AS duration_s,
g AS large_gaps, {r("gs", 3)} AS gap_s FROM A WHERE s > 0""",
    3,
)
query(
    "fit_trend",
    lambda s, d: scalar.fit_trend(S.events(s, d)),
    f"""WITH {EVENTS}, F AS (SELECT dataset_id, min(ts_ms) AS t0 FROM S GROUP BY dataset_id), X AS (SELECT dataset_id, (ts_ms - t0) / 3600000.0::DOUBLE AS x,
value AS y FROM S JOIN F USING (dataset_id)),
A AS (SELECT dataset_id, count(*) AS n, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy, max(x) AS h FROM X GROUP BY dataset_id),
B AS (SELECT *, sxy / sxx AS b, 1.96 * sqrt(greatest(0.0, syy - sxy * sxy / sxx) / greatest(n - 2, 1) / sxx) AS m FROM A WHERE sxx > 0)
SELECT dataset_id, n, {r("b")} AS slope_per_hour, {r("b * 24")} AS slope_per_day, {r("CASE WHEN syy > 0 THEN sxy * sxy / (sxx * syy) ELSE 0.0 END")} AS r2, {r("h * 3600")} AS duration_s,
CASE WHEN n < 3 THEN 'flat' WHEN b - m > 0 THEN 'increasing' WHEN b + m < 0 THEN 'decreasing' ELSE 'flat' END AS direction FROM B""",
)
_SIDE = "avg(value) AS mean, stddev_pop(value) AS sd, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.5) AS md, count(*) AS n"
query(
    "compare_datasets",
    lambda s, d: scalar.compare(*pair(s, d)),
    f"""WITH {EVENTS}, A AS (SELECT {_SIDE} FROM S WHERE dataset_id = 'events/click'), B AS (SELECT {_SIDE} FROM S WHERE dataset_id = 'events/error')
SELECT 'events/click' AS a_id, A.n AS a_row_count, {r("A.mean")} AS a_mean, {r("A.sd")} AS a_stddev, {r("A.lo")} AS a_min_value, {r("A.hi")} AS a_max_value, {r("A.md")} AS a_median,
'events/error' AS b_id, B.n AS b_row_count, {r("B.mean")} AS b_mean, {r("B.sd")} AS b_stddev, {r("B.lo")} AS b_min_value, {r("B.hi")} AS b_max_value, {r("B.md")} AS b_median,
{r("B.mean - A.mean")} AS mean_difference, {r("(B.mean - A.mean) * 100 / nullif(A.mean, 0)")} AS mean_pct_change, {r("B.sd / nullif(A.sd, 0)")} AS stddev_ratio FROM A, B WHERE A.n > 0 AND B.n > 0""",
)


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.events(spark, sf_dir)
    return scalar.value_at(e, e.select("dataset_id").distinct().withColumn("at_ms", F.explode(F.array(*[F.lit(p).cast("long") for p in PROBES]))))


query(
    "value_at",
    _probes,
    f"""WITH {EVENTS}, P AS (SELECT DISTINCT dataset_id, unnest([{", ".join(f"{p}::BIGINT" for p in PROBES)}]) AS at_ms FROM S),
A AS (SELECT P.dataset_id, at_ms, max({{'t': S.ts_ms, 's': S.seq, 'v': S.value}}) FILTER (S.ts_ms < at_ms) AS b, min({{'t': S.ts_ms, 's': S.seq,
'v': S.value}}) FILTER (S.ts_ms >= at_ms) AS a FROM P JOIN S USING (dataset_id) GROUP BY ALL),
N AS (SELECT *, CASE WHEN a IS NULL OR (b IS NOT NULL AND at_ms - b.t <= a.t - at_ms) THEN b ELSE a END AS n FROM A)
SELECT dataset_id, at_ms, n.t AS nearest_ts_ms, {r("n.v")} AS nearest_value, {r("(n.t - at_ms) / 1000.0::DOUBLE")} AS offset_s,
{r("CASE WHEN a.t = at_ms THEN a.v WHEN a IS NOT NULL AND b IS NOT NULL THEN b.v + (a.v - b.v) * ((at_ms - b.t)::DOUBLE / (a.t - b.t)) END")} AS interpolated FROM N""",
)

# --- rows ---------------------------------------------------------------------------------------------------------

_FENCE = "Q AS (SELECT dataset_id, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS md, quantile_cont(value, 0.75) AS q3 FROM S GROUP BY dataset_id), B AS (SELECT *, q1 - %s * (q3 - q1) AS lo, q3 + %s * (q3 - q1) AS hi FROM Q)"
query("outlier_bounds", lambda s, d: rows.bounds(S.events(s, d)),
    f"WITH {EVENTS}, {_FENCE % (1.5, 1.5)} SELECT dataset_id, n AS row_count, {r('q1')} AS q1, {r('md')} AS median, {r('q3')} AS q3, {r('lo')} AS lower, {r('hi')} AS upper FROM B")
_OUT = f"D AS (SELECT S.*, greatest(lo - value, value - hi, 0.0) AS dev FROM S JOIN B USING (dataset_id)) SELECT dataset_id, ts_ms, seq, {r('value')} AS value, {r('dev')} AS deviation"
query("detect_outliers", lambda s, d: rows.outliers(S.events(s, d), 0.5), f"WITH {EVENTS}, {_FENCE % (0.5, 0.5)}, {_OUT} FROM D WHERE dev > 0")
query("detect_outliers_top", lambda s, d: rows.outliers(S.orders(s, d), 0.5, 20),
    f"WITH {ORDERS}, {_FENCE % (0.5, 0.5)}, {_OUT}, row_number() OVER (PARTITION BY dataset_id ORDER BY dev DESC, ts_ms, seq)::INT AS place FROM D WHERE dev > 0 QUALIFY place <= 20")
query("remove_outliers", lambda s, d: rows.inliers(S.events(s, d), 0.5),
    f"WITH {EVENTS}, {_FENCE % (0.5, 0.5)} SELECT S.dataset_id, ts_ms, {r('value')} AS value, seq FROM S JOIN B USING (dataset_id) WHERE greatest(lo - value, value - hi, 0.0) = 0")
_INTERVALS = """SELECT dataset_id, count(*) AS row_count, coalesce(floor(quantile_cont((ts_ms - pt)::DOUBLE, 0.5)), 0)::BIGINT AS median_ms,
floor(quantile_cont(CASE WHEN ts_ms > pt THEN ts_ms - pt END::DOUBLE, 0.95))::BIGINT AS p95_ms,
min(CASE WHEN ts_ms > pt THEN ts_ms - pt END) AS min_ms, max(CASE WHEN ts_ms > pt THEN ts_ms - pt END) AS max_ms,
sum(CASE WHEN ts_ms = pt THEN 1 ELSE 0 END)::BIGINT AS duplicate_timestamps FROM L GROUP BY dataset_id"""
query("data_quality_intervals", lambda s, d: rows.intervals(S.events(s, d)), f"WITH {EVENTS}, {LAGGED} {_INTERVALS}")
query("duplicate_timestamps", lambda s, d: rows.intervals(S.orders(s, d)), f"WITH {ORDERS}, {LAGGED} {_INTERVALS}")
_GAPS = "SELECT dataset_id, pt AS start_ms, ts_ms AS end_ms, ts_ms - pt AS duration_ms%s FROM L JOIN M USING (dataset_id) WHERE mid > 0 AND ts_ms - pt > 5 * mid"
query("data_quality_gaps", lambda s, d: rows.gaps(S.events(s, d)), f"WITH {EVENTS}, {LAGGED}, {MIDDLE} {_GAPS % ''}")
query("data_quality_gaps_top", lambda s, d: rows.gaps(S.events(s, d), 10),
    f"WITH {EVENTS}, {LAGGED}, {MIDDLE} {_GAPS % ', row_number() OVER (PARTITION BY dataset_id ORDER BY ts_ms - pt DESC, pt)::INT AS place'} QUALIFY place <= 10")


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices in steps of a quarter of a million, which repeat for long."""
    return S.orders(spark, sf_dir).withColumn("value", F.floor(F.col("value") / 250_000).cast("double"))


query(
    "data_quality_flatlines",
    lambda s, d: rows.flatlines(_coarse(s, d), 3),
    f"""WITH {ORDERS.replace("o_totalprice AS value", "floor(o_totalprice / 250000) AS value")}, {LAGGED}, C AS (SELECT *,
sum(CASE WHEN pv IS NULL OR pv <> value THEN 1 ELSE 0 END) OVER (PARTITION BY dataset_id ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS run FROM L)
SELECT dataset_id, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, {r("min(value)")} AS value, count(*) AS count FROM C GROUP BY dataset_id, run HAVING count(*) >= 3""",
)
query("preview_dataset", lambda s, d: rows.preview(S.events(s, d)),
    f"WITH {EVENTS} SELECT dataset_id, ts_ms, {r('value')} AS value, seq, row_number() OVER (PARTITION BY dataset_id ORDER BY seq, ts_ms)::INT AS place FROM S QUALIFY place <= 20")
query("series_read", lambda s, d: rows.readings(S.events(s, d)),
    f"WITH {EVENTS} SELECT dataset_id, row_number() OVER (PARTITION BY dataset_id ORDER BY ts_ms, seq) - 1 AS place, ts_ms, {r('value')} AS value FROM S WHERE isfinite(value)")
query(
    "sparkline",
    lambda s, d: rows.sparkline(S.orders(s, d)),
    f"""WITH {ORDERS}, N AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY ts_ms, seq) - 1 AS place, count(*) OVER (PARTITION BY dataset_id) AS n FROM S)
SELECT dataset_id, CASE WHEN n <= 60 THEN place ELSE (place * 60 + 59) // n END AS bucket, {r("avg(value)")} AS mean FROM N GROUP BY ALL""",
)

# --- grids --------------------------------------------------------------------------------------------------------


def _ladder(span: str, most: int) -> str:
    return "CASE " + " ".join(f"WHEN ({span}) // {w} + 1 <= {most} THEN {w}" for w in grids.WIDTHS_MS) + f" ELSE {grids.WIDTHS_MS[-1]} END"


_GRID = f"G AS (SELECT dataset_id, min(ts_ms) AS t0, max(ts_ms) AS t1, ({_ladder('max(ts_ms) - min(ts_ms)', 48)})::BIGINT AS w FROM S GROUP BY dataset_id)"
query("auto_width", lambda s, d: grids.auto_width(S.events(s, d)), f"WITH {EVENTS}, {_GRID} SELECT dataset_id, t0 AS start_ms, t1 AS end_ms, w AS width_ms FROM G")
_PROFILE = f"""A AS (SELECT dataset_id, (ts_ms - t0) // w AS bucket, count(*) AS c, avg(value) AS m, min(value) AS lo, max(value) AS hi FROM S JOIN G USING (dataset_id) GROUP BY ALL),
D AS (SELECT *, unnest(range(0, (t1 - t0) // w + 1)) AS bucket FROM G)
SELECT D.dataset_id, D.bucket, t0 + D.bucket * w AS start_ms, coalesce(c, 0) AS count, {r("m")} AS mean, {r("lo")} AS min_value, {r("hi")} AS max_value FROM D
LEFT JOIN A ON D.dataset_id = A.dataset_id AND D.bucket = A.bucket"""
query("profile", lambda s, d: grids.profile(S.events(s, d)), f"WITH {EVENTS}, {_GRID}, {_PROFILE}")
_DAYS = 3 * 24 * HOUR_MS
query("profile_bucket", lambda s, d: grids.profile(S.events(s, d), _DAYS),
    f"WITH {EVENTS}, G AS (SELECT dataset_id, min(ts_ms) AS t0, max(ts_ms) AS t1, {_DAYS}::BIGINT AS w FROM S GROUP BY dataset_id), {_PROFILE}")
for _how, _sql in {"mean": "avg(value)", "min": "min(value)", "max": "max(value)", "median": "quantile_cont(value, 0.5)"}.items():
    query(f"resample_{_how}", lambda s, d, how=_how: grids.resample(S.events(s, d), 6 * HOUR_MS, how),
        f"WITH {EVENTS}, {_GRID} SELECT dataset_id, t0 + ((ts_ms - t0) // {6 * HOUR_MS}) * {6 * HOUR_MS} AS ts_ms, {r(_sql)} AS value, (ts_ms - t0) // {6 * HOUR_MS} AS seq FROM S JOIN G USING (dataset_id) GROUP BY dataset_id, t0, (ts_ms - t0) // {6 * HOUR_MS}")
_PLACES = {"hour_of_day": ("(ts_ms // 3600000) % 24", 24, "lpad(p::VARCHAR, 2, '0') || ':00'", 86_400_000),
    "day_of_week": ("(ts_ms // 86400000 + 4) % 7", 7, "['Sunday', 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday'][p + 1]", 604_800_000)}
for _period, (_place, _n, _label, _ms) in _PLACES.items():
    query(
        f"seasonal_{_period}",
        lambda s, d, period=_period: grids.seasonal(S.events(s, d), period),
        f"""WITH {EVENTS}, A AS (SELECT dataset_id, ({_place})::INT AS p, count(*) AS c, avg(value) AS m, min(value) AS lo, max(value) AS hi FROM S
GROUP BY ALL), D AS (SELECT DISTINCT dataset_id FROM S), E AS (SELECT dataset_id, unnest(range(0, {_n}))::INT AS p FROM D)
SELECT dataset_id, p AS position, {_label} AS label, coalesce(c, 0) AS count, {r("m")} AS mean, {r("lo")} AS min_value, {r("hi")} AS max_value FROM E LEFT JOIN A USING (dataset_id, p)""",
    )
    query(
        f"cycle_strength_{_period}",
        lambda s, d, period=_period: grids.cycle_strength(S.events(s, d), period),
        f"""WITH {EVENTS}, G AS (SELECT dataset_id, count(*) AS n, avg(value) AS g, var_pop(value) * count(*) AS t, (max(ts_ms) - min(ts_ms)) / {_ms}.0::DOUBLE AS sp FROM S GROUP BY dataset_id),
A AS (SELECT dataset_id, {_place} AS p, count(*) AS c, avg(value) AS m FROM S GROUP BY ALL)
SELECT dataset_id, any_value(n) AS row_count, {r("sum(c * (m - g) * (m - g)) / nullif(any_value(t), 0)")} AS cycle_strength,
{r("any_value(sp)")} AS span_periods FROM A JOIN G USING (dataset_id) GROUP BY dataset_id""",
    )
_TWO = f"""{EVENTS}, O AS (SELECT max(a) AS lo, min(b) AS hi FROM (SELECT min(ts_ms) AS a, max(ts_ms) AS b FROM S WHERE dataset_id IN ('events/click', 'events/error') GROUP BY dataset_id)),
U AS (SELECT min(ts_ms) AS a, max(ts_ms) AS b FROM S, O WHERE dataset_id IN ('events/click', 'events/error') AND ts_ms BETWEEN lo AND hi)"""
_MEANS = "{n} AS (SELECT (ts_ms - lo) // w AS k, avg(value) AS {v} FROM S, O, W WHERE dataset_id = '{id}' AND ts_ms BETWEEN lo AND hi GROUP BY ALL)"
_BOTH = f"{_MEANS.format(n='A', v='x', id='events/click')}, {_MEANS.format(n='B', v='y', id='events/error')}"
_R = "covar_pop(x, y) / nullif(sqrt(var_pop(x)) * sqrt(var_pop(y)), 0)"
query(
    "correlate",
    lambda s, d: grids.correlate(*pair(s, d)),
    f"""WITH {_TWO}, W AS (SELECT ({_ladder("b - a", 100)})::BIGINT AS w FROM U), {_BOTH}, J AS (SELECT x, y FROM A JOIN B USING (k)),
K AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM J)
SELECT count(*) AS aligned, {r(_R)} AS pearson, {r(_R.replace("x", "rx").replace("varrx", "var").replace("y", "ry"))} AS spearman FROM K""",
)
query(
    "correlate_bucket",
    lambda s, d: grids.correlate(*pair(s, d), width_ms=8 * HOUR_MS),
    f"""WITH {_TWO}, W AS (SELECT {8 * HOUR_MS}::BIGINT AS w), {_BOTH}, J AS (SELECT x, y FROM A JOIN B USING (k)),
K AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM J)
SELECT count(*) AS aligned, {r(_R)} AS pearson, {r(_R.replace("x", "rx").replace("varrx", "var").replace("y", "ry"))} AS spearman FROM K""",
)
query(
    "find_lag_bucket",
    lambda s, d: grids.lag_scan(*pair(s, d), 7, 2 * HOUR_MS),
    f"""WITH {_TWO}, W AS (SELECT {2 * HOUR_MS}::BIGINT AS w), {_BOTH}, H AS (SELECT unnest(range(-7, 8)) AS shift, w FROM W),
C AS (SELECT shift, any_value(w) AS w, count(*) AS n, {_R} AS p FROM H, A JOIN B ON B.k = A.k + H.shift GROUP BY shift)
SELECT shift, {r("shift * w / 1000.0::DOUBLE")} AS lag_s, n AS aligned, {r("CASE WHEN n >= 3 THEN p END")} AS pearson FROM C""",
)
_SCAN = f"""WITH {_TWO}, W AS (SELECT ({_ladder("b - a", 200)})::BIGINT AS w FROM U), {_BOTH}, T AS (SELECT least(500, greatest(1,
((hi - lo) // w + 1) // 4)) AS most, w FROM O, W), H AS (SELECT unnest(range(-most, most + 1)) AS shift, w FROM T),
C AS (SELECT shift, any_value(w) AS w, count(*) AS n, {_R} AS p FROM H, A JOIN B ON B.k = A.k + H.shift GROUP BY shift), V AS (SELECT shift,
shift * w / 1000.0::DOUBLE AS lag_s, n, CASE WHEN n >= 3 THEN p END AS p FROM C)"""
query("find_lag_scan", lambda s, d: grids.lag_scan(*pair(s, d)), f"{_SCAN} SELECT shift, {r('lag_s')} AS lag_s, n AS aligned, {r('p')} AS pearson FROM V")
query(
    "find_lag_best",
    lambda s, d: grids.best_lag(grids.lag_scan(*pair(s, d))),
    f"""{_SCAN}, X AS (SELECT * FROM V WHERE p IS NOT NULL ORDER BY round(abs(p), 9) DESC, shift LIMIT 1), Z AS (SELECT p, n FROM V WHERE shift = 0)
SELECT shift AS best_shift, {r("lag_s")} AS best_lag_s, {r("X.p")} AS pearson_at_best, X.n AS aligned_at_best, {r("(SELECT p FROM Z)")} AS pearson_at_zero,
coalesce((SELECT n FROM Z), 0) AS aligned_at_zero FROM X""",
)

# --- stretches ----------------------------------------------------------------------------------------------------

_ISLANDS = f"""I AS (SELECT *, sum(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY dataset_id ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS i FROM T)
SELECT dataset_id, dir AS direction, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, max(ts_ms) - min(ts_ms) AS duration_ms, count(*) AS points,
{r("arg_max(value, {'a': rk, 'b': -ts_ms, 'c': -seq})")} AS peak_value,
arg_max(ts_ms, {{'a': rk, 'b': -ts_ms, 'c': -seq}}) AS peak_ts_ms, {r("arg_max(dev, {'a': rk, 'b': -ts_ms, 'c': -seq})")} AS peak_deviation FROM I WHERE dir IS NOT NULL GROUP BY dataset_id, i, dir"""


def _events_sql(direction: str, deviation: str, rank: str) -> str:
    return f"""WITH {EVENTS}, {LAGGED}, {MIDDLE}, N AS (SELECT S.*, {direction} AS dir, ({deviation})::DOUBLE AS dev, ({rank})::DOUBLE AS rk FROM S),
P AS (SELECT *, lag(ts_ms) OVER w AS pt, lag(dir) OVER w AS pd FROM N WINDOW w AS (PARTITION BY dataset_id ORDER BY ts_ms, seq)),
T AS (SELECT P.*, dir IS NOT NULL AND (pt IS NULL OR pd IS NULL OR pd <> dir OR (mid > 0 AND ts_ms - pt > 3 * mid)) AS st FROM P JOIN M USING (dataset_id)), {_ISLANDS}"""


_KINDS: dict[str, tuple[dict, str, str, str]] = {
    "above": ({"threshold": 80.0}, "CASE WHEN value > 80 THEN 'above' END", "value - 80", "value - 80"),
    "below": ({"threshold": 20.0}, "CASE WHEN value < 20 THEN 'below' END", "20 - value", "20 - value"),
    "between": ({"lower": 30.0, "upper": 70.0}, "CASE WHEN value BETWEEN 30 AND 70 THEN 'within' END", "0", "value"),
    "outside": ({"lower": 30.0, "upper": 70.0}, "CASE WHEN value < 30 THEN 'below' WHEN value > 70 THEN 'above' END", "greatest(30 - value, value - 70)", "greatest(30 - value, value - 70)"),
}
for _kind, (_bound, _dir, _dev, _rank) in _KINDS.items():
    query(f"find_events_{_kind}", lambda s, d, kind=_kind, bound=_bound: islands.events(S.events(s, d), kind, **bound), _events_sql(_dir, _dev, _rank))
query(
    "find_events_top",
    lambda s, d: islands.events(S.events(s, d), "above", 20, threshold=80.0),
    f"""WITH Y AS ({_events_sql(*_KINDS["above"][1:])}) SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY duration_ms DESC, points DESC,
start_ms)::INT AS place FROM Y QUALIFY place <= 20""",
)
query(
    "find_events_totals",
    lambda s, d: islands.event_totals(S.events(s, d), "above", threshold=80.0),
    f"""WITH Y AS ({_events_sql(*_KINDS["above"][1:])}), {EVENTS}, E AS (SELECT dataset_id, count(*) AS ev, sum(points)::BIGINT AS p,
sum(duration_ms)::BIGINT AS ms FROM Y GROUP BY dataset_id), A AS (SELECT dataset_id, count(*) AS n, max(ts_ms) - min(ts_ms) AS sp FROM S GROUP BY dataset_id)
SELECT dataset_id, coalesce(ev, 0) AS total_events, coalesce(p, 0) AS points_matching, {r("coalesce(p, 0) * 100::DOUBLE / n")} AS points_percent, coalesce(ms,
0) AS time_in_events_ms, {r("coalesce(coalesce(ms, 0) * 100::DOUBLE / nullif(sp, 0), 0)")} AS time_percent FROM A LEFT JOIN E USING (dataset_id)""",
)


def _subject(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    subject = S.events(spark, sf_dir, SPLIT_MS, None)
    return subject, islands.before(S.events(spark, sf_dir), subject)


_BASE = f"""{EVENTS.replace("S AS", "Z AS")}, S AS (SELECT * FROM Z WHERE ts_ms >= {SPLIT_MS}), F AS (SELECT dataset_id, min(ts_ms) AS t0 FROM S
GROUP BY dataset_id), Y AS (SELECT Z.* FROM Z JOIN F USING (dataset_id) WHERE ts_ms < t0),
Q AS (SELECT dataset_id, count(*) AS bn, avg(value) AS bm, stddev_pop(value) AS bs, quantile_cont(value, 0.5) AS md, quantile_cont(value, 0.25) AS q1,
quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.95) AS p95 FROM Y GROUP BY dataset_id),
B AS (SELECT *, q1 - 0.5 * (q3 - q1) AS lo, q3 + 0.5 * (q3 - q1) AS hi FROM Q)"""
query(
    "compare_to_baseline",
    lambda s, d: islands.compare_to_baseline(*_subject(s, d), 0.5),
    f"""WITH {_BASE} SELECT dataset_id, count(*) AS row_count, {r("min(value)")} AS min_value, {r("max(value)")} AS max_value, {r("avg(value)")} AS mean,
{r("quantile_cont(value, 0.5)")} AS median, count(*) FILTER (value < lo OR value > hi) AS points_outside,
{r("count(*) FILTER (value < lo OR value > hi) * 100::DOUBLE / count(*)")} AS percent_outside, any_value(bn) AS baseline_row_count, {r("any_value(md)")} AS baseline_median, {r("any_value(q1)")} AS baseline_q1, {r("any_value(q3)")} AS baseline_q3, {r("any_value(p05)")} AS baseline_p05,
{r("any_value(p95)")} AS baseline_p95, {r("any_value(bm)")} AS baseline_mean, {r("any_value(bs)")} AS baseline_stddev, {r("any_value(lo)")} AS lower,
{r("any_value(hi)")} AS upper FROM S JOIN B USING (dataset_id) GROUP BY dataset_id""",
)
query(
    "compare_to_baseline_episodes",
    lambda s, d: islands.episodes(*_subject(s, d), 0.5),
    f"""WITH {_BASE}, {LAGGED}, {MIDDLE}, N AS (SELECT S.*, CASE WHEN value < lo THEN 'below' WHEN value > hi THEN 'above' END AS dir, greatest(lo - value,
value - hi) AS dev, greatest(lo - value, value - hi) AS rk FROM S JOIN B USING (dataset_id) WHERE value < lo OR value > hi),
P AS (SELECT *, lag(ts_ms) OVER w AS pt, lag(dir) OVER w AS pd FROM N WINDOW w AS (PARTITION BY dataset_id ORDER BY ts_ms, seq)), T AS (SELECT P.*,
pt IS NULL OR pd <> dir OR (mid > 0 AND ts_ms - pt > 3 * mid) AS st FROM P JOIN M USING (dataset_id)), {_ISLANDS}""",
)

# --- files, store, lineage ----------------------------------------------------------------------------------------


def _ingested(spark: SparkSession, sf_dir: str) -> Store:
    """The events as a wide CSV file of two channels, ingested into a new store."""
    folder = work_dir(spark, "ingest")
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    table.select(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("event_time"), "value", "user_id").write.csv(f"{folder}/events.csv", header=True)
    store = Store(spark, f"{folder}/store")
    store.ingest_csv(f"{folder}/events.csv", multi_line=False)
    return store


def _ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _ingested(spark, sf_dir)
    stored = store.read_many(sorted(store.catalog()))
    return stored.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("row_count"), F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"),
        F.avg("value").alias("mean"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))


def _lineage(spark: SparkSession, sf_dir: str) -> Store:
    store = _ingested(spark, sf_dir)
    store.copy("events/value")
    store.remove_outliers("events/value")
    store.resample("events/value-3", 6 * HOUR_MS)
    return store


_ALL = "E AS (SELECT epoch_us(ts) // 1000 AS ts_ms, value, user_id::DOUBLE AS user_id FROM events)"
_CHANNEL = "SELECT 'events/{c}' AS dataset_id, count(*) AS row_count, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, round(avg({c}), 6) + 0.0 AS mean, round(min({c}), 6) + 0.0 AS min_value, round(max({c}), 6) + 0.0 AS max_value FROM E"
query("ingest_csv", _ingest_summary, f"WITH {_ALL} {_CHANNEL.format(c='value')} UNION ALL {_CHANNEL.format(c='user_id')}")
query(
    "list_datasets",
    lambda s, d: _lineage(s, d).entries().select("id", "kind", "source_column", "row_count", "parent_id", F.coalesce("origin", F.lit("")).alias("origin")),
    f"""WITH {_ALL}, Q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM E), K AS (SELECT E.* FROM E, Q
WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
R AS (SELECT count(DISTINCT (ts_ms - t0) // {6 * HOUR_MS}) AS n FROM K, (SELECT min(ts_ms) AS t0 FROM K))
SELECT 'events/value' AS id, 'measurement' AS kind, 'value' AS source_column, count(*) AS row_count, '' AS parent_id, '' AS origin FROM E
UNION ALL SELECT 'events/user_id', 'measurement', 'user_id', count(*), '', '' FROM E
UNION ALL SELECT 'events/value-2', 'measurement', 'value', count(*), 'events/value', 'copy' FROM E UNION ALL SELECT 'events/value-3', 'measurement', 'value',
count(*), 'events/value', 'remove_outliers' FROM K
UNION ALL SELECT 'events/value-3-2', 'measurement', 'value', n, 'events/value-3', 'resample' FROM R""",
)
query("graph_edges", lambda s, d: _lineage(s, d).edges(), "SELECT * FROM (VALUES ('events/value', 'events/value-2', 'copy'), ('events/value', 'events/value-3', 'remove_outliers'), ('events/value-3', 'events/value-3-2', 'resample')) t(parent, child, origin)")


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _lineage(spark, sf_dir).entries()
    children = e.where("parent_id <> ''").groupBy(F.col("parent_id").alias("p")).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("children"))
    return e.join(children, F.col("id") == F.col("p"), "left").select("id", "parent_id", F.coalesce("origin", F.lit("")).alias("origin"), F.coalesce("children", F.lit("")).alias("children"))


def _copied(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _ingested(spark, sf_dir)
    made = store.copy("events/value", "Copy of it")
    return scalar.summary_stats(store.read(made["id"]))


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _lineage(spark, sf_dir).graph()
    nodes = [(k, n["parent_id"], n.get("origin", ""), ",".join(n["children"]), k in graph["roots"]) for k, n in graph["nodes"].items()]
    return spark.createDataFrame(nodes, "id string, parent_id string, origin string, children string, is_root boolean")


def _variant(spark: SparkSession, sf_dir: str, columns: dict, **options) -> DataFrame:
    """The events in another form of CSV, ingested, summarised by channel."""
    folder = work_dir(spark, "ingest")
    table = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    table.select(*[c.alias(n) for n, c in columns.items()]).write.csv(f"{folder}/events.csv", header=True)
    store = Store(spark, f"{folder}/store")
    store.ingest_csv(f"{folder}/events.csv", multi_line=False, **options)
    stored = store.read_many(sorted(store.catalog()))
    return stored.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("row_count"), F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.avg("value").alias("mean"))


def _mermaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in _lineage(spark, sf_dir).mermaid().splitlines()], "line string")


def _info(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = Engine(spark, _ingested(spark, sf_dir).files.root).server_info()
    return spark.createDataFrame([(info["storage_format"], ",".join(info["supported_ingest_formats"]), "catalog.json" in info["files"])],
        "storage_format string, supported_ingest_formats string, has_catalog boolean")


query(
    "describe_dataset",
    _described,
    """SELECT * FROM (VALUES ('events/user_id', '', '', ''), ('events/value', '', '', 'events/value-2,events/value-3'), ('events/value-2', 'events/value', 'copy', ''),
('events/value-3', 'events/value', 'remove_outliers', 'events/value-3-2'), ('events/value-3-2', 'events/value-3', 'resample', '')) t(id, parent_id, origin, children)""",
)
query("copy_dataset", _copied, f"WITH S AS (SELECT 'copy_of_it' AS dataset_id, epoch_us(ts) // 1000 AS ts_ms, value FROM events) {_SUMMARY} GROUP BY dataset_id")
query(
    "dataset_graph",
    _mermaid,
    """SELECT * FROM (VALUES ('graph TD'), ('  events_user_id["events/user_id"]'), ('  events_value["events/value"]'), ('  events_value_2["events/value-2"]'),
('  events_value_3["events/value-3"]'), ('  events_value_3_2["events/value-3-2"]'),
('  events_value -->|copy| events_value_2'), ('  events_value -->|remove_outliers| events_value_3'), ('  events_value_3 -->|resample| events_value_3_2')) t(line)""",
)
query("server_info", _info, "SELECT 'parquet' AS storage_format, 'csv' AS supported_ingest_formats, true AS has_catalog")
query("greet", lambda s, d: s.read.parquet(f"{d}/region.parquet").select(F.concat(F.lit("Hi "), "r_name").alias("greeting")), "SELECT 'Hi ' || r_name AS greeting FROM region")
query(
    "dataset_graph_json",
    _graph,
    """SELECT * FROM (VALUES ('events/user_id', '', '', '', true), ('events/value', '', '', 'events/value-2,events/value-3', true), ('events/value-2', 'events/value', 'copy', '', false),
('events/value-3', 'events/value', 'remove_outliers', 'events/value-3-2', false), ('events/value-3-2', 'events/value-3', 'resample', '', false)) t(id, parent_id, origin, children, is_root)""",
)

# Forms of ingest: epochs, explicit columns and names, blank cells, and other layouts of time.
_FORM = "SELECT '{id}' AS dataset_id, count(*) AS row_count, min({t}) AS start_ms, max({t}) AS end_ms, round(avg(value), 6) + 0.0 AS mean FROM events"
_SECONDS = "epoch_us(ts) // 1000000 * 1000"
query("ingest_epoch_ms", lambda s, d: _variant(s, d, {"reading": F.col("value"), "epoch": F.unix_millis("ts")}), _FORM.format(id="events/reading", t="epoch_us(ts) // 1000"))
query("ingest_epoch_seconds", lambda s, d: _variant(s, d, {"event_ts": F.unix_seconds("ts"), "value": F.col("value")}), _FORM.format(id="events/value", t=_SECONDS))
query(
    "ingest_overrides",
    lambda s, d: _variant(s, d, {"time": F.lit("2020-01-01"), "seen": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "other": F.col("user_id"),
        "value": F.col("value")}, name="Named Set", timestamp_col="seen", value_cols=["value"], units={"value": "V"}),
    _FORM.format(id="named_set/value", t=_SECONDS),
)
query(
    "ingest_blanks",
    lambda s, d: _variant(s, d, {"ts": F.when(F.col("event_id") % 5 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")),
        "value": F.when(F.col("event_id") % 3 != 0, F.col("value"))}, timestamp_col="ts", value_cols=["value"]),
    _FORM.format(id="events/value", t=_SECONDS) + " WHERE event_id % 5 <> 0 AND event_id % 3 <> 0",
)
for _name, _layout, _t in (("us", "MM/dd/yyyy HH:mm:ss", _SECONDS), ("us_short", "M/d/yyyy HH:mm:ss", _SECONDS),
    ("us_date", "M/d/yyyy", "epoch_us(date_trunc('day', ts)) // 1000"), ("date", "yyyy-MM-dd", "epoch_us(date_trunc('day', ts)) // 1000"),
    ("offset", "yyyy-MM-dd'T'HH:mm:ssXXX", _SECONDS)):
    query(f"ingest_layout_{_name}", lambda s, d, layout=_layout: _variant(s, d, {"day": F.date_format("ts", layout), "value": F.col("value")},
        timestamp_col="day"), _FORM.format(id="events/value", t=_t))

# --- the eager interface: caveats, errors, rounding, rendering ------------------------------------------------------

_EAGER = "E AS (SELECT epoch_us(ts) // 1000 AS t, value AS v FROM events), N AS (SELECT count(*) AS n, min(t) AS lo, max(t) AS hi, max(t) - min(t) AS span FROM E)"


def _eager(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, _ingested(spark, sf_dir).files.root)


def _caveats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = _eager(spark, sf_dir), "events/value"
    told = {
        "fit_trend": e.fit_trend(i), "data_quality": e.data_quality(i), "distribution": e.distribution(i), "hour_of_day": e.seasonal_profile(i, "hour_of_day"),
            "day_of_week": e.seasonal_profile(i, "day_of_week"),
        "value_at": e.value_at(i, "1970-01-01T00:00:00Z"), "compare_datasets": e.compare_datasets(i, "events/user_id"), "compare_to_baseline": e.compare_to_baseline(i, start=stamp_text(SPLIT_MS)),
        "correlate": e.correlate(i, i), "one_row": e.fit_trend(i, end=stamp_text(SPLIT_MS)), "profile": e.profile(i),
    }
    return spark.createDataFrame([(k, c) for k, x in told.items() for c in x["caveats"]], "operation string, caveat string")


def _trend_caveats(name: str, where: str) -> str:
    source = f"(SELECT count(*) AS n, (max(t) - min(t)) / 1000.0 AS s, regr_r2(v, t) AS r2 FROM E {where})"
    return f"""SELECT '{name}' AS operation, printf('only %d points: fewer than 10 rarely make a trend', n) AS caveat FROM {source} WHERE n < 10
UNION ALL SELECT '{name}', 'the window is shorter than 48 hours: a daily cycle can look like a trend' FROM {source} WHERE s < 48 * 3600
UNION ALL SELECT '{name}', 'r_squared is below 0.3: a line fits poorly' FROM {source} WHERE r2 < 0.3"""


def _season_caveats(name: str) -> str:
    place, n, _, ms = _PLACES[name]
    return f"""SELECT '{name}', 'positions are in UTC' UNION ALL SELECT '{name}', printf('the window holds %.1f periods: it takes two to show a repetition',
span / {ms}.0) FROM N WHERE span / {ms}.0 < 2
UNION ALL SELECT '{name}', printf('%d positions are empty', k) FROM (SELECT {n} - count(DISTINCT {place.replace("ts_ms", "t")}) AS k FROM E) WHERE k > 0"""


query(
    "caveats",
    _caveats,
    f"""WITH {_EAGER}, D AS (SELECT floor(quantile_cont((t - p)::DOUBLE, 0.5)) AS m FROM (SELECT t, lag(t) OVER (ORDER BY t) AS p FROM E) WHERE p IS NOT NULL)
{_trend_caveats("fit_trend", "")} UNION ALL {_trend_caveats("one_row", f"WHERE t <= {SPLIT_MS}")} UNION ALL {_season_caveats("hour_of_day")} UNION ALL {_season_caveats("day_of_week")}
UNION ALL SELECT 'data_quality', 'fewer than 3 points: intervals say little' FROM N WHERE n < 3 UNION ALL SELECT 'distribution', 'every value is the same: the histogram has one bin' FROM E HAVING min(v) = max(v)
UNION ALL SELECT 'value_at', 'the instant is outside the series: nothing is interpolated' UNION ALL SELECT 'value_at', printf('the nearest reading is %.0f s away; the median interval is %.0f s', lo / 1000.0, m / 1000.0) FROM N, D WHERE m > 0 AND lo > m
UNION ALL SELECT 'compare_to_baseline', printf('the baseline has %d rows only: what is typical is uncertain', n) FROM (SELECT count(*) AS n FROM E WHERE t < {SPLIT_MS}) WHERE n < 30
UNION ALL SELECT 'compare_to_baseline', printf('the subject has %d rows only', n) FROM (SELECT count(*) AS n FROM E WHERE t >= {SPLIT_MS}) WHERE n < 4""",
)


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each bad call raises."""
    e, i = _eager(spark, sf_dir), "events/value"
    calls = {
        "unknown dataset": lambda: e.summary_stats("nothing"), "no rows": lambda: e.summary_stats(i, start="2090-01-01T00:00:00Z"),
            "window turned round": lambda: e.summary_stats(i, "2024-02-01T00:00:00Z", "2024-01-01T00:00:00Z"), "bad stamp": lambda: e.summary_stats(i, "yesterday"),
        "negative limit": lambda: e.detect_outliers(i, limit=-1), "negative multiplier": lambda: e.detect_outliers(i, iqr_multiplier=-1),
            "many bins": lambda: e.distribution(i, bins=41), "unknown condition": lambda: e.find_events(i, "near", threshold=1),
            "no threshold": lambda: e.find_events(i, "above"),
        "bounds turned round": lambda: e.find_events(i, "between", lower=3, upper=1), "unknown period": lambda: e.seasonal_profile(i, "month"),
            "bad duration": lambda: e.profile(i, bucket="soon"), "narrow bucket": lambda: e.profile(i, bucket="1s"), "short bucket": lambda: e.resample(i, "1ms"),
        "unknown aggregate": lambda: e.resample(i, "24h", "mode"), "no instant": lambda: e.value_at(i, ""),
            "far instant": lambda: e.value_at(i, "1970-01-01T00:00:00Z", "1h"), "unknown format": lambda: e.dataset_graph("dot"), "a good call": lambda: e.greet("Ada"),
    }
    told = []
    for name, call in calls.items():
        try:
            call()
            told.append((name, "none"))
        except (KeyError, ValueError) as x:
            told.append((name, type(x).__name__))
    return spark.createDataFrame(told, "call string, raised string")


_BAD = ("no rows", "window turned round", "bad stamp", "negative limit", "negative multiplier", "many bins", "unknown condition", "no threshold",
    "bounds turned round", "unknown period", "bad duration", "narrow bucket", "short bucket", "unknown aggregate", "no instant", "far instant", "unknown format")
query("errors", _errors, "SELECT * FROM (VALUES ('unknown dataset', 'KeyError'), ('a good call', 'none'), " + ", ".join(f"('{x}', 'ValueError')" for x in _BAD) + ") t(call, raised)")


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges and extremes as the eager interface prints them, and its rounded shares."""
    e, i = _eager(spark, sf_dir), "events/value"
    s, o, f = e.summary_stats(i), e.detect_outliers(i, iqr_multiplier=0.5), e.find_events(i, "above", threshold=80)
    return spark.createDataFrame([(s["analyzed_range"]["start"], s["analyzed_range"]["end"], o["total_outliers"], o["percent"], len(o["outliers"]),
        f["points_matching"], f["pct_points"])], "first string, last string, outliers long, percent double, listed long, points long, pct_points double")


_STAMP = "rtrim(rtrim(strftime(make_timestamp({x} * 1000), '%Y-%m-%dT%H:%M:%S.%g'), '0'), '.') || 'Z'"
query(
    "rendering",
    _rendered,
    f"""WITH {_EAGER}, Q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM E), O AS (SELECT count(*) AS k FROM E, Q
WHERE v < a - 0.5 * (b - a) OR v > b + 0.5 * (b - a)), P AS (SELECT count(*) AS k FROM E WHERE v > 80)
SELECT {_STAMP.format(x="lo")} AS first, {_STAMP.format(x="hi")} AS last, O.k AS outliers, round(100.0::DOUBLE * O.k / n, 2) AS percent, least(O.k,
20) AS listed, P.k AS points, round(100.0::DOUBLE * P.k / n, 2) AS pct_points FROM N, O, P""",
)


def _durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    def parsed(text: str) -> int | None:
        try:
            return duration_ms(text)
        except ValueError:
            return None

    return spark.createDataFrame([(x, parsed(x)) for x in ("1h", "15m", "30s", "1h30m", "1.5s", "250ms", "0s", "-5m", "500us", "5", "")], "text string, ms long")


query("durations", _durations, "SELECT text, ms::BIGINT AS ms FROM (VALUES ('1h', 3600000), ('15m', 900000), ('30s', 30000), ('1h30m', 5400000), ('1.5s', 1500), ('250ms', 250), ('0s', NULL), ('-5m', NULL), ('500us', NULL), ('5', NULL), ('', NULL)) t(text, ms)")
query(
    "data_quality_flatlines_top",
    lambda s, d: rows.flatlines(_coarse(s, d), 2, 10),
    f"""WITH {ORDERS.replace("o_totalprice AS value", "floor(o_totalprice / 250000) AS value")}, {LAGGED}, C AS (SELECT *,
sum(CASE WHEN pv IS NULL OR pv <> value THEN 1 ELSE 0 END) OVER (PARTITION BY dataset_id ORDER BY ts_ms, seq ROWS UNBOUNDED PRECEDING) AS run FROM L),
X AS (SELECT dataset_id, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, {r("min(value)")} AS value, count(*) AS count FROM C GROUP BY dataset_id, run HAVING count(*) >= 2)
SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY count DESC, start_ms)::INT AS place FROM X QUALIFY place <= 10""",
)
query(
    "compare_to_baseline_episodes_top",
    lambda s, d: islands.episodes(*_subject(s, d), 0.2, 10),
    "WITH Y AS (" + SQL["compare_to_baseline_episodes"].replace("q1 - 0.5 * (q3 - q1)", "q1 - 0.2 * (q3 - q1)").replace("q3 + 0.5 * (q3 - q1)",
        "q3 + 0.2 * (q3 - q1)") + ") SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY peak_deviation DESC, start_ms)::INT AS place FROM Y QUALIFY place <= 10",
)
