"""What the plans must look like: pruned scans, pushed windows, few exchanges, no Python."""

import pytest

from tidewright import queries as Q
from tidewright.operators import rows, scalar
from tidewright.sources import series as S
from tidewright.sources.store import Store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_reach_the_scan(spark, small, tmp_path):
    found = plan(scalar.summary_stats(S.events(spark, small, Q.SPLIT_MS, Q.LATE_MS)))
    assert "GreaterThanOrEqual(ts," in found and "LessThan(ts," in found
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in found
    path = tmp_path / "a.csv"
    path.write_text("ts,v\n2026-07-01T00:00:00Z,1\n2026-07-02T00:00:00Z,2\n")
    store = Store(spark, str(tmp_path / "store"))
    store.ingest_csv(str(path))
    assert "GreaterThanOrEqual(timestamp," in plan(store.read("a/v", 1_782_864_000_001))


def test_a_summary_costs_one_exchange(spark, small):
    assert plan(scalar.summary_stats(S.events(spark, small))).count("Exchange") == 1


def test_top_rows_are_cut_before_the_exchange(spark, small):
    assert "WindowGroupLimit" in plan(rows.preview(S.events(spark, small), 5))


@pytest.mark.parametrize("name", ["find_events_above", "fit_trend", "find_lag_scan", "data_quality_flatlines", "sparkline", "value_at", "profile"])
def test_operators_stay_in_the_engine(spark, small, name):
    found = plan(Q.QUERIES[name](spark, small))
    assert not any(x in found for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
