"""CSV files, the store, lineage and the eager interface, from file to answer."""

import json
from datetime import datetime, timedelta, timezone

import pytest

from tidewright.functions.times import duration_ms, stamp_ms, stamp_text
from tidewright.plans.api import Engine
from tidewright.sources import csv
from tidewright.sources.store import Store, slug


def write(path, header, lines):
    path.write_text("\n".join([header, *lines]) + "\n")
    return str(path)


def clock(i, step):
    return (datetime(2026, 7, 1, tzinfo=timezone.utc) + i * timedelta(seconds=step)).strftime("%Y-%m-%dT%H:%M:%SZ")


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "store"))


def test_durations_and_stamps():
    assert [duration_ms(x) for x in ("1h", "15m", "30s", "1h30m", "1.5s", "250ms")] == [3_600_000, 900_000, 30_000, 5_400_000, 1500, 250]
    for bad in ("", "nonsense", "0s", "-5m", "500us", "5"):
        with pytest.raises(ValueError):
            duration_ms(bad)
    assert [stamp_text(x) for x in (1500, 2000)] == ["1970-01-01T00:00:01.5Z", "1970-01-01T00:00:02Z"]
    assert stamp_ms("1970-01-01T01:00:01.25+01:00") == 1250 and stamp_ms("") is None
    with pytest.raises(ValueError):
        stamp_ms("1970-01-01")


def test_time_cells(spark):
    cells = ["1594512094", "1594512094.3859746", "1594512094385", "1594512094385974", "1594512094385974600", "0", "1000", "29999999", "5000000000", "-1594512094", "2020-07-12T00:01:34.5Z", "2020-07-12T02:01:34+02:00", "2020-07-12 00:01:34", "2020-07-12", "07/12/2020", "7/2/2020", "7/2/2020 01:02:03", "x"]
    got = [r.x for r in spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").orderBy("i").select(csv.stamp_ms(csv.F.col("c")).alias("x")).collect()]
    day = 1_594_512_000_000
    assert got == [1594512094000, *[1594512094385] * 4, *[None] * 5, day + 94_500, day + 94_000, day + 94_000, day, day, 1_593_648_000_000, 1_593_651_723_000, None]
    assert [csv.time_like(x) for x in ("ts", "Time", "event_time", "ts_utc", "temperature", "timestamps", "latest")] == [True] * 4 + [False] * 3


def test_slugs():
    assert [slug(x) for x in ("March Data", "IoT Rig/Temp C", "///", "", "km/h")] == ["march_data", "iot_rig/temp_c", "dataset", "dataset", "km/h"]


def test_csv(spark, tmp_path):
    p = csv.read(spark, write(tmp_path / "a.csv", "reading,ts,note", ["1594512094,1594512094,a", "1594512095,1594512095,b"]))
    assert (p.timestamp_column, p.value_columns) == ("ts", ["reading"])
    ragged = write(tmp_path / "b.csv", "ts,temp,hum", [f"{clock(0, 60)},1,", f"{clock(1, 60)},2,5", ",9,9"])
    p = csv.read(spark, ragged, value_cols=["temp", "hum"])
    assert sorted((r["column"], r.value) for r in p.rows.collect()) == [("hum", 5), ("temp", 1), ("temp", 2)]
    for text, word in ((["not-a-time,1"], "row 3"), ([f"{clock(1, 60)},1.5d"], "1.5d"), ([f"{clock(1, 60)}, 1.5"], " 1.5"), ([f"{clock(1, 60)},NaN"], "NaN")):
        with pytest.raises(ValueError, match=word):
            csv.read(spark, write(tmp_path / "c.csv", "ts,v", [f"{clock(0, 60)},1", *text]))
    for bad in ({"timestamp_col": "zzz"}, {"value_cols": ["zzz"]}):
        with pytest.raises(ValueError, match="zzz"):
            csv.read(spark, ragged, **bad)


def test_failed_commit_leaves_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    monkeypatch.setattr(type(store.files), "replace", lambda *a: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError, match="full"):
        store.ingest_csv(write(tmp_path / "r.csv", "ts,v", [f"{clock(0, 60)},1"]))
    assert store.files.listing() == []
    with pytest.raises(ValueError, match="one id"):
        store.ingest_csv(write(tmp_path / "s.csv", "ts,a b,a_b", [f"{clock(0, 60)},1,2"]))


def test_writers_take_turns(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    with store.files.lock("catalog.json.lock"), pytest.raises(TimeoutError), store.files.lock("catalog.json.lock", wait_s=0.2):
        pass
    with store.files.lock("catalog.json.lock"), store.files.lock("catalog.json.lock", stale_s=-1):
        pass
    path = write(tmp_path / "r.csv", "ts,v", [f"{clock(0, 60)},1"])
    store.ingest_csv(path)
    entry = store.entry("r/v")
    with pytest.raises(ValueError, match="taken"):
        store._commit([entry], [])
    assert store.files.listing() and not store.files.exists("catalog.json.lock")


def test_the_row_of_a_bad_cell_in_a_split_file(spark, tmp_path):
    lines = [f"{clock(i, 1)},{i}" for i in range(4000)]
    lines[3210] = f"{clock(3210, 1)},oops"
    path = write(tmp_path / "big.csv", "ts,v", lines)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        with pytest.raises(ValueError, match=r"'oops' .*\(row 3212\)"):
            csv.read(spark, path, multi_line=False)
        with pytest.raises(ValueError, match=r"row 3212"):
            Store(spark, str(tmp_path / "store")).ingest_csv(path, multi_line=False)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_default_place_of_the_store(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("TIDEWRIGHT_STORE", str(tmp_path / "from-env"))
    assert Engine(spark).server_info()["store_dir"] == str(tmp_path / "from-env")
    monkeypatch.delenv("TIDEWRIGHT_STORE")
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    assert Engine(spark).server_info()["store_dir"] == str(tmp_path / "home" / ".tidewright" / "store")


def test_outlier_story(engine, tmp_path):
    path = write(tmp_path / "readings.csv", "ts,temp", [f"{clock(i, 60)},{v}" for i, v in enumerate([20, 21, 20.5, 90, 21.5])])
    made = engine.ingest_csv(path, units={"temp": "C"})
    assert made["group"] == "readings" and made["datasets"][0]["dataset_id"] == "readings/temp" and made["datasets"][0]["row_count"] == 5
    found = engine.detect_outliers("readings/temp")
    assert (found["bounds"], found["total_outliers"], found["percent"]) == ({"lower": 19, "upper": 23}, 1, 20.0)
    child = engine.remove_outliers("readings/temp")
    assert (child["id"], child["row_count"], child["rows_removed"], child["parent"]["id"]) == ("readings/temp-2", 4, 1, "readings/temp")
    assert engine.summary_stats("readings/temp-2")["max"]["value"] == 21.5
    assert engine.copy_dataset("readings/temp", "Copy of it")["id"] == "copy_of_it"
    assert engine.dataset_graph()["mermaid"].splitlines()[0] == "graph TD" and "readings_temp -->|copy| copy_of_it" in engine.dataset_graph()["mermaid"]
    graph = engine.dataset_graph("json")["graph"]
    assert graph["roots"] == ["readings/temp"] and graph["nodes"]["readings/temp"]["children"] == ["copy_of_it", "readings/temp-2"]
    assert engine.store.edges().count() == 2
    assert [d["id"] for d in engine.list_datasets()["datasets"]] == ["copy_of_it", "readings/temp", "readings/temp-2"]
    assert engine.describe_dataset("readings/temp-2")["origin"] == "remove_outliers"
    assert engine.preview_dataset("readings/temp", 2)["rows"][1]["value"] == 21
    assert "catalog.json" in engine.server_info()["files"] and engine.greet("Ada") == {"greeting": "Hi Ada"}
    assert engine.ingest_csv(path)["group"] == "readings-2"
    with pytest.raises(KeyError, match="known"):
        engine.summary_stats("nothing")
    with pytest.raises(ValueError, match="no rows"):
        engine.summary_stats("readings/temp", start="2030-01-01T00:00:00Z")
    json.dumps([found, child, graph])


def test_drift_story(engine, tmp_path):
    temp = [25 - 0.01 * i + (100 if 60 <= i <= 64 else 0) for i in range(120)]
    engine.ingest_csv(write(tmp_path / "story.csv", "ts,temp,pressure", [f"{clock(i, 60)},{t},{50 + 2 * t}" for i, t in enumerate(temp)]))
    q = engine.data_quality("story/temp")
    assert (q["median_interval_seconds"], q["total_gaps"]) == (60, 0)
    b = engine.compare_to_baseline("story/temp", start="2026-07-01T01:00:00Z", end="2026-07-01T01:04:00Z")
    assert (b["total_episodes"], b["episodes"][0]["point_count"], b["episodes"][0]["direction"]) == (1, 5, "above")
    assert engine.remove_outliers("story/temp")["rows_removed"] == 5
    assert engine.fit_trend("story/temp-2")["direction"] == "decreasing"
    assert engine.resample("story/temp-2", "10m")["id"] == "story/temp-2-2"
    assert engine.fit_trend("story/temp-2-2")["direction"] == "decreasing"
    assert engine.correlate("story/temp", "story/pressure")["spearman"] == 1
    assert engine.compare_datasets("story/temp", "story/pressure")["mean_difference"] > 0
    with pytest.raises(ValueError, match="shorter"):
        engine.resample("story/temp", "30s")


def test_sawtooth_story(engine, tmp_path):
    engine.ingest_csv(write(tmp_path / "hvac.csv", "ts,temp,power", [f"{clock(i, 3600)},{i % 24},{(i - 2) % 24}" for i in range(72)]))
    o = engine.overview("hvac/")
    assert o["dataset_count"] == 2 and {c["id"]: c["last_value"] for c in o["channels"]}["hvac/temp"] == 23
    e = engine.find_events("hvac/temp", "above", threshold=20)
    assert (e["total_events"], e["points_matching"], e["time_in_events_seconds"]) == (3, 9, 21_600)
    assert engine.seasonal_profile("hvac/temp", "hour_of_day")["cycle_strength"] == 1
    assert engine.distribution("hvac/temp")["percentiles"]["p50"] == 11.5
    i = engine.integrate("hvac/power", start="2026-07-01T02:00:00Z", end="2026-07-02T01:00:00Z")
    assert i["integral_value_hours"] == pytest.approx(264.5) and i["time_weighted_mean"] == pytest.approx(11.5)
    v = engine.value_at("hvac/temp", "2026-07-01T00:30:00Z")
    assert (v["interpolated"], v["offset_seconds"]) == (0.5, -1800)
    with pytest.raises(ValueError, match="away"):
        engine.value_at("hvac/temp", "2026-07-01T00:30:00Z", max_distance="5m")
    lag = engine.find_lag("hvac/temp", "hvac/power", bucket="1h")
    assert (lag["best_lag_seconds"], lag["pearson_at_best_lag"]) == (7200, 1)
    assert engine.profile("hvac/temp", bucket="3h")["bucket_count"] == 24
    assert engine.rate_of_change("hvac/temp")["unit"] == "per second"
