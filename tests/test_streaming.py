"""Rollups of a stream of files against the same readings in one batch."""

from pyspark.sql import functions as F

from tidewright.sources import series as S
from tidewright.streaming.rollup import rollup, threshold_alerts


def run(stream, name):
    q = stream.writeStream.outputMode("complete" if name == "rollup" else "append").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_rollup_of_a_stream(spark, small, tmp_path):
    rows = S.events(spark, small).select("dataset_id", F.timestamp_millis("ts_ms").alias("timestamp"), "value")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(rollup(stream, "1 day", "60 days"), "rollup")
    day = (F.floor(F.unix_millis("timestamp") / 86_400_000) * 86_400_000).alias("start_ms")
    want = rows.groupBy("dataset_id", day).agg(F.count(F.lit(1)).alias("count"), F.max("value").alias("max_value"))
    assert sorted(map(tuple, got.select("dataset_id", "start_ms", "count", "max_value").collect())) == sorted(map(tuple, want.collect()))


def test_alerts_of_a_batch(spark):
    rows = spark.createDataFrame([("s", t, v) for t, v in ((0, 20.0), (60, 30.0), (3600, 25.0), (3660, 5.0))], "dataset_id string, t long, value double").select("dataset_id", F.timestamp_seconds("t").alias("timestamp"), "value")
    got = threshold_alerts(rows, 10, "1 hour", "10 minutes").orderBy("start_ms").collect()
    assert [(r.start_ms, r.end_ms, r.points, r.peak_value) for r in got] == [(0, 60_000, 2, 30), (3_600_000, 3_600_000, 1, 25)]
