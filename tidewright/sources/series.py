"""The series table: ``dataset_id, ts_ms, value, seq``.

``ts_ms`` is UTC epoch milliseconds; ``seq`` is the stored order and settles ties in time.  A
window of time is a filter on the stored time stamp, so that it reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("dataset_id", "ts_ms", "value", "seq")


def millis(stamp: Column) -> Column:
    return F.unix_millis(stamp.cast("timestamp"))


def within(table: DataFrame, stamp: str, start_ms: int | None, end_ms: int | None) -> DataFrame:
    """Rows of [start, end], either side open, as a predicate on the stored column.

    The stored time may be finer than a millisecond; it counts with its millisecond.
    """
    kind = table.schema[stamp].dataType.simpleString()
    literal = lambda ms: F.timestamp_millis(F.lit(ms)).cast(kind)
    if start_ms is not None:
        table = table.where(F.col(stamp) >= literal(start_ms))
    if end_ms is not None:
        table = table.where(F.col(stamp) < literal(end_ms + 1))
    return table


def window(series: DataFrame, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """The same for a table that is a series already."""
    if start_ms is not None:
        series = series.where(F.col("ts_ms") >= start_ms)
    if end_ms is not None:
        series = series.where(F.col("ts_ms") <= end_ms)
    return series


def read(spark: SparkSession, path: str, stamp: str, value: str, seq: str, group: str, prefix: str, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    table = within(spark.read.parquet(path), stamp, start_ms, end_ms)
    return table.select(F.concat(F.lit(prefix), F.col(group)).alias("dataset_id"), millis(F.col(stamp)).alias("ts_ms"),
        F.col(value).cast("double").alias("value"), F.col(seq).cast("long").alias("seq"))


def events(spark: SparkSession, sf_dir: str, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """One series per event type."""
    return read(spark, f"{sf_dir}/events.parquet", "ts", "value", "event_id", "event_type", "events/", start_ms, end_ms)


def orders(spark: SparkSession, sf_dir: str, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """One series per order priority: days as time stamps, hence many ties."""
    return read(spark, f"{sf_dir}/orders.parquet", "o_orderdate", "o_totalprice", "o_orderkey", "o_orderpriority", "orders/", start_ms, end_ms)


def lineitem(spark: SparkSession, sf_dir: str, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """One series per return flag; price in cents breaks the ties that order and line number leave."""
    table = within(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_shipdate", start_ms, end_ms)
    seq = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100_000_000 + F.round(F.col("l_extendedprice") * 100).cast("long")
    return table.select(F.concat(F.lit("lineitem/"), "l_returnflag").alias("dataset_id"), millis(F.col("l_shipdate")).alias("ts_ms"), F.col("l_extendedprice").alias("value"), seq.alias("seq"))
