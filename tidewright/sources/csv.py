"""Wide CSV files as series: one channel per numeric column.

All cells are read as text; the time column and the value columns are found by the first row only,
and cells are parsed by the rules below, which are stricter than Spark's casts.
Blank or missing cells are skipped channel by channel, rows without a time are
skipped, anything else that doesn't parse is an error that names the row.  Non-finite numbers are errors too: later
aggregates have no meaning for them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words that make a column's name look like a time.
TIME_WORDS = ("ts", "time", "timestamp", "datetime", "date", "epoch")
# The layouts that are tried in this order.
LAYOUTS = (
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy",
    "M/d/yyyy HH:mm:ss",
    "M/d/yyyy",
)
# An epoch counts seconds from EPOCH_FROM up to EPOCH_TO, or thousandths, millionths or billionths of them.
EPOCH_FROM, EPOCH_TO = 3.0e7, 4.2e9
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_FRACTION = re.compile("ss")


#: What a failed job says of a cell; ``Parsed.check`` finds the row.
UNREADABLE = "unreadable cell"


@dataclass
class Parsed:
    """``rows`` (column, ts_ms, value, seq) fail on a cell that can't be read; ``check`` says which one it is."""

    timestamp_column: str
    value_columns: list[str]
    rows: DataFrame
    check: Callable[[], None]


def time_like(name: str) -> bool:
    return any(part in TIME_WORDS for part in (name.lower(), *name.lower().split("_")))


def number(cell: Column) -> Column:
    return F.when(cell.rlike(NUMBER), cell.try_cast("double"))


def epoch_ms(v: Column) -> Column:
    """By size alone: seconds, milliseconds, microseconds or nanoseconds; null in between."""
    unit = lambda scale, made: F.when((v >= EPOCH_FROM * scale) & (v < EPOCH_TO * scale), made.cast("long"))
    return F.coalesce(unit(1.0, v * 1e3), unit(1e3, v), unit(1e6, v / 1e3), unit(1e9, v / 1e6))


def stamp_ms(cell: Column) -> Column:
    """Layouts first, then epochs; null for anything else.  A fraction may follow the seconds."""
    shapes = {"-": r"^\d{4}-\d\d-\d\d", "/": r"^\d{1,2}/\d{1,2}/\d{4}"}
    tried = []
    for layout in LAYOUTS:
        fraction = _FRACTION.sub("ss[.SSSSSSSSS][.SSSSSS][.SSS][.SS][.S]", layout)
        # Spark fails on no input here, and is asked only for what has the layout's shape
        tried.append(F.when(cell.rlike(shapes["-" if "-" in layout else "/"]), F.unix_millis(F.try_to_timestamp(cell, F.lit(fraction)))))
    return F.coalesce(*tried, epoch_ms(number(cell)))


def read(spark: SparkSession, path: str, timestamp_col: str | None = None, value_cols: list[str] | None = None, multi_line: bool = True, validate: bool = True) -> Parsed:
    """``multi_line`` allows line breaks in quotes, at the price that a file is one task; without it large files are split.

    ``validate`` looks at all cells now; without it the job that reads the rows does.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, escape='"', mode="PERMISSIVE")
    header = raw.columns
    first = raw.first()
    if first is None:
        raise ValueError(f"{path} has no data rows")
    probe = spark.createDataFrame([tuple("" if x is None else x for x in first)], [f"c{i}" for i in range(len(header))])
    tests = probe.select(*[F.struct(stamp_ms(F.col(f"c{i}")).isNotNull().alias("t"), number(F.col(f"c{i}")).isNotNull().alias("v")).alias(f"c{i}") for i in range(len(header))]).first()

    def find(name: str) -> int:
        if name not in header:
            raise ValueError(f"no column {name!r}; the header has {header}")
        return header.index(name)

    if timestamp_col:
        at = find(timestamp_col)
    else:
        order = [i for i, h in enumerate(header) if time_like(h)] + [i for i, h in enumerate(header) if not time_like(h)]
        at = next((i for i in order if tests[i]["t"]), None)
        if at is None:
            raise ValueError(f"no time column among {header}")
    values = [find(v) for v in value_cols] if value_cols else [i for i in range(len(header)) if i != at and tests[i]["v"]]
    if not values:
        raise ValueError(f"no numeric column among {header}")
    # the scan keeps the order of the file, so the row number is the stored order
    cells_before = raw.toDF(*[f"c{i}" for i in range(len(header))]).withColumn("seq", F.monotonically_increasing_id())
    cells = cells_before.where(F.coalesce(F.col(f"c{at}"), F.lit("")) != "").withColumn("ts_ms", stamp_ms(F.col(f"c{at}")))
    pairs = F.explode(F.array(*[F.struct(F.lit(header[i]).alias("column"), F.col(f"c{i}").alias("cell")) for i in values]))
    long = cells.select("seq", F.col(f"c{at}").alias("stamp"), "ts_ms", pairs.alias("x")).select("seq", "stamp", "ts_ms", "x.column",
        "x.cell").where("cell IS NOT NULL AND cell <> ''").withColumn("value", number(F.col("cell")))

    def row_of(seq: int) -> int:
        """The number of a row, with the header as the first; only asked for when something is wrong."""
        part = seq >> 33
        ahead = cells_before.where(F.shiftright("seq", 33) < part).count() if part else 0
        return ahead + (seq & ((1 << 33) - 1)) + 2

    def check() -> None:
        bad = cells.where("ts_ms IS NULL").select("seq", F.col(f"c{at}").alias("cell")).first()
        if bad:
            raise ValueError(f"can't read the time {bad.cell!r} in column {header[at]!r} (row {row_of(bad.seq)})")
        bad = long.where("value IS NULL").select("seq", "column", "cell").first()
        if bad:
            raise ValueError(f"can't read the number {bad.cell!r} in column {bad['column']!r} (row {row_of(bad.seq)})")

    if validate:
        check()
    wrong = F.raise_error(F.lit(UNREADABLE))
    rows = long.select("column", F.coalesce("ts_ms", wrong.cast("long")).alias("ts_ms"), F.coalesce("value", wrong.cast("double")).alias("value"), "seq")
    return Parsed(header[at], [header[i] for i in values], rows, check)
