"""The store: immutable series as Parquet, a JSON catalog, and the lineage between them.

Writers take turns at the catalog by a lock file.  A series is a folder ``<id>.parquet`` with ``timestamp`` (milliseconds, UTC), ``value`` and ``seq``.  The catalog's
rename is the commit: what was written before a failure is removed again.  The catalog is small (a record per
series) and is read on every call, like any catalog.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.times import stamp_text
from tidewright.operators import grids, rows, scalar
from tidewright.sources import csv
from tidewright.sources.files import Files

CATALOG = "catalog.json"
ENTRY = "id string, kind string, source_path string, source_column string, unit string, created_at string, timestamp_column string, row_count long, time_range struct<start:string,end:string>, parent_id string, origin string"


def slug(name: str) -> str:
    """Lower case; per segment only a-z, 0-9, - and _; empty segments go."""
    parts = [re.sub("[^a-z0-9_-]", "_", p.lower()).strip("_") for p in name.split("/")]
    return "/".join(p for p in parts if p) or "dataset"


def _numbered(base: str, taken) -> str:
    name, n = base, 2
    while taken(name):
        name, n = f"{base}-{n}", n + 1
    return name


def default_root() -> str:
    """Where the store lies if nothing else is said."""
    return os.environ.get("TIDEWRIGHT_STORE") or os.path.join(os.path.expanduser("~"), ".tidewright", "store")


class Store:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.files = spark, Files(spark, root or default_root())
        self.files.make()

    # --- catalog

    def catalog(self) -> dict[str, dict]:
        return json.loads(self.files.read(CATALOG)) if self.files.exists(CATALOG) else {}

    def entries(self) -> DataFrame:
        held = self.catalog()
        return self.spark.createDataFrame([{**{"unit": None, "origin": None}, **held[k]} for k in sorted(held)], ENTRY)

    def entry(self, dataset_id: str) -> dict:
        held = self.catalog()
        if dataset_id not in held:
            raise KeyError(f"unknown dataset {dataset_id!r}; known: {', '.join(sorted(held)) or 'none'}")
        return held[dataset_id]

    def children(self, dataset_id: str) -> list[dict]:
        held = self.catalog()
        return [held[k] for k in sorted(held) if held[k]["parent_id"] == dataset_id]

    def size(self, dataset_id: str) -> int:
        return self.files.size(f"{dataset_id}.parquet")

    # --- series

    def read(self, dataset_id: str, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
        """One series; the window is a predicate on the stored time stamp."""
        return self.read_many([dataset_id], start_ms, end_ms)

    def read_many(self, ids: list[str], start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
        """Several series in one table and one scan."""
        from tidewright.sources.series import within

        held = self.catalog()
        for i in ids:
            if i not in held:
                self.entry(i)
        paths = [self.files.uri(f"{i}.parquet") for i in ids]
        table = within(self.spark.read.schema("timestamp timestamp, value double, seq long").parquet(*paths), "timestamp", start_ms, end_ms)
        if len(ids) == 1:
            name = F.lit(ids[0])
        else:
            root = self.files.fs.makeQualified(self.files._path("")).toUri().getPath()
            name = F.regexp_extract(F.col("_metadata.file_path"), re.escape(root) + r"/(.*)\.parquet/[^/]*$", 1)
        return table.select(name.alias("dataset_id"), F.unix_millis("timestamp").alias("ts_ms"), "value", "seq")

    def _commit(self, made: list[dict], moved: list[tuple[str, str]]) -> None:
        done = []
        with self.files.lock(f"{CATALOG}.lock"):
            held = self.catalog()
            taken = [e["id"] for e in made if e["id"] in held]
            if taken:
                raise ValueError(f"another writer has taken {', '.join(taken)} meanwhile")
            try:
                for draft, name in moved:
                    self.files.move(draft, name)
                    done.append(name)
                held.update({e["id"]: e for e in made})
                self.files.replace(CATALOG, json.dumps(held, indent=2, sort_keys=True))
            except Exception:
                for name in done:
                    self.files.delete(name)
                raise

    def _entry(self, dataset_id: str, path: str, column: str, stamp: str, unit: str | None, count: int, lo: int, hi: int, parent: str = "", origin: str | None = None, fraction: bool = True) -> dict:
        made = {"id": dataset_id, "kind": "measurement", "source_path": path, "source_column": column,
            "created_at": stamp_text(int(datetime.now(timezone.utc).timestamp() * 1000), False), "timestamp_column": stamp, "row_count": count,
            "time_range": {"start": stamp_text(lo, fraction), "end": stamp_text(hi, fraction)}, "parent_id": parent}
        return made | ({"unit": unit} if unit else {}) | ({"origin": origin} if origin else {})

    def ingest_csv(self, path: str, name: str | None = None, timestamp_col: str | None = None, value_cols: list[str] | None = None,
        units: dict[str, str] | None = None, multi_line: bool = True) -> list[dict]:
        """One dataset per channel, all written in one job, committed together; returns the entries in order of the columns."""
        parsed = csv.read(self.spark, path, timestamp_col, value_cols, multi_line, validate=False)
        base = slug(name or re.sub(r"\.[^.]*$", "", path.rstrip("/").rsplit("/", 1)[-1]))
        held = self.catalog()
        group = _numbered(base, lambda g: any(i.startswith(f"{g}/") for i in held))
        ids = {c: f"{group}/{slug(c)}" for c in parsed.value_columns}
        if len(set(ids.values())) < len(ids):
            raise ValueError(f"two columns of {parsed.value_columns} have one id")
        draft = f".draft-{uuid.uuid4().hex}"
        numbers = {c: i for i, c in enumerate(parsed.value_columns)}
        channel = F.element_at(F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair]), F.col("column"))
        stored = parsed.rows.select(channel.alias("channel"), F.timestamp_millis("ts_ms").alias("timestamp"), "value", "seq")
        try:
            try:
                stored.write.partitionBy("channel").parquet(self.files.uri(draft))
            except Exception as e:
                if csv.UNREADABLE in str(e):
                    parsed.check()  # names the row
                raise
            told = {r.channel: r for r in self.spark.read.parquet(self.files.uri(draft)).groupBy("channel").agg(F.count(F.lit(1)).alias("n"),
                F.min(F.unix_millis("timestamp")).alias("lo"), F.max(F.unix_millis("timestamp")).alias("hi")).collect()}
            made, moved = [], []
            for c, i in numbers.items():
                if i not in told:
                    raise ValueError(f"column {c!r} has no values")
                made.append(self._entry(ids[c], path, c, parsed.timestamp_column, (units or {}).get(c), told[i].n, told[i].lo, told[i].hi, fraction=False))
                moved.append((f"{draft}/channel={i}", f"{ids[c]}.parquet"))
            self._commit(made, moved)
        finally:
            self.files.delete(draft)
        return made

    def derive(self, parent: str, series: DataFrame, origin: str, name: str | None = None, keep: bool = False) -> dict:
        """Saves a child of a dataset; ``keep`` takes count and range from the parent."""
        source = self.entry(parent)
        dataset_id = _numbered(slug(name or parent), self.catalog().__contains__)
        draft = f".draft-{uuid.uuid4().hex}"
        try:
            series.select(F.timestamp_millis("ts_ms").alias("timestamp"), "value", "seq").write.parquet(self.files.uri(draft))
            if keep:
                made = {**source, "id": dataset_id, "parent_id": parent, "origin": origin}
            else:
                n, lo, hi = self.spark.read.parquet(self.files.uri(draft)).agg(F.count(F.lit(1)), F.min(F.unix_millis("timestamp")), F.max(F.unix_millis("timestamp"))).first()
                if not n:
                    raise ValueError(f"{origin} of {parent} leaves no rows")
                made = self._entry(dataset_id, source["source_path"], source["source_column"], source["timestamp_column"], source.get("unit"), n, lo, hi, parent, origin)
            self._commit([made], [(draft, f"{dataset_id}.parquet")])
        finally:
            self.files.delete(draft)
        return made

    def copy(self, dataset_id: str, name: str | None = None) -> dict:
        return self.derive(dataset_id, self.read(dataset_id), "copy", name, keep=True)

    def remove_outliers(self, dataset_id: str, multiplier: float = rows.IQR_MULTIPLIER, name: str | None = None, start_ms: int | None = None, end_ms: int | None = None) -> dict:
        return self.derive(dataset_id, rows.inliers(self.read(dataset_id, start_ms, end_ms), multiplier), "remove_outliers", name)

    def resample(self, dataset_id: str, width_ms: int, how: str = "mean", name: str | None = None, start_ms: int | None = None, end_ms: int | None = None) -> dict:
        series = self.read(dataset_id, start_ms, end_ms)
        middle = scalar.median_interval(series).first()
        if middle and width_ms < middle.interval_ms:
            raise ValueError(f"the bucket of {width_ms} ms is shorter than the median interval of {middle.interval_ms} ms")
        return self.derive(dataset_id, grids.resample(series, width_ms, how), "resample", name)

    # --- lineage

    def graph(self) -> dict:
        held = self.catalog()
        nodes = {k: {"parent_id": e["parent_id"], **({"origin": e["origin"]} if e.get("origin") else {}), "children": []} for k, e in sorted(held.items())}
        for k in nodes:
            if nodes[k]["parent_id"] in nodes:
                nodes[nodes[k]["parent_id"]]["children"].append(k)
        return {"roots": [k for k in nodes if not nodes[k]["parent_id"]], "nodes": nodes}

    def edges(self) -> DataFrame:
        """Parent and child of every edge whose parent exists."""
        e = self.entries()
        child = e.select(F.col("id").alias("child"), F.col("parent_id").alias("p"), "origin")
        return e.select(F.col("id").alias("parent")).join(child, F.col("parent") == F.col("p")).select("parent", "child", "origin")

    def mermaid(self) -> str:
        safe = lambda i: re.sub("[^A-Za-z0-9]", "_", i)
        held = sorted(self.catalog().items())
        lines = [f'  {safe(k)}["{k}"]' for k, _ in held] + [f"  {safe(e['parent_id'])} -->|{e.get('origin', '')}| {safe(k)}" for k, e in held if e["parent_id"]]
        return "\n".join(["graph TD", *lines])
