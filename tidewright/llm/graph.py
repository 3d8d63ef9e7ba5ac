"""Connected components by DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import cut

FEW = 10_000  # edges that one task joins


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """``v, c`` for every vertex of ``edges (a, b)``: c is the smallest vertex that v reaches.

    Up to ``few`` edges are joined in one task.  Beyond, each round takes the smallest label among the neighbours, for a vertex and
    for what it is labelled by (else a label would have to walk to it edge by edge), and then the label's own label, so that
    paths halve; rounds go on until nothing changes.  Only numbers of edges and changes come to the driver.  No edges give no rows.
    """
    once = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    if once.limit(few + 1).count() <= few:
        return once.coalesce(1).mapInArrow(_joined, "v long, c long")
    both = once.union(once.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("low")).select("v", F.least("v", "low").alias("c")))
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "c"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("n"))
        met = labels.join(near, "v").select("v", F.col("c").alias("was"), F.least("c", "n").alias("m"))
        told = met.union(met.select(F.col("was").alias("v"), F.lit(None).cast("long").alias("was"), "m"))
        met = told.groupBy("v").agg(F.max("was").alias("was"), F.min("m").alias("m"))
        jump = labels.select(F.col("v").alias("m"), F.col("c").alias("j"))
        fresh = cut(met.join(jump, "m").select("v", "was", F.least("m", "j").alias("c")), free=False)
        changed = fresh.where("c <> was").limit(1).count()
        labels = fresh.select("v", "c")
        if not changed:
            return labels


def _joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [(np.asarray(p["a"]), np.asarray(p["b"])) for p in parts if p.num_rows]
    if not found:
        return
    a, b = (np.concatenate([x[i] for x in found]) for i in (0, 1))
    vertex, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(vertex)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist(), strict=True):
        i, j = root(i), root(j)
        parent[max(i, j)] = min(i, j)
    least = vertex[[root(i) for i in range(len(vertex))]]
    yield pa.RecordBatch.from_arrays([pa.array(vertex, pa.int64()), pa.array(least, pa.int64())], names=["v", "c"])
