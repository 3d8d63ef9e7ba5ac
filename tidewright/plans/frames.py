"""Plan building blocks: predecessors, running counts and exact quantiles of any size.

Each has two forms with one result.  For inputs below ``SMALL`` bytes (by the optimiser's estimate, no job is
run) the plain form: one window per series, Spark's ``percentile``.  Above it a form in which
no task holds a whole series: windows run per (series, stretch of time) and take what
crosses a border from a table with one row per stretch; quantiles are bracketed by a sketch whose
rank error is guaranteed, and only the values inside the bracket are counted exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL = 256 << 20
STRETCH_MS = 86_400_000
ACCURACY = 10_000
MARGIN = 4 / ACCURACY  # the sketch is off by 1 / ACCURACY at most; from ACCURACY values on three ranks are to spare
ID = "dataset_id"
STRETCH = "__stretch"


def small(df: DataFrame) -> bool:
    """Whether the optimiser expects less than ``SMALL`` bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL


def stretched(df: DataFrame) -> DataFrame:
    """Adds the stretch of time that a row is in."""
    return df.withColumn(STRETCH, F.floor(F.col("ts_ms") / F.lit(STRETCH_MS)))


def previous(df: DataFrame, columns: Sequence[str] = ("ts_ms", "value"), whole: bool | None = None) -> DataFrame:
    """Adds ``prev``: a struct of these columns of the row before, by (ts_ms, seq); null for the first."""
    held = F.struct(*columns)
    if small(df) if whole is None else whole:
        return df.withColumn("prev", F.lag(held).over(Window.partitionBy(ID).orderBy("ts_ms", "seq")))
    cut = stretched(df)
    last = cut.groupBy(ID, STRETCH).agg(F.max_by(held, F.struct("ts_ms", "seq")).alias("__last"))
    last = last.withColumn("__carried", F.lag("__last").over(Window.partitionBy(ID).orderBy(STRETCH))).drop("__last")
    own = F.lag(held).over(Window.partitionBy(ID, STRETCH).orderBy("ts_ms", "seq"))
    return cut.join(last, [ID, STRETCH]).withColumn("prev", F.coalesce(own, "__carried")).drop(STRETCH, "__carried")


def running(df: DataFrame, flag: Column, name: str, whole: bool | None = None) -> DataFrame:
    """Adds the number of rows up to this one, by (ts_ms, seq), for which the flag holds."""
    one = F.when(flag, 1).otherwise(0).cast("long")
    frame = (Window.unboundedPreceding, Window.currentRow)
    if small(df) if whole is None else whole:
        return df.withColumn(name, F.sum(one).over(Window.partitionBy(ID).orderBy("ts_ms", "seq").rowsBetween(*frame)))
    cut = stretched(df.withColumn("__one", one))
    sums = cut.groupBy(ID, STRETCH).agg(F.sum("__one").alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(ID).orderBy(STRETCH).rowsBetween(*frame)) - F.col("__sum")
    sums = sums.select(ID, STRETCH, before.alias("__before"))
    own = F.sum("__one").over(Window.partitionBy(ID, STRETCH).orderBy("ts_ms", "seq").rowsBetween(*frame))
    return cut.join(sums, [ID, STRETCH]).withColumn(name, F.col("__before") + own).drop(STRETCH, "__one", "__before")


def quantiles(df: DataFrame, column: str, at: Sequence[float], aggregates: Sequence[Column] = (), name: str = "q", whole: bool | None = None) -> DataFrame:
    """One row per series: ``name``, an array of exact quantiles (linear between neighbours), and the aggregates.

    Nulls don't count.  A series without values has no array.
    """
    array = F.array(*[F.lit(float(x)) for x in at])
    if small(df) if whole is None else whole:
        return df.groupBy(ID).agg(F.percentile(column, array).alias(name), *aggregates)
    rough = F.array(*[F.lit(max(0.0, x - MARGIN)) for x in at], *[F.lit(min(1.0, x + MARGIN)) for x in at])
    sides = df.groupBy(ID).agg(F.percentile_approx(column, rough, ACCURACY).alias("__sides"), F.count(column).alias("__n"), F.min(column).alias("__lo"), F.max(column).alias("__hi"), *aggregates)
    parts = []
    for i, x in enumerate(at):
        few = F.col("__n") < ACCURACY
        lower = F.when(F.lit(x <= MARGIN) | few, F.col("__lo")).otherwise(F.col("__sides")[i])
        upper = F.when(F.lit(x >= 1 - MARGIN) | few, F.col("__hi")).otherwise(F.col("__sides")[i + len(at)])
        parts.append(F.struct(F.lit(i).alias("i"), lower.alias("lo"), upper.alias("hi"), (F.lit(x) * (F.col("__n") - 1)).alias("place")))
    wanted = sides.select(F.col(ID).alias("__id"), F.explode(F.array(*parts)).alias("w")).select("__id", "w.*")
    values = df.where(F.col(column).isNotNull()).groupBy(ID, column).agg(F.count(F.lit(1)).alias("c"))
    met = values.join(wanted, (F.col(ID) == F.col("__id")) & (F.col(column) <= F.col("hi")))
    inside = F.col(column) >= F.col("lo")
    below = met.where(~inside).groupBy(ID, "i").agg(F.sum("c").alias("below"))
    # a bracket holds about 8 / ACCURACY of a series (a short series is its own bracket)
    counts = met.where(inside).join(below.withColumnsRenamed({ID: "__b", "i": "__bi"}), (F.col(ID) == F.col("__b")) & (F.col("i") == F.col("__bi")), "left")
    through = F.sum("c").over(Window.partitionBy(ID, "i").orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.coalesce("below", F.lit(0))
    counts = counts.withColumn("through", through)
    pick = lambda k: F.min(F.when(F.col("through") > k, F.col(column)))
    low, high = F.floor("place"), F.ceil("place")
    found = counts.groupBy(ID, "i", "place").agg(pick(low).alias("a"), pick(high).alias("b"))
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - low)
    arrays = found.groupBy(ID).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))), lambda s: s["v"]).alias(name))
    return sides.drop("__sides", "__n", "__lo", "__hi").join(arrays, ID, "left")


RANK_PARTS = 200


def average_ranks(df: DataFrame, column: str, name: str, whole: bool | None = None) -> DataFrame:
    """Adds the rank of a row's value from 1, ties sharing their average rank.  No task sorts all values of a large input."""
    values = df.groupBy(F.col(column).alias("__value")).agg(F.count(F.lit(1)).alias("__c"))
    frame = (Window.unboundedPreceding, Window.currentRow)
    if small(df) if whole is None else whole:
        through = values.withColumn("__through", F.sum("__c").over(Window.orderBy("__value").rowsBetween(*frame)))
    else:
        at = F.array(*[F.lit(i / RANK_PARTS) for i in range(1, RANK_PARTS)])
        found = df.agg(F.percentile_approx(column, at, ACCURACY)).first()[0] or []
        cuts = F.array(*[F.lit(float(x)) for x in sorted(set(found))]) if found else F.array().cast("array<double>")
        parted = values.withColumn("__part", F.size(F.filter(cuts, lambda x: x <= F.col("__value"))))
        sums = parted.groupBy(F.col("__part").alias("__of")).agg(F.sum("__c").alias("__sum"))
        ahead = sums.withColumn("__ahead", F.sum("__sum").over(Window.orderBy("__of").rowsBetween(*frame)) - F.col("__sum")).drop("__sum")
        own = F.sum("__c").over(Window.partitionBy("__part").orderBy("__value").rowsBetween(*frame))
        through = parted.join(ahead, F.col("__part") == F.col("__of")).withColumn("__through", F.col("__ahead") + own).drop("__part", "__of", "__ahead")
    ranked = through.select("__value", (F.col("__through") - (F.col("__c") - 1) / 2).alias(name))
    return df.join(ranked, F.col(column) == F.col("__value")).drop("__value")
