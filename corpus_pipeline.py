"""The corpus pipeline: from raw documents to packed training sequences.

quality       documents that the classifier rejects go
lines         aligned common blocks are cut out of the later document; documents left without text go
near_copies   one document of each component of linked documents stays, the one with the smallest id
benchmark     documents that hold a benchmark item go
packing       what is left is packed into sequences; one row per piece

Each stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``docs``.  Nulls, empty and repeated rows
are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from tidewright.llm.common import table, work_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.stage(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.stage(docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.representatives(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.public_pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_copies", near_copy_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

#: Fitting a classifier, alignment and tokens can't be said in SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages in turn, each written to the shared folder and read again.

    With a folder of one's own, a run that was broken off goes on after the last stage that is complete there; without
    one, each stage's rows go when the next stage is written, and the last ones when the driver ends.
    """
    docs = table(spark, sf_dir, "documents")
    base, held = folder or work_folder(spark, "pipeline"), []
    for name, stage in STAGES:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(path.suffix("/_SUCCESS")):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        for old in held if folder is None else []:
            store.delete(old, True)
        held = [path]
    return docs
