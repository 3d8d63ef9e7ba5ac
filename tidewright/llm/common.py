"""What the operators share: table access, durable lineage cuts, sizing."""

from __future__ import annotations

import ctypes
import functools
import gc
import inspect
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WHITE_RE = "[\\x20\\x09-\\x0D]+"
#: Word shingles of near-duplicate operators, and the similarity that links.
SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees; where none is configured, a temporary one in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _context_dir(spark)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidewright-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(made)
    store.deleteOnExit(made)
    return path


def _context_dir(spark: SparkSession) -> str | None:
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get() if held.isDefined() else None


def cut(df: DataFrame, free: bool = True) -> DataFrame:
    """Cuts the lineage with a checkpoint in the shared folder, and lets go of shuffles, plans and code that nothing needs any more.

    Freeing costs a full collection of garbage; loops of small steps go without (``free=False``).  The estimate of the size goes
    too: Spark keeps it over a checkpoint, a join multiplies those of its sides, and so in a loop its digits double each round.
    """
    where = shared_dir(df.sparkSession)
    if not _context_dir(df.sparkSession):
        df.sparkSession.sparkContext.setCheckpointDir(where)
    done = df.checkpoint(eager=True)
    rows = done._jdf.queryExecution().analyzed().rdd()
    out = DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(rows, done._jdf.schema(), False), df.sparkSession)
    if free:
        del done, rows
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()  # Spark's cleaner follows the collector
    return out


def release() -> None:
    """What this process has freed goes back to the system, where the allocators can do that."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def thrifty(run: Callable) -> Callable:
    """For Python workers: once a group (or, with an iterator of batches, a task) is done, its memory is given back.

    Spark keeps idle workers for the next stage; what they have freed but still hold counts against the executor all the while.
    """
    parts = inspect.isgeneratorfunction(run)

    @functools.wraps(run)
    def held(*args):
        out = run(*args)
        if not parts:
            release()
        return _to_the_end(out) if parts else out

    held.__signature__ = inspect.signature(run)  # Spark counts the arguments
    return held


def _to_the_end(batches: Iterator) -> Iterator:
    yield from batches
    del batches
    release()


def split_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; none for null or blank text."""
    parts = F.split(text, WHITE_RE)
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.filter(parts, lambda w: w != ""))


def lower_ascii(text: Column) -> Column:
    """A-Z only, as the contracts say; ``lower`` would also fold other letters."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Size of all texts, one aggregated number."""
    return int(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)


def chunk_count(total_bytes: int, partitions: int, least: int = 8 << 20, most: int = 64 << 20) -> int:
    """How many chunks a corpus is dealt into.

    Packed exchanges send one blob per (chunk, bucket), so the chunk grows with the
    square root of the corpus, up to 64 MiB, which a task holds with its arrays.  There are as many as
    shuffle partitions, at least, unless that leaves less than 256 KiB to each.
    """
    size = min(most, max(least, int(least * math.sqrt(total_bytes / (1 << 30)))))
    return max(1, math.ceil(total_bytes / size), min(partitions, total_bytes >> 18))


def bucket_counts(chunks: int, total_bytes: int) -> tuple[int, int]:
    """Buckets of the exchange of fingerprints (a tenth of the text) and of that of segments.

    As many as chunks; where those are very many, of 2 GiB and 256 MiB of text, so that a blob keeps a hundred bytes and more.
    """
    return max(1, min(chunks, max(4_096, total_bytes >> 31))), max(1, min(chunks, max(4_096, total_bytes >> 28)))


def chunks_for(docs: DataFrame, text_col: str = "text") -> tuple[int, int, int, int]:
    """Chunks, buckets of the two packed exchanges, and bytes, of these texts."""
    total = text_bytes(docs, text_col)
    chunks = chunk_count(total, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return chunks, *bucket_counts(chunks, total), total


#: Words of 64 bits in a sieve; it is what a broadcast of one holds at most, 64 of them a row.
SLOTS = 1 << 20


def _slot(value: Column) -> Column:
    return F.pmod(value, F.lit(SLOTS)).cast("long")


def _mask(value: Column) -> Column:
    bit = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(value, by).bitwiseAND(F.lit(63)).cast("int"))
    return bit(32).bitwiseOR(bit(40))


def _row(slot: Column) -> Column:
    return F.shiftright(slot, 6)


def _shifted(value: int, slot: Column) -> Column:
    """Shifted to the left by the place of a slot in its row."""
    return F.call_function("shiftleft", F.lit(value).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))


def sieve(keys: DataFrame, column: str) -> DataFrame:
    """A Bloom filter of 64-bit hashes as a table of at most ``SLOTS / 64`` rows: ``row, present, words``.

    A row has the words that aren't 0, in order, and tells by bits which these are.  Rows of one word each would take ten
    times the memory where they are hashed for a broadcast, in the driver and in every executor.
    """
    dealt = keys.select(_slot(F.col(column)).alias("slot"), _mask(F.col(column)).alias("mask")).withColumn("row", _row(F.col("slot"))).repartition("row")
    words = dealt.groupBy("row", "slot").agg(F.bit_or("mask").alias("bits"))
    whole = words.groupBy("row").agg(F.bit_or(_shifted(1, F.col("slot"))).alias("present"), F.sort_array(F.collect_list(F.struct("slot", "bits"))).alias("words"))
    return whole.select("row", "present", F.transform("words", lambda w: w["bits"]).alias("words"))


def sifted(rows: DataFrame, column: str, keys: DataFrame, key: str, among: bool = True) -> DataFrame:
    """The rows whose hash may be among the keys (or, ``among=False``, surely isn't), without shuffling them.

    Only the sieve is broadcast, whose size is bounded whatever the number of keys.  What passes is to be joined with the keys by an
    inner join or ``without``: the optimiser moves semi and anti joins below the sieve, and then all rows are shuffled.
    """
    held = F.broadcast(sieve(keys, key).withColumnsRenamed({"row": "__at", "present": "__present", "words": "__words"}))
    slot = _slot(F.col(column))
    met = rows.join(held, _row(slot) == F.col("__at"), "inner" if among else "left")
    # the words before this one are counted by their bits
    word = F.when(F.col("__present").bitwiseAND(_shifted(1, slot)) != 0, F.get("__words", F.bit_count(F.col("__present").bitwiseAND(F.bitwise_not(_shifted(-1, slot))))))
    hit = F.coalesce(word, F.lit(0)).bitwiseAND(_mask(F.col(column))) == _mask(F.col(column))
    return met.where(hit if among else ~hit).select(*rows.columns)


def without(rows: DataFrame, gone: DataFrame, same: Column, column: str) -> DataFrame:
    """The rows that no row of ``gone`` (distinct; ``column`` has no nulls) is the same as: an anti join that stays where it is."""
    return rows.join(gone, same, "left").where(F.col(column).isNull()).select(*rows.columns)
