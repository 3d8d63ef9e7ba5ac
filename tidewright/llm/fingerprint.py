"""Document fingerprints by one-permutation MinHash (operator 6), in DataFrame functions only.

Each shingle of five words is hashed once.  The high bits of the hash are its bin, and each bin keeps its smallest
hash.  An empty bin takes the value of a non-empty one: of all non-empty bins the one
with the smallest hash of the pair (empty bin, bin), that is, a uniform choice that two sets
with the same non-empty bins make alike (optimal densification, with the probe
sequence read as a random order).  Of each bin ``BITS`` low-order bits are stored.  The share of
equal bins is corrected for the 2**-BITS chance agreements.

A text of fewer than five words has one shingle, its whole sequence of words.  Texts without words (null, empty,
blank) have the empty fingerprint: likeness 1 to each other, 0 to all others.

``fingerprints`` maps a text column; ``with_edits`` gives the table of the query.  There, a
document's successor is the next one in descending order of (id, hash of the text), after the last
the first; null ids come last; repeated rows (same id and text) are one document
and keep a result row each; a lone document is its own successor; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import SHINGLE_WORDS, cut, split_words

BIN_BITS, BITS = 7, 8
BINS = 1 << BIN_BITS
_SHIFT = 64 - BIN_BITS
_REST = (1 << _SHIFT) - 1  # a bin's largest hash; it marks an empty bin


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once."""
    return F.transform(F.array(value), use)[0]


def shingle_hashes(words: Column, k: int = SHINGLE_WORDS) -> Column:
    """A 64-bit hash for each run of k words; of all words if there are fewer; none without words."""
    many = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k)))
    return let(words, lambda w: F.when(F.size(w) >= k, many(w)).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")))


def _bin(x: Column) -> Column:
    return F.shiftright(x, _SHIFT)


def codes(hashes: Column) -> Column:
    """``BINS`` codes of ``BITS`` bits (as tinyint); no codes for no hashes."""
    marks = F.transform(F.sequence(F.lit(-(BINS // 2)).cast("long"), F.lit(BINS // 2 - 1).cast("long")), lambda b: F.shiftleft(b, _SHIFT).bitwiseOR(F.lit(_REST)))
    full = lambda x: x.bitwiseAND(F.lit(_REST)) != F.lit(_REST)
    least = lambda s: F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(s[F.greatest(i - 1, F.lit(0))])))

    def dense(held: Column) -> Column:
        low = lambda x: x.bitwiseAND(F.lit((1 << BITS) - 1))
        donor = lambda have, j: low(F.array_min(F.transform(have, lambda x: F.xxhash64(j, _bin(x)).bitwiseAND(F.lit(-(1 << BITS))).bitwiseOR(low(x)))))
        return let(F.filter(held, full), lambda have: F.transform(held, lambda x, j: (F.when(full(x), low(x)).otherwise(donor(have, j)) - F.lit(1 << (BITS - 1))).cast("tinyint")))

    made = lambda h: let(F.sort_array(F.concat(h, marks)), lambda s: let(least(s), dense))
    return let(hashes, lambda h: F.when(F.size(h) > 0, made(h)).otherwise(F.array().cast("array<tinyint>")))


def packed(of: Column) -> Column:
    """Codes as a string of hexadecimal digits."""
    return F.array_join(F.transform(of, lambda c: F.lpad(F.hex(c.cast("long") + F.lit(1 << (BITS - 1))), BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets, with the chance agreements taken off."""
    chance = 2.0**-BITS
    agree = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(BINS))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(F.greatest(F.lit(0.0), (agree - chance) / (1 - chance)))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, codes, fingerprint``."""
    return docs.select(F.col(id_col).alias("doc_id"), codes(shingle_hashes(split_words(F.col(text_col)))).alias("codes")).withColumn("fingerprint", packed(F.col("codes")))


def ranked(keys: DataFrame, *order: Column) -> DataFrame:
    """Numbers the rows from 0 in this order (``rank``), without one task that sorts all of them."""
    parts = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(keys.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    # one row for each partition of the range sort
    ahead, bases = 0, []
    for part, n in sorted(dealt.groupBy("part").count().collect()):
        bases.append((part, ahead))
        ahead += n
    base = dealt.sparkSession.createDataFrame(bases, "part int, base long")
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("own", own).join(F.broadcast(base), "part").select(*keys.columns, (F.col("base") + F.col("own")).alias("rank"))


def with_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint against that of its edited text and of its successor."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    keys = base.groupBy("doc_id", "hash", F.char_length("text").cast("long").alias("n_chars")).agg(F.count(F.lit(1)).alias("n"))
    keys = cut(ranked(keys, F.col("doc_id").desc_nulls_last(), F.col("hash").desc()))
    total, most = keys.agg(F.count(F.lit(1)), F.max("n")).first()
    if not total:
        total, most = 1, 1
    # the successor's beginning is all that is needed of it, and who needs it is known
    before = keys.select(((F.col("rank") + 1) % total).alias("rank"), F.col("doc_id").alias("to_id"), F.col("hash").alias("to_hash"), F.floor(F.col("n_chars") / 2).alias("need"))
    links = cut(keys.join(before, "rank").withColumn("next_rank", (F.col("rank") + 1) % total))

    def same(x: str, y: str) -> Column:
        return F.col(x).eqNullSafe(F.col(y))

    lines = links.select(F.col("doc_id").alias("l_id"), F.col("hash").alias("l_hash"), "n_chars", "rank", "next_rank", "to_id", "to_hash", "need")
    placed = base.join(lines, same("doc_id", "l_id") & same("hash", "l_hash"))
    left = placed.select("doc_id", "hash", "text", "n_chars", "rank", "next_rank")
    right = placed.select("to_id", "to_hash", F.expr("substring(text, 1, CAST(need AS INT))").alias("filler"))
    if most > 1:
        right = right.dropDuplicates(["to_id", "to_hash"])
    pair = left.join(right, same("doc_id", "to_id") & same("hash", "to_hash"))
    edited = F.concat(F.expr("substring(text, 1, CAST(n_chars - floor(n_chars / 2) AS INT))"), "filler")
    made = pair.select("doc_id", "n_chars", "rank", "next_rank", "text", edited.alias("edited")).select(
        "doc_id", "n_chars", "rank", "next_rank", F.sha2("edited", 256).alias("edited_sha256"),
            codes(shingle_hashes(split_words(F.col("text")))).alias("codes"), codes(shingle_hashes(split_words(F.col("edited")))).alias("edited_codes")
    )
    made = cut(made)
    following = made.select(F.col("rank").alias("n_rank"), F.col("codes").alias("next_codes"))
    if most > 1:
        following = following.dropDuplicates(["n_rank"])
    out = made.join(following, F.col("next_rank") == F.col("n_rank"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", packed(F.col("codes")).alias("fingerprint"), packed(F.col("edited_codes")).alias("edited_fingerprint"),
        likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"), likeness(F.col("codes"), F.col("next_codes")).alias("near_next"),
    )


def op6_fingerprint(spark, sf_dir: str) -> DataFrame:
    return with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
