"""Benchmark decontamination (operator 9), in DataFrame functions only.

Finds benchmark items of which at least ``percent`` of the five-word shingles occur in a document, however
long the document is (containment of the item, A-Z lower-cased).

1. Items are partitioned by size (powers of two).  An item's sketch is its ``m`` smallest shingle hashes, where m
   is what the pigeonhole principle asks for at the partition's largest size u: of u shingles
   at most ``u - ceil(percent * u)`` may be missing, so one more than that can't all be.  The sketch is a fifth of the
   item.  (Banding by Jaccard similarity, the usual form of containment search, can't find 30 shingles
   among 20,000: their similarity is 0.001.)
2. Search: a document that holds a shingle of an item's sketch is a candidate for it; no true pair is lost.  The
   documents' shingles pass a sieve of the sketches (a Bloom filter of bounded size, broadcast), and only what
   passes is joined with them, so the corpus isn't shuffled however many items there are.
3. Verification, of candidates only: the distinct shingles of the candidate documents are joined with all
   shingles of the items and counted.

Results: items or documents without words (null, empty, blank) match nothing; an item of fewer than five
words is one shingle and is found only in a document of just these words; rows with one id and one text are one document
(or item), rows with one id, or none, and different texts are judged apart; other columns are ignored.  Shingles are
compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import SIMILARITY_PERCENT, cut, lower_ascii, sifted, split_words, without
from tidewright.llm.fingerprint import shingle_hashes


def keyed(table: DataFrame, id_col: str, text_col: str, id_name: str, key: str) -> DataFrame:
    """``id_name, key, text``: the key stands for id and text."""
    return table.select(F.col(id_col).cast("long").alias(id_name), row_key(id_col, text_col).alias(key), F.col(text_col).alias("text"))


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col).cast("long"), F.col(text_col))


def _set() -> Column:
    return F.array_distinct(shingle_hashes(split_words(lower_ascii(F.col("text")))))


def sketches(items: DataFrame, percent: int) -> DataFrame:
    """``item_id, item, n_item, hash, in_sketch`` for each distinct shingle of each item."""
    sets = items.dropDuplicates(["item_id", "item"]).select("item_id", "item", F.sort_array(_set()).alias("set"))
    size = F.size("set")
    largest = F.pow(F.lit(2), F.ceil(F.log2(size))).cast("int")
    m = largest - F.ceil(largest * percent / F.lit(100)) + 1
    each = sets.select("item_id", "item", size.cast("long").alias("n_item"), m.alias("m"), F.posexplode("set").alias("place", "hash"))
    return each.select("item_id", "item", "n_item", "hash", (F.col("place") < F.col("m")).alias("in_sketch"))


def candidates(docs: DataFrame, sought: DataFrame) -> DataFrame:
    """``doc, item``: documents that hold a shingle of the item's sketch."""
    sketch = sought.where("in_sketch").select("item", F.col("hash").alias("sketch_hash"))
    passed = sifted(docs.select("doc", F.explode(_set()).alias("hash")), "hash", sketch, "sketch_hash")
    return passed.join(sketch, F.col("hash") == F.col("sketch_hash")).select("doc", "item").distinct()


def verified(docs: DataFrame, sought: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """``doc_id, doc, item_id, n_shared, n_item`` of the candidate pairs that reach ``percent``."""
    wanted = pairs.select(F.col("doc").alias("w_doc")).distinct()
    few = sifted(docs, "doc", wanted, "w_doc").join(wanted, F.col("doc") == F.col("w_doc")).dropDuplicates(["doc_id", "doc"])
    met = few.select("doc_id", "doc", F.explode(_set()).alias("d_hash")).join(sought.drop("in_sketch"), F.col("d_hash") == F.col("hash"))
    counted = met.groupBy("doc_id", "doc", "item_id", "item", "n_item").agg(F.count(F.lit(1)).alias("n_shared"))
    among = pairs.select(F.col("doc").alias("p_doc"), F.col("item").alias("p_item"))
    both = counted.join(among, (F.col("doc") == F.col("p_doc")) & (F.col("item") == F.col("p_item")), "left_semi")
    return both.where(F.col("n_shared") * 100 >= F.col("n_item") * percent)


def _found(docs: DataFrame, items: DataFrame, percent: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    sought = cut(sketches(keyed(items, item_col, item_text_col, "item_id", "item"), percent))
    rows = keyed(docs, id_col, text_col, "doc_id", "doc")
    return verified(rows, sought, cut(candidates(rows, sought)), percent)


def contained(docs: DataFrame, items: DataFrame, percent: int = SIMILARITY_PERCENT, *, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, n_shared, n_item, containment`` of all pairs that reach ``percent``."""
    found = _found(docs, items, percent, id_col, text_col, item_col, item_text_col)
    return found.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, percent: int = SIMILARITY_PERCENT, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that hold no benchmark item, with all their columns.  Rows that a sieve clears aren't shuffled."""
    held = cut(_found(docs, items, percent, id_col, text_col, "item_id", "text").select(F.col("doc_id").alias("__held_id"), F.col("doc").alias("__held")).distinct())
    rows = docs.withColumn("__doc", row_key(id_col, text_col))
    same = (F.col("__doc") == F.col("__held")) & F.col(id_col).cast("long").eqNullSafe(F.col("__held_id"))
    doubtful = without(sifted(rows, "__doc", held, "__held"), held, same, "__held")
    return sifted(rows, "__doc", held, "__held", among=False).unionByName(doubtful).drop("__doc")


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = {
    "op9_decontaminate": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
b AS (SELECT row_number() OVER () AS j, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
ds AS (SELECT DISTINCT k, doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT k, doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
bs AS (SELECT DISTINCT j, item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT j, item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT j, count(*) AS n_item FROM bs GROUP BY j)
SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*)::DOUBLE / n_item AS containment
FROM ds JOIN bs USING (s) JOIN n USING (j)
GROUP BY k, j, doc_id, item_id, n_item HAVING count(*) * 100 >= n_item * 80
"""
}
