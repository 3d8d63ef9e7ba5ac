"""Line deduplication by pairwise alignment (operator 2).

1. A line's owner is the earliest document that has it.  A document is paired with the owners of all its shared
   lines, rare or frequent.  These are star edges: a line in m documents makes at most m - 1 pairs.  So that a block meets a
   document that holds it whole, it is also paired with the earliest documents that have its runs of shared lines: two
   neighbours (and the empty lines between), and the shortest runs of ``min_words`` that begin or end at a line.  Where a line is
   left after that (it stands in another order), further partners are other earlier holders of the line (of its runs, if it has fewer
   than ``min_words``): the first of each of ``HOLDERS`` classes, then of more classes, in the end all of them.  So a line is deleted
   if alignment with any earlier document deletes it; copies of a holder are not aligned again.
2. Each pair is aligned by patience diff: common beginnings and ends, then lines unique on both sides in their
   longest increasing order, then the gaps between them.
3. Aligned common blocks of at least ``min_words`` words are deleted from the later document; the query and the pipeline
   delete all of them, however short.  The earliest document that has a line never loses it.

Lines end at LF and are compared without white space around them; empty lines can lie within a block but don't start a pair.
"Earlier" is by id, then by hash of the text; null ids are last.

Results: null and empty texts have no lines to lose and stay as they are; rows with one id and text are one
document, each keeps its row; other columns are kept by ``deduplicate`` and ignored by the query.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import cut, sifted, split_words, thrifty

MIN_WORDS = 10
PAIRS = 2_000  # of one owner that are dealt out together
HOLDERS = 8  # classes of the first round of further holders; a round has as many times more
CLASSES = 4_096  # beyond, all holders are partners


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs in order of their first number, the longest chain in which the second grows."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        back[i] = last[k - 1] if k else -1
        tops[k : k + 1] = [y]
        last[k : k + 1] = [i]
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places of two sequences, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        place = {x: y for y, x in enumerate(b[k:m], k) if in_b[x] == 1}
        chain = _increasing([(x, place[v]) for x, v in enumerate(a[i:j], i) if in_a[v] == 1 and v in place])
        if not chain:
            continue
        for (x, y), (u, w) in zip([(i - 1, k - 1), *chain], [*chain, (j, m)], strict=True):
            if x >= i:
                out.append((x, y))
            todo.append((x + 1, u, y + 1, w))
    return sorted(out)


def deletable(a: list[int], b: list[int], words: list[int], min_words: int) -> list[int]:
    """Lines of b in aligned blocks that hold enough words."""
    out: list[int] = []
    block: list[int] = []
    before = (-2, -2)
    for pair in [*patience(a, b), (-9, -9)]:
        if pair != (before[0] + 1, before[1] + 1):
            if sum(words[y] for y in block) >= min_words:
                out += block
            block = []
        block.append(pair[1])
        before = pair
    return out


def spans_of(lines: list[int], words: list[int], shared: set[int], min_words: int) -> set[tuple[int, int]]:
    """First and last place of the runs of shared lines by which a common block of several lines finds a partner."""
    spans: set[tuple[int, int]] = set()
    stretch: list[int] = []
    for i, x in enumerate([*lines, None]):
        if x == 0:
            continue
        if x in shared:
            stretch.append(i)
            continue
        spans.update(zip(stretch, stretch[1:], strict=False))
        begin = size = 0
        for end, y in enumerate(stretch):
            size += words[y]
            while size >= min_words:
                # the shortest run that begins here, and the shortest that ends here
                spans.add((stretch[begin], y))
                size -= words[stretch[begin]]
                begin += 1
            if begin:
                spans.add((stretch[begin - 1], y))
        stretch = []
    return spans


def runs(lines: list[int], words: list[int], shared: set[int], min_words: int) -> set[int]:
    """Hashes of the runs of two lines or more."""
    found = spans_of(lines, words, shared, min_words)
    return {_run_hash(lines[i : j + 1]) for i, j in found if i < j}


def _run_hash(lines: list[int]) -> int:
    return int.from_bytes(blake2b(array("q", lines).tobytes(), digest_size=8).digest(), "little", signed=True)


def sought_units(lines: list[int], words: list[int], shared: set[int], removed: set[int], min_words: int) -> set[int]:
    """Lines and hashes of runs, one of which any document must hold that could still delete a line of this one."""
    still = [i for i, x in enumerate(lines) if x in shared and i not in removed]
    out = {lines[i] for i in still if words[i] >= min_words}
    short = [i for i in still if words[i] < min_words]
    for i, j in spans_of(lines, words, shared, min_words) if short else ():
        k = bisect_left(short, i)
        if i < j and k < len(short) and short[k] <= j and sum(words[i : j + 1]) >= min_words:
            out.add(_run_hash(lines[i : j + 1]))
    return out


def removals(docs: DataFrame, min_words: int = MIN_WORDS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc (key), removed (line numbers)`` for documents that lose lines."""
    text = F.coalesce(text_col, F.lit(""))
    for c in "\t\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    split = docs.select(_key(id_col, text_col).alias("doc"), F.transform(F.split(text, "\n"), lambda x: F.trim(x)).alias("line"))
    hashed = F.transform("line", lambda x: F.when(x == "", F.lit(0).cast("long")).otherwise(F.xxhash64(x))).alias("lines")
    # with a bound of one word it only matters which lines are empty
    words = F.transform("line", lambda x: (x != "").cast("int") if min_words <= 1 else F.size(split_words(x))).alias("words")
    # repeated rows go before lines are dealt out, so that these needn't be told apart
    own = cut(split.select("doc", hashed, words).dropDuplicates(["doc"]))
    each = own.select("doc", F.explode(F.array_distinct("lines")).alias("line")).where("line <> 0")
    # a frequent line's rows are split by Spark if what they are joined with is no aggregate in the same stage
    owner = cut(each.groupBy("line").agg(F.min("doc").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    shared = each.join(owner, "line")
    met_lines = own.join(shared.groupBy("doc").agg(F.collect_list("line").alias("shared")), "doc").select("doc", "lines", "words", "shared")
    # one line alone makes a run only with itself, which matters where lines are too short
    several = met_lines.where(F.size("shared") > 1) if min_words <= 1 else met_lines

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [list(runs(x, w, set(s), min_words)) for x, w, s in zip(part["lines"].to_pylist(), part["words"].to_pylist(), part["shared"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part["doc"], pa.array(found, pa.list_(pa.int64()))], names=["doc", "runs"])

    held = cut(several.mapInArrow(thrifty(find), f"doc {met_lines.schema['doc'].dataType.simpleString()}, runs array<bigint>").where(F.size("runs") > 0)).select("doc", F.explode("runs").alias("run"))
    first_held = cut(held.groupBy("run").agg(F.min("doc").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), free=False)
    pairs = cut(shared.select("doc", "owner").union(held.join(first_held, "run").select("doc", "owner")).where("doc <> owner").distinct())
    gone = cut(_aligned(pairs, own, min_words))
    # lines that are left though an earlier document has them, because they stand in another order there: further holders
    first, holding = owner.withColumnRenamed("line", "unit"), each.withColumnRenamed("line", "unit")
    if min_words > 1:
        first, holding = first.union(first_held.select("run", "owner")), holding.union(held.select("doc", "run"))
    left, classes = cut(_left(met_lines, gone, min_words).join(first, "unit").where("doc <> owner").select("doc", "unit")), HOLDERS
    while left.limit(1).count():
        sought = cut(left.select(F.col("unit").alias("s_unit")).distinct(), free=False)
        # the earliest of each class of texts first, a few rows for a unit; then only the units that are sought
        of = F.col("doc.hash") if classes > CLASSES else F.pmod(F.xxhash64(F.lit(7), "doc.hash"), F.lit(classes))
        found = sifted(holding, "unit", sought, "s_unit").groupBy("unit", of.alias("of")).agg(F.min("doc").alias("owner"), (F.min("doc.hash") != F.max("doc.hash")).alias("more"))
        holders = cut(found.join(sought, F.col("unit") == F.col("s_unit")).select("unit", "owner", "more"))
        more = cut(left.join(holders.select("unit", "owner"), "unit").where("owner < doc").select("doc", "owner").distinct().join(pairs, ["doc", "owner"], "left_anti"))
        gone = cut(_merged(gone.unionByName(_aligned(more, own, min_words))))
        pairs = pairs.unionByName(more)
        # what is known of all its holders now is settled
        still = cut(holders.where("more").select(F.col("unit").alias("m_unit")).distinct(), free=False)
        if not still.limit(1).count():
            break
        met_lines = cut(met_lines.join(left.select(F.col("doc").alias("l_doc")).distinct(), F.col("doc") == F.col("l_doc"), "left_semi"))
        again = _left(met_lines, gone, min_words).join(still, F.col("unit") == F.col("m_unit")).select("doc", "unit")
        left, classes = cut(again.join(left, ["doc", "unit"], "left_semi")), classes * HOLDERS
    return gone


def _left(met_lines: DataFrame, gone: DataFrame, min_words: int) -> DataFrame:
    """``doc, unit``: what an earlier document must hold to delete a line that is left of ``met_lines (doc, lines, words, shared)``."""
    lost = gone.select(F.col("doc").alias("g_doc"), "removed")
    rows = met_lines.join(lost, F.col("doc") == F.col("g_doc"), "left").select("doc", "lines", "words", "shared", "removed")

    def seek(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            columns = (part[c].to_pylist() for c in ("lines", "words", "shared", "removed"))
            found = [list(sought_units(x, w, set(s), set(r or ()), min_words)) for x, w, s, r in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([part["doc"], pa.array(found, pa.list_(pa.int64()))], names=["doc", "units"])

    units = rows.mapInArrow(thrifty(seek), f"doc {rows.schema['doc'].dataType.simpleString()}, units array<bigint>")
    return units.select("doc", F.explode("units").alias("unit"))


def _aligned(pairs: DataFrame, own: DataFrame, min_words: int) -> DataFrame:
    """``doc, removed`` by alignment of each document of ``pairs (doc, owner)`` with its owners."""
    # one owner may be in a third of all pairs: its pairs are dealt out in as many parts as they need
    parts = cut(pairs.groupBy(F.col("owner").alias("p_owner")).agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("parts")), free=False)
    first = own.join(parts, F.col("doc") == F.col("p_owner")).select(F.col("doc").alias("o_doc"), F.col("lines").alias("o_lines"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o_part"))
    dealt = pairs.join(parts, F.col("owner") == F.col("p_owner")).withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    with_owner = dealt.join(first, (F.col("owner") == F.col("o_doc")) & (F.col("part") == F.col("o_part"))).select("doc", "o_lines")
    met = with_owner.join(own.withColumnRenamed("doc", "l_doc"), F.col("doc") == F.col("l_doc")).select("doc", "o_lines", "lines", "words")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [deletable(a, b, w, min_words) for a, b, w in zip(part["o_lines"].to_pylist(), part["lines"].to_pylist(), part["words"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part["doc"], pa.array(found, pa.list_(pa.int32()))], names=["doc", "removed"])

    return _merged(met.mapInArrow(thrifty(run), f"doc {met.schema['doc'].dataType.simpleString()}, removed array<int>").where(F.size("removed") > 0))


def _merged(aligned: DataFrame) -> DataFrame:
    return aligned.groupBy("doc").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("removed")))).alias("removed"))


def _key(id_col: str, text_col: str):
    return F.struct(F.col(id_col).isNull().alias("unknown"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("hash"))


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, the text without the deleted lines; and ``n_lines, n_removed`` (in place of columns so named)."""
    gone = removals(docs, min_words, id_col=id_col, text_col=text_col).select(F.col("doc").alias("__gone"), F.col("removed").alias("__removed"))
    joined = docs.join(gone, _key(id_col, text_col) == F.col("__gone"), "left")
    lines = F.split(text_col, "\n")
    kept = F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__removed", i)), "\n"))
    count, lost = F.coalesce(F.size(lines), F.lit(0)), F.coalesce(F.size("__removed"), F.lit(0))
    made = joined.withColumns({"__n": F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(count).cast("long"),
        "__lost": F.when(F.col("__removed").isNull(), F.lit(0)).otherwise(lost).cast("long"), "__kept": kept})
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return made.select(*[F.col("__kept").alias(c) if c == text_col else F.col(c) for c in names], F.col("__n").alias("n_lines"), F.col("__lost").alias("n_removed"))


def stage(docs: DataFrame) -> DataFrame:
    """For a pipeline: the columns of ``docs``, the text and its ``n_chars`` after deletion; documents that lost all their text go."""
    made = deduplicate(docs, min_words=1)
    left = made.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long"))
    return left.select(*[F.coalesce(chars, F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    made = deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), min_words=1)
    return made.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
