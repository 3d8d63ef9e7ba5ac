"""What the second round found: state that grows with rounds, and partners beyond a bound."""

from __future__ import annotations

import inspect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import common, graph, jaccard_join, line_dedup


def test_estimates_do_not_grow_with_rounds(spark):
    rows = spark.range(100).select("id", F.col("id").alias("c"))
    for _ in range(12):
        rows = common.cut(rows.join(rows.select(F.col("c").alias("id"), F.col("c").alias("m")), "id").select("id", F.col("m").alias("c")), free=False)
    # its bits doubled with each round before
    assert rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 64
    assert rows.where("id = c").count() == 100


def test_components_of_a_long_path_take_few_rounds(spark, monkeypatch):
    edges = spark.range(600).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    cuts = []
    monkeypatch.setattr(graph, "cut", lambda df, free=True: cuts.append(free) or common.cut(df, free))
    found = graph.components(edges, few=10)
    ids = [r.a for r in edges.select("a").union(edges.select("b")).distinct().collect()]
    assert {(r.v, r.c) for r in found.collect()} == {(v, min(ids)) for v in ids}
    assert cuts.count(False) <= 16


@pytest.mark.parametrize("least", [1, 6])
def test_lines_are_deleted_whatever_earlier_document_aligns(spark, least):
    """60 documents in which lines stand in many orders: as many partners as there are earlier documents."""
    rng, texts = random.Random(5), []
    lines = [f"line {i} is {'long enough to stand alone' if i % 2 else ''}" for i in range(14)]
    for _ in range(60):
        some = rng.sample(lines, 9)
        texts.append("\n".join([*some, rng.choice(some), rng.choice(some)]))
    numbers = {x.strip(): i for i, x in enumerate(lines, 1)}
    code = [[numbers[x.strip()] for x in t.split("\n")] for t in texts]
    want = []
    for d, b in enumerate(code):
        size = [len(x.split()) for x in texts[d].split("\n")]
        lost = {i for a in code[:d] for i in line_dedup.deletable(a, b, size, least)}
        want.append("\n".join(x for i, x in enumerate(texts[d].split("\n")) if i not in lost))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.deduplicate(table, least).collect()} == dict(enumerate(want))


def test_links_at_the_edge_of_two_distances_are_found():
    """Pivot and outsider are exactly 2e apart; only what lies within e of both connects them."""
    whole = set(range(20))
    pivot, other = whole - set(range(4)), whole - set(range(4, 8))
    sets = [pivot, *(pivot | {100 + i} for i in range(30)), whole, other]
    join = jaccard_join.Join([np.array(sorted(x), np.uint64) for x in sets], 80)
    assert join.central(np.arange(len(sets))) == 0 and join.links(len(sets) - 2, len(sets) - 1)
    join.run(np.arange(len(sets)))
    assert len(np.unique(join.roots(np.arange(len(sets))))) == 1


def test_a_sieve_is_told_in_few_rows(spark):
    keys = spark.range(300_000).select(F.xxhash64("id").alias("h"))
    assert common.sieve(keys, "h").count() <= common.SLOTS // 64
    rows = spark.range(100).select(F.xxhash64(F.col("id") * 3001).alias("h")).union(spark.createDataFrame([(None,), (-1,), (0,), (1 << 62,), (-(1 << 63),)], "h long"))
    for n in (0, 1, 64, 300_000):
        few = keys.limit(n)

        def word(h: int) -> int:
            return 1 << (h >> 32 & 63) | 1 << (h >> 40 & 63)

        words = {}
        for r in few.collect():
            words[r.h % common.SLOTS] = words.get(r.h % common.SLOTS, 0) | word(r.h)
        want = sorted(r.h for r in rows.collect() if r.h is not None and words.get(r.h % common.SLOTS, 0) & word(r.h) == word(r.h))
        assert sorted(r.h for r in common.sifted(rows, "h", few, "h").collect()) == want
        left = common.sifted(rows, "h", few, "h", among=False)
        assert sorted(r.h for r in left.collect() if r.h is not None) == sorted(r.h for r in rows.collect() if r.h is not None and r.h not in want)


def test_lines_are_read_without_patterns_and_dealt_out_once(spark, monkeypatch):
    """Patterns for each line and telling the shuffled lines of repeated rows apart took op2_line_dedup over its CPU seconds."""
    plans = []
    monkeypatch.setattr(line_dedup, "cut", lambda df, free=True: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or common.cut(df, free))
    first, odd = "one\ttwo\r\n\x0b\n  three  four\x0c\nown", "three  four\n\none\ttwo\nfive\x1f\n \r\nthree four"
    rows = [(1, first), (2, "one\ttwo"), (1, first), (3, odd), (3, odd), (4, " one two "), (5, None), (6, ""), (7, "five\x1f"), (None, "own\t")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 99, r.text or "", r.n_lines, r.n_removed) for r in line_dedup.deduplicate(table, 1).collect())
    # the white space of a line counts within it, but any kind does
    left = "\nfive\x1f\n \r\nthree four"
    assert got == [(1, first, 4, 0), (1, first, 4, 0), (2, "", 1, 1), (3, left, 6, 2), (3, left, 6, 2),
        (4, "", 1, 1), (5, "", 0, 0), (6, "", 1, 0), (7, "", 1, 1), (99, "", 1, 1)]
    assert not any("regexp" in p or "x20" in p for p in plans)
    assert not any("Aggregate [doc#" in line and "line#" in line.split("]")[0] for p in plans for line in p.splitlines())


def test_workers_give_back_what_a_group_has_freed():
    """Idle Python workers of the pipeline held what the largest group had taken."""
    kept = []

    def resident() -> int:
        return int(open("/proc/self/statm").read().split()[1]) >> 8  # MB, of pages of 4 KiB

    def fill(key, t) -> int:
        some = [np.ones(7_000) for _ in range(3_000)]  # too small to be mapped one by one
        kept.append(some[-1])  # the end of the heap stays in use
        return len(some)

    def each(parts):
        for part in parts:
            yield fill(None, part)

    assert inspect.getfullargspec(common.thrifty(fill)).args == ["key", "t"]
    common.release()
    before = resident()
    assert fill(None, None) == 3_000 and resident() > before + 100
    assert common.thrifty(fill)(None, None) == 3_000 and resident() < before + 40
    assert list(common.thrifty(each)(iter([1, 2]))) == [3_000, 3_000] and resident() < before + 40
