"""Exact Jaccard join of word shingles in metric space (operator 10).

Two documents link when ``100 * |A and B| >= percent * |A or B|`` for their sets of five-word shingles (A-Z
lower-cased).  1 - J is a metric; links are distances of at most e = 1 - percent/100.

1. Copies of a text become one class.  A class that makes up over a hundred-thousandth of all
   rows is reduced before any text is dealt out (there are fewer than 100,000 of these).
2. A packed exchange tells how many classes hold each shingle.  A set of which more than a share e occurs nowhere else
   can't have a partner; most of the corpus leaves here.
3. Pivots.  Linked sets share at least one of their rarest ``n - ceil(n * percent / 100) + 1`` shingles.  For each such shingle
   the first document that has it is a pivot, and the documents that have it are in its region: linked sets meet in a region.
4. Each document first goes to the region of the pivot it shares most of them with (its Voronoi cell), and the regions are joined.
   Then it is replicated to the others of its regions, but only to those whose members are not all
   connected yet, and these are joined as well.
5. A region of up to ``ROWS`` sets is joined in one task, recursively around pivot documents; one of up to ``PAIRED`` sets
   in the same way, but for every pair of its blocks.  Larger regions are joined by many tasks: some central members become pivots, distances to them are measured, and whatever lies
   within e of its nearest pivot links to it and needs no comparison among itself.  Triangle inequality: only what lies within
   2e of a pivot can link to such a document, so only that is replicated to it (the window), in blocks.  What lies outside
   of all pivots is the next, smaller region, joined in the same way.  What is left after ``LEVELS`` rounds is
   compared block by block.  No task ever holds more than two blocks.
6. Connected components of the links.

Results: null, empty and blank texts have an empty set and link with nothing (``component_id`` is their own id); 1 to 4
words are one shingle; a component's id is its smallest id, null ids aside (null if there is no other); repeated rows are
copies; other columns are ignored.  Shingles are compared by 64-bit hashes (``hashing``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm import exchange as X
from tidewright.llm.common import SHINGLE_WORDS, SIMILARITY_PERCENT, chunks_for, cut, lower_ascii, sifted, thrifty, without
from tidewright.llm.graph import components
from tidewright.llm.hashing import Spans, U, distinct, mix
from tidewright.llm.substring_dedup import member, words_of

ROWS = 256  # sets that one task joins as a region
BLOCK = (128, 20_000)  # sets of a block: a 32nd of its region, within these bounds
PAIRED = 2_048  # sets of a region whose blocks are all compared, without pivots
LEVELS = 6
LAST = 1 << 62
SAMPLE, PIVOTS = 64, 6
LEAF = 24
CELLS = 12
BATCH = 1 << 20
CLASSES = "digest string, vertex long, n long, tokens binary, prefix array<long>"
EDGES = "a long, b long"


def shingle_sets(t: pa.Table, k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text of a chunk; texts must end in white space."""
    out = []
    for part in X.batches(t, BATCH):
        data, offsets = X.buffers(part)
        w = words_of(data, offsets)
        spans = Spans(w.code)
        every = spans.every(k)
        for first, n in zip(w.first.tolist(), w.count.tolist(), strict=True):
            if n >= k:
                out.append(distinct(every[first : first + n - k + 1]))
            else:
                out.append(spans.of(np.array([first]), np.array([first + n])) if n else np.zeros(0, U))
    return out


class Join:
    """Exact join of sets in memory; only what lies in different components is compared."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent, self.e = sets, percent, 1 - percent / 100
        self.size = np.array([len(s) for s in sets], np.int64)
        self.parent = np.arange(len(sets))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return int(i)

    def roots(self, some: np.ndarray) -> np.ndarray:
        return np.array([self.find(i) for i in some.tolist()], np.int64)

    def union(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def common(self, pivot: int, some: np.ndarray) -> np.ndarray:
        """Sizes of the intersections with the pivot."""
        own, out = self.sets[pivot], np.zeros(len(some), np.int64)
        for i in range(0, len(some), 512):
            block = [self.sets[j] for j in some[i : i + 512].tolist()]
            hit = np.concatenate([[0], np.cumsum(member(np.concatenate(block), own))])
            ends = np.cumsum([len(x) for x in block])
            out[i : i + 512] = hit[ends] - hit[ends - np.array([len(x) for x in block])]
        return out

    def against(self, pivot: int, some: np.ndarray) -> np.ndarray:
        """Distances to the pivot; what is near enough is linked."""
        both = self.common(pivot, some)
        whole = self.size[some] + self.size[pivot] - both
        for j in some[100 * both >= self.percent * whole].tolist():
            self.union(pivot, j)
        return 1 - both / whole

    def links(self, i: int, j: int) -> bool:
        both = int(self.common(i, np.array([j]))[0])
        return 100 * both >= self.percent * int(self.size[i] + self.size[j] - both)

    def fits(self, pivot: int, some: np.ndarray) -> np.ndarray:
        """Which sets have a size that a link with the pivot allows."""
        n = self.size[pivot]
        return (100 * np.minimum(self.size[some], n)) >= self.percent * np.maximum(self.size[some], n)

    def all_pairs(self, some: np.ndarray) -> None:
        for i in range(len(some) - 1):
            rest = some[i + 1 :]
            rest = rest[(self.roots(rest) != self.find(int(some[i]))) & self.fits(int(some[i]), rest)]
            if len(rest):
                self.against(int(some[i]), rest)

    def central(self, some: np.ndarray) -> int:
        """The set with the largest share of shingles that the others have too."""
        sample = np.concatenate([self.sets[i] for i in some.tolist()])
        values, counts = np.unique(sample, return_counts=True)
        score = [counts[np.searchsorted(values, self.sets[i])].sum() / max(1, len(self.sets[i])) for i in some.tolist()]
        return int(some[int(np.argmax(score))])

    def run(self, some: np.ndarray, depth: int = 0) -> None:
        while True:
            if len(some) <= LEAF:
                return self.all_pairs(some)
            pivot = self.central(some)
            near = self.against(pivot, some)
            outside = some[near > self.e]
            # what links to the pivot is settled among itself; it matters to outsiders within 2e of the pivot only
            if not len(outside):
                return
            inner = some[near <= self.e]
            if not (near[near > self.e] <= 2 * self.e + 1e-9).any():
                some = outside
                continue
            break
        some = np.concatenate([outside, inner])
        if depth < 20 and self.cells(some, pivot, depth):
            return
        self.outsiders(some, pivot)

    def cells(self, some: np.ndarray, pivot: int, depth: int) -> bool:
        """Joins Voronoi cells; False if that would not make the regions smaller."""
        pivots, distances = [pivot], [self.against(pivot, some)]
        while len(pivots) < CELLS:
            far = np.min(distances, axis=0)
            if far.max() <= self.e:
                break
            pivots.append(int(some[int(np.argmax(far))]))
            distances.append(self.against(pivots[-1], some))
        d = np.array(distances)
        held = d <= d.min(axis=0) + 2 * self.e + 1e-9
        if held.sum(axis=1).max() > 0.7 * len(some) or held.sum() > 2 * len(some):
            return False
        for row in held:
            cell = some[row]
            if len(cell) > 1 and len(np.unique(self.roots(cell))) > 1:
                self.run(cell, depth + 1)
        return True

    def outsiders(self, some: np.ndarray, pivot: int) -> None:
        """Each set outside the largest component, against those in its distance window."""
        near = self.against(pivot, some)
        root = self.roots(some)
        labels, counts = np.unique(root, return_counts=True)
        main = labels[int(np.argmax(counts))]
        for i in np.flatnonzero(root != main).tolist():
            own = self.find(int(some[i]))
            window = np.abs(near - near[i]) <= self.e + 1e-9
            rest = some[window]
            rest = rest[(self.roots(rest) != own) & self.fits(int(some[i]), rest)]
            if len(rest):
                self.against(int(some[i]), rest)


def _digest(text: Column) -> Column:
    return F.md5(lower_ascii(text))


def classes(docs: DataFrame, percent: int, chunks: int | None = None) -> DataFrame:
    """``CLASSES``: one row per distinct text of ``docs (doc_id, text)``; tokens and prefix where a partner is possible."""
    digests = docs.select(_digest(F.col("text")).alias("digest"), "doc_id")
    counts = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("one"))
    total = digests.count()
    hot = counts.where(F.col("n") > max(1000, total // 100_000)).select(F.col("digest").alias("hot_digest"), "one")
    chunks, buckets = (chunks, chunks) if chunks else chunks_for(docs)[:2]
    rows = docs.withColumn("digest", _digest(F.col("text"))).join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left")
    rows = rows.where(F.col("hot_digest").isNull() | F.col("one").isNull() | F.col("one").eqNullSafe(F.col("doc_id")))
    dealt = rows.select("digest", F.concat(lower_ascii(F.col("text")), F.lit(" ")).alias("text"), F.pmod(F.xxhash64("digest"), F.lit(chunks)).cast("int").alias("chunk"))

    def once(t: pa.Table) -> pa.Table:
        """One row of each text; the order is that of the digests, whatever order the rows came in."""
        _, at = np.unique(np.asarray(t["digest"].to_pylist()), return_index=True)
        return t.take(pa.array(at))

    def emit(t: pa.Table):
        keys, n = np.unique(np.concatenate([np.zeros(0, U), *shingle_sets(once(t), SHINGLE_WORDS)]), return_counts=True)
        return keys, n > 1

    def keep(key, t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _class_table([])
        t = once(t)
        sets = shingle_sets(t, SHINGLE_WORDS)
        keys = distinct(np.concatenate([np.zeros(0, U), *sets]))
        weight = X.read_weights(answers, keys, buckets)
        base, out = key[0].as_py() << 32, []
        for i, (digest, s) in enumerate(zip(t["digest"].to_pylist(), sets, strict=True)):
            n = len(s)
            must = -(-n * percent // 100)
            w = weight[np.searchsorted(keys, s)]
            if n and int((w > 1).sum()) >= must:
                first = np.lexsort((mix(s), w))[: n - must + 1]
                first = s[first[w[first] > 1]]
                out.append((digest, base + i, n, s.tobytes(), first.view(np.int64)))
            else:
                out.append((digest, base + i, n, None, None))
        return _class_table(out)

    answers = X.weights(dealt, emit, buckets)
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(thrifty(keep), CLASSES)


def _class_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["digest", "vertex", "n", "tokens", "prefix"])


def _edge_table(a: list[int], b: list[int]) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def memberships(sets: DataFrame) -> DataFrame:
    """``vertex, region, shared``: the regions of each set, by their pivots, and how many rare shingles put it there."""
    rare = sets.select("vertex", F.explode("prefix").alias("shingle"))
    first = cut(rare.groupBy("shingle").agg(F.min("vertex").alias("region"), F.count(F.lit(1)).alias("size")).where("size > 1").select("shingle", "region"), free=False)
    return rare.join(first, "shingle").groupBy("vertex", "region").agg(F.count(F.lit(1)).alias("shared"))


def links(sets: DataFrame, percent: int, rows: int = ROWS) -> DataFrame:
    """``EDGES`` between classes that are linked: enough of them to connect every component."""
    held = cut(memberships(sets))
    nearest = held.groupBy("vertex").agg(F.max_by("region", F.struct("shared", -F.col("region"))).alias("region"))
    inside = region_edges(sets, nearest.withColumn("label", F.col("vertex")), percent, rows)
    labels = components(inside).withColumnsRenamed({"v": "__v", "c": "__c"})
    named = cut(held.select("vertex", "region").join(labels, F.col("vertex") == F.col("__v"), "left").select("vertex", "region", F.coalesce("__c", "vertex").alias("label")))
    open_regions = cut(named.groupBy(F.col("region").alias("__open")).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("__open"), free=False)
    across = region_edges(sets, named.join(open_regions, F.col("region") == F.col("__open"), "left_semi"), percent, rows)
    # what the cells have connected, one edge for each document
    return labels.select(F.col("__v").alias("a"), F.col("__c").alias("b")).where("a <> b").unionByName(across)


def region_edges(sets: DataFrame, members: DataFrame, percent: int, rows: int) -> DataFrame:
    """``EDGES`` that connect what is linked within each region; ``members``: vertex, region, label.

    Members with one label are known to be connected and need no edge.
    """
    found = []
    bodies = sets.select(F.col("vertex").alias("__s"), "tokens")
    for level in range(LEVELS + 1):
        # Spark splits the rows of a large region if neither they nor what they are joined with are aggregated in the same stage
        members = cut(members, free=False)
        sizes = cut(members.groupBy(F.col("region").alias("__r")).agg(F.count(F.lit(1)).alias("size")).where("size > 1"), free=False)
        sized = cut(members.join(sizes, F.col("region") == F.col("__r")).select("vertex", "region", "label", "size"))
        with_body = sized.join(bodies, F.col("vertex") == F.col("__s")).select("vertex", "region", "label", "size", "tokens")
        # edges are few; plans stay small if each round is settled by itself
        most = PAIRED if level < LEVELS else LAST
        found.append(cut(_blockwise(with_body.where(F.col("size") <= most), percent, rows)))
        if not sized.where(F.col("size") > most).limit(1).count():
            break
        large = cut(with_body.where(F.col("size") > most))
        measured = cut(_measured(large, percent))
        found.append(measured.where("nearest IS NOT NULL AND vertex <> nearest").select(F.col("vertex").alias("a"), F.col("nearest").alias("b")))
        found.append(cut(_across(measured, percent)))
        members = measured.where("nearest IS NULL").select("vertex", "region", "label")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _task_rows(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by vertex, vertices and labels."""
    vertex = t["vertex"].to_numpy()
    order = np.argsort(vertex, kind="stable")
    return order, vertex[order], t["label"].to_numpy()[order]


def _join_of(t: pa.Table, order: np.ndarray, label: np.ndarray, percent: int) -> Join:
    """A join of the rows of a table in which equal labels are connected."""
    bodies = t["tokens"]
    join = Join([np.frombuffer(bodies[int(i)].as_py(), U) for i in order], percent)
    _, first, of = np.unique(label, return_index=True, return_inverse=True)
    for i, j in enumerate(first[of].tolist()):
        if i != j:
            join.union(j, i)
    return join


def _new_links(join: Join, vertex: np.ndarray, label: np.ndarray) -> pa.Table:
    """An edge from each label to the smallest vertex it is connected to, where that isn't of the label itself."""
    root = join.roots(np.arange(len(vertex)))
    _, first = np.unique(label, return_index=True)
    far = first[label[root[first]] != label[first]]
    return _edge_table(vertex[far].tolist(), vertex[root[far]].tolist())


def _blocks(rows: DataFrame) -> DataFrame:
    """Adds ``blocks``, the number of blocks of a row's region."""
    size = F.greatest(F.lit(BLOCK[0]), F.least(F.lit(BLOCK[1]), F.floor(F.col("size") / 32)))
    return rows.withColumn("blocks", F.ceil(F.col("size") / size).cast("int"))


def _block_of(vertex: str = "vertex", blocks: str = "blocks") -> Column:
    return F.pmod(F.xxhash64(F.lit(3), vertex), F.col(blocks)).cast("int")


def _blockwise(rows: DataFrame, percent: int, whole: int) -> DataFrame:
    """Joins all pairs of blocks of each region, each pair in a task of its own; a region of up to ``whole`` sets is one block."""
    own = _blocks(rows).withColumn("blocks", F.when(F.col("size") <= whole, 1).otherwise(F.col("blocks"))).withColumn("own", _block_of())
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, F.col("own")).alias("i"), F.greatest(b, F.col("own")).alias("j")))
    dealt = own.select("vertex", "region", "label", "tokens", F.explode(cells).alias("cell")).select("vertex", "region", "label", "tokens", "cell.i", "cell.j")

    def run(t: pa.Table) -> pa.Table:
        order, vertex, label = _task_rows(t)
        join = _join_of(t, order, label, percent)
        join.run(np.arange(len(vertex)))
        return _new_links(join, vertex, label)

    return dealt.groupBy("region", "i", "j").applyInArrow(run, EDGES)


def _measured(rows: DataFrame, percent: int) -> DataFrame:
    """``vertex, region, label, size, tokens, nearest, near``: the pivot within e, and all pivots within 2e with their distances."""
    some = rows.where(F.pmod(F.xxhash64(F.lit(11), "vertex"), F.greatest(F.lit(1), F.floor(F.col("size") / SAMPLE))) == 0).select("region", "vertex", "size", "tokens")
    e = 1 - percent / 100

    def choose(t: pa.Table) -> pa.Table:
        """The most central of a few members, then what is farthest from the pivots, until all lie within e of one."""
        vertex, at = np.unique(t["vertex"].to_numpy(), return_index=True)
        bodies = [t["tokens"][int(i)].as_py() for i in at]
        join, some = Join([np.frombuffer(x, U) for x in bodies], percent), np.arange(len(vertex))
        chosen = [join.central(some)]
        low = join.against(chosen[0], some)
        while len(chosen) < PIVOTS and low.max() > e:
            rest = some[low > e]
            chosen.append(join.central(rest))
            low = np.minimum(low, join.against(chosen[-1], some))
        return pa.table({"of": pa.array([t["region"][0].as_py()], pa.int64()), "size": pa.array([t["size"][0].as_py()], pa.int64()),
            "pivots": pa.array([vertex[chosen].tolist()], pa.list_(pa.int64())), "bodies": pa.array([[bodies[i] for i in chosen]], pa.list_(pa.binary()))})

    # a sample holds about SAMPLE members, whatever the size of the region; should it hold none, all members go on to the next round
    pivots = _blocks(some.groupBy("region").applyInArrow(choose, "of long, size long, pivots array<long>, bodies array<binary>"))
    copies = pivots.select("of", "pivots", "bodies", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"))
    dealt = _blocks(rows).withColumn("own", _block_of()).select("vertex", "region", "label", "size", "tokens", "own")

    def measure(t: pa.Table, told: pa.Table) -> pa.Table:
        names, bodies = (told["pivots"][0].as_py(), [np.frombuffer(x, U) for x in told["bodies"][0].as_py()]) if told.num_rows else ([], [])
        join = Join([*bodies, *(np.frombuffer(x.as_py(), U) for x in t["tokens"])] if t.num_rows else bodies, percent)
        rest = np.arange(len(names), len(join.sets))
        d = np.array([join.against(i, rest) for i in range(len(names))]).reshape(len(names), -1)
        best = np.argmin(d, axis=0) if names else np.zeros(len(rest), np.int64)
        # whether it links is decided in whole numbers
        linked = [bool(names) and join.links(int(i), int(j)) for i, j in zip(best, rest, strict=True)]
        near = [[{"p": names[i], "d": float(d[i, k])} for i in np.flatnonzero(d[:, k] <= 2 * e + 1e-9).tolist()] for k in range(len(rest))]
        kind = pa.list_(pa.struct([("p", pa.int64()), ("d", pa.float64())]))
        columns = [*(t[c] for c in ("vertex", "region", "label", "size", "tokens")),
            pa.array([names[i] if k else None for i, k in zip(best.tolist(), linked, strict=True)], pa.int64()), pa.array(near, kind)]
        return pa.table(columns, names=["vertex", "region", "label", "size", "tokens", "nearest", "near"])

    schema = "vertex long, region long, label long, size long, tokens binary, nearest long, near array<struct<p:long,d:double>>"
    return dealt.groupBy("region", "own").cogroup(copies.groupBy("of", "own")).applyInArrow(thrifty(measure), schema)


def _across(measured: DataFrame, percent: int) -> DataFrame:
    """Joins what links to a pivot with what else lies within 2e of it, block by block."""
    own = _blocks(measured).withColumn("own", _block_of())
    each = own.select("vertex", "region", "label", "blocks", "tokens", "nearest", "own", F.explode("near").alias("x")).select("vertex", "region", "label",
        "blocks", "tokens", "own", F.col("x.p").alias("p"), F.col("x.d").alias("d"), F.coalesce(F.col("nearest") == F.col("x.p"), F.lit(False)).alias("inner"))
    # blocks of the others: as many as they need, none without them
    others = each.where("NOT inner").groupBy(F.col("region").alias("__r"), F.col("p").alias("__p")).agg(F.count(F.lit(1)).alias("n"), F.max("blocks").alias("all"))
    blocks = others.select("__r", "__p", F.least(F.col("all"), F.ceil(F.col("n") / BLOCK[0])).cast("int").alias("outer_blocks"))
    met = each.join(blocks, (F.col("region") == F.col("__r")) & (F.col("p") == F.col("__p")))
    cells = F.when(F.col("inner"), F.transform(F.sequence(F.lit(0), F.col("outer_blocks") - 1), lambda o: F.struct(F.col("own").alias("i"), o.alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(i.alias("i"), _block_of("vertex", "outer_blocks").alias("j")))
    )
    dealt = met.select("vertex", "region", "label", "tokens", "p", "d", "inner", F.explode(cells).alias("cell")).select("vertex", "region", "label", "tokens", "p", "d", "inner", "cell.i", "cell.j")
    e = 1 - percent / 100

    def run(t: pa.Table) -> pa.Table:
        order, vertex, label = _task_rows(t)
        inner, d = np.asarray(t["inner"])[order], np.asarray(t["d"])[order]
        join = _join_of(t, order, label, percent)
        settled = np.flatnonzero(inner)
        for i in settled[1:].tolist():
            join.union(int(settled[0]), i)
        for i in np.flatnonzero(~inner).tolist() if len(settled) else []:
            rest = settled[np.abs(d[settled] - d[i]) <= e + 1e-9]
            rest = rest[(join.roots(rest) != join.find(i)) & join.fits(i, rest)]
            if len(rest):
                join.against(i, rest)
        return _new_links(join, vertex, label)

    return dealt.groupBy("region", "p", "i", "j").applyInArrow(run, EDGES)


def _components(rows: DataFrame, percent: int, chunks: int | None, region_rows: int) -> DataFrame:
    """``doc_id, digest, n, c, component_id`` (c: the component itself) for each of ``rows (doc_id, text)``."""
    made = cut(classes(rows, percent, chunks))
    found = components(links(made.where("prefix IS NOT NULL"), percent, region_rows))
    digests = rows.select("doc_id", _digest(F.col("text")).alias("digest"))
    least = digests.groupBy("digest").agg(F.min("doc_id").alias("least")).withColumnRenamed("digest", "l_digest")
    known = made.select("digest", "vertex", "n").join(found, F.col("vertex") == F.col("v"), "left").join(least, F.col("digest") == F.col("l_digest"))
    known = cut(known.select("digest", "n", F.coalesce("c", "vertex").alias("c"), "least"))
    smallest = known.groupBy("c").agg(F.min("least").alias("component_id")).withColumnRenamed("c", "of")
    told = known.join(smallest, F.col("c") == F.col("of")).select(F.col("digest").alias("k_digest"), "n", "c", "component_id")
    out = digests.join(told, F.col("digest") == F.col("k_digest"))
    return out.select("doc_id", "digest", "n", "c", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))


def join(docs: DataFrame, percent: int = SIMILARITY_PERCENT, *, id_col: str = "doc_id", text_col: str = "text", chunks: int | None = None, region_rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id``."""
    found = _components(_plain(docs, id_col, text_col), percent, chunks, region_rows)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def representatives(docs: DataFrame, percent: int = SIMILARITY_PERCENT, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that with the smallest id and of its texts the one with the smallest digest, with all columns.

    Rows are told apart by id and text: rows with one id (or none) and different texts that don't link are in components of
    their own.  Texts without words stay, repeated rows once; rows without an id stay if no row of their component has one.
    """
    found = cut(_components(_plain(docs, id_col, text_col), percent, None, ROWS).groupBy("doc_id", "digest", "n", "c").agg(F.count(F.lit(1)).alias("rows")))
    lead = found.where("n > 0").groupBy(F.col("c").alias("of")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("lead"))
    leads = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("digest") == F.col("lead.digest"))
    judged = found.join(lead, (F.col("c") == F.col("of")) & (F.col("n") > 0), "left").select("doc_id", "digest", "rows", ((F.col("n") == 0) | leads).alias("stays"))
    # rows that go, or are there several times; all others are cleared by a sieve and aren't shuffled
    doubt = cut(judged.where("NOT stays OR rows > 1").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__gone"), "stays", _row_key("doc_id", "digest").alias("__key")))
    rows = docs.withColumn("__digest", _digest(F.coalesce(text_col, F.lit("")))).withColumn("__row", _row_key(id_col, "__digest"))
    gone = doubt.where("NOT stays").select("__id", "__gone")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__gone"))
    few = without(sifted(rows, "__row", doubt, "__key"), gone, same, "__gone")
    return sifted(rows, "__row", doubt, "__key", among=False).unionByName(few.dropDuplicates([id_col, "__digest"])).drop("__digest", "__row")


def _row_key(id_col: str, digest: str) -> Column:
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col).cast("long"), F.col(digest))


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = {
    "op10_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT k, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
c AS (SELECT a.k AS x, b.k AS y, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.k <> b.k GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n a ON a.k = x JOIN n b ON b.k = y WHERE 100 * m >= 80 * (a.n + b.n - m)),
t AS (SELECT k AS x, k AS y FROM d UNION SELECT t.x, e.y FROM t JOIN e ON e.x = t.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(o.doc_id) AS component_id FROM d JOIN t ON t.x = d.k JOIN d o ON o.k = t.y LEFT JOIN n ON n.k = d.k GROUP BY d.k, d.doc_id, n.n
"""
}
