"""Word-level substring deduplication by recompression (operator 1).

A window is ``window`` consecutive words of one document.  Each word covered by a window
whose words also start anywhere else (same document included) is removed; windows are
judged on the input.

Recompression: in rounds, maximal runs of one symbol and then pairs (left, right) get a new
name; whether a symbol is a left or a right one is a bit of its name.  Names are 64-bit
hashes of what they stand for, so that all executors name equal content alike without a
shared dictionary.  With every symbol goes its context: the words that decided how it
was parsed.  Two equal windows therefore hold the same symbols at the same places, as
far as the context lies inside the window: these are the consistent interior symbols.
Each window is represented by one of them, the one with the smallest key; a window
without any (inside a long run, say) is represented by itself.  Windows that share a
representative form a segment.

1. Every chunk of documents sends the keys of its representatives (packed exchange); a key
   that occurs once in the corpus proves all its windows unique.
2. Of repeated keys, each chunk sends its distinct segments with counts and the 64-bit hashes of
   their windows; the shard of a key counts them exactly.  A key that very many chunks hold (a common phrase, with ever other
   words around it) would draw its segments into one shard: its windows are dealt out one by one by their hash.
3. The verdicts go back and the covered words are cut out.

Results: null, empty and blank texts have no words (``n_words`` 0, SHA-256 of nothing); a
text shorter than the window loses nothing; repeated rows (even with equal or null
ids) are separate documents and repeat each other; other columns are ignored.  Equal windows are
recognised by two hashes, of the representative's context and of the window, 64 bits each, built by mixing
functions throughout (``hashing``): no family of texts collides by construction.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import exchange as X
from tidewright.llm.common import WHITE, chunks_for
from tidewright.llm.hashing import Spans, U, gather, mix, word_codes

ROUNDS = 3
SEGMENT_BYTES = 50  # of text, for each segment that a chunk has
BATCH = 1 << 20
_WHITE = np.zeros(256, bool)
_WHITE[list(WHITE)] = True
_LEN, _AT, _TO = U(0xA24BAED4963EE407), U(0x9FB21C651E98DF25), U(0xD6E8FEB86659FD93)

_SIDES = [U((2 * r + 2) * int(_AT) % (1 << 64)) for r in range(16)]


class Words(NamedTuple):
    """Words of a batch, with one separator before and after each document.

    start, end: in the bytes (of separators: 0); code: hash; doc: per word; first: per document, its first word.
    """

    start: np.ndarray
    end: np.ndarray
    code: np.ndarray
    mark: np.ndarray
    first: np.ndarray
    count: np.ndarray


class Segments(NamedTuple):
    """first, last: window starts, inclusive; key: of the representative; name: of key and content."""

    first: np.ndarray
    last: np.ndarray
    key: np.ndarray
    name: np.ndarray
    hashes: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Every text must end in white space, which keeps documents apart."""
    blank = _WHITE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    codes = word_codes(data, start, end)
    before = np.searchsorted(start, offsets)  # words before each document
    count = np.diff(before)
    docs = len(offsets) - 1
    first = before[:-1] + np.arange(docs) + 1
    n = len(start) + docs + 1
    mark = np.zeros(n, bool)
    mark[first - 1] = True
    mark[-1] = True
    out = [np.zeros(n, np.int64), np.zeros(n, np.int64), mix(np.arange(n, dtype=U) * _TO + U(1))]
    for to, what in zip(out, (start, end, codes), strict=True):
        to[~mark] = what
    return Words(*out, mark, first, count)


def recompress(code: np.ndarray, mark: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """Symbols after some rounds: name, first word, end, and context from and to, in words."""
    n = len(code)
    name, start, end = code, np.arange(n), np.arange(1, n + 1)
    left, right = start, end
    for r in range(rounds):
        # maximal runs; that a run ends is known from its neighbours
        head = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | mark[1:] | mark[:-1]]))
        tail = np.concatenate([head[1:], [len(name)]]) - 1
        size = tail - head + 1
        fresh = np.where(size > 1, mix(name[head] + size.astype(U) * _LEN + U(2 * r + 1)), name[head])
        own = mark[head]
        start, end = start[head], end[tail]
        left = np.where(own, left[head], left[np.maximum(head - 1, 0)])
        right = np.where(own, right[tail], right[np.minimum(tail + 1, len(name) - 1)])
        name, mark = fresh, own
        # pairs of a left and a right symbol
        side = (mix(name + _SIDES[r]) >> U(63)).astype(bool)
        lhs, rhs = ~side & ~mark, side & ~mark
        pair = np.concatenate([lhs[:-1] & rhs[1:], [False]])
        second = np.concatenate([[False], pair[:-1]])
        after, before = np.concatenate([right[1:], right[-1:]]), np.concatenate([left[:1], left[:-1]])
        to = np.where(pair | (lhs & ~second), after, right)
        fro = np.where(rhs & ~second, before, left)
        joined = mix(name * _AT + np.concatenate([name[1:], name[:1]]) + U(2 * r + 2))
        end = np.where(pair, np.concatenate([end[1:], end[-1:]]), end)
        name = np.where(pair, joined, name)
        keep = ~second
        name, start, end, left, right, mark = (a[keep] for a in (name, start, end, fro, to, mark))
    return name, start, end, left, right, mark


def segments(w: Words, window: int, rounds: int = ROUNDS) -> Segments:
    """The windows of a batch, grouped by representative."""
    n = len(w.code)
    starts = n - window + 1
    if starts <= 0:
        z = np.zeros(0, np.int64)
        return Segments(z, z, z.astype(U), z.astype(U), z.astype(U))
    spans = Spans(w.code)
    _, at, to, left, right, mark = recompress(w.code, w.mark, rounds)
    key = mix(spans.of(left, right) + (at - left).astype(U) * _AT + (to - left).astype(U) * _TO)
    use = ~mark & (right - left <= window)
    at, left, right, key = at[use], left[use], right[use], key[use]
    # of each window: the symbols whose context it holds
    lo = np.concatenate([[0], np.cumsum(np.bincount(left, minlength=n))])[:starts]
    hi = np.cumsum(np.bincount(right, minlength=n + 1))[window : window + starts]
    best = np.full(starts, -1)
    length = hi - lo
    arg, step = np.arange(len(key)), 1
    while len(key) and step <= max(1, int(length.max())):
        p = np.flatnonzero((length >= step) & (length < 2 * step))
        a, b = arg[lo[p]], arg[hi[p] - step]
        best[p] = np.where(key[b] < key[a], b, a)
        if len(arg) <= step:
            break
        a, b = arg[:-step], arg[step:]
        arg, step = np.where(key[b] < key[a], b, a), 2 * step
    # windows with a separator in them don't exist
    inside = np.concatenate([[0], np.cumsum(w.mark)])
    valid = np.flatnonzero(inside[window:] == inside[:starts])
    hashes = spans.every(window)
    if not len(valid):
        return Segments(valid, valid, hashes[valid], hashes[valid], hashes)
    own = best[valid]
    head = np.concatenate([[True], (np.diff(valid) > 1) | (np.diff(own) != 0) | (own[1:] < 0)])
    first = valid[head]
    last = np.concatenate([valid[np.flatnonzero(head)[1:] - 1], valid[-1:]])
    rep = best[first]
    keys = np.where(rep >= 0, key[np.maximum(rep, 0)] if len(key) else U(0), mix(hashes[first] + _LEN))
    offset = np.where(rep >= 0, at[np.maximum(rep, 0)] - first if len(key) else 0, 0)
    name = mix(spans.of(first, last + window) + keys * _AT + (last - first).astype(U) * _LEN + offset.astype(U) * _TO)
    return Segments(first, last, keys, name, hashes)


def member(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array."""
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def singled(s: Segments, use: np.ndarray, crowded: np.ndarray) -> Segments:
    """The segments whose key is in ``use``; those of ``crowded`` keys are cut into single windows, each its own key.

    A window belongs to the same kind of segment wherever it occurs, so equal windows still meet.
    """
    many = member(s.key, crowded)
    plain = member(s.key, use) & ~many
    each = gather(s.first[many], (s.last - s.first + 1)[many]).astype(s.first.dtype)
    own = mix(s.hashes[each] + _TO)
    return Segments(np.concatenate([s.first[plain], each]), np.concatenate([s.last[plain], each]), np.concatenate([s.key[plain], own]), np.concatenate([s.name[plain], mix(own + _AT)]), s.hashes)


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(values, return_counts=True)


def deduplicate(docs: DataFrame, window: int = 35, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, chunks: int | None = None,
    crowded: tuple[int, int] | None = None) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``, and ``kept`` (the words left, joined by one space) if asked for."""
    chunks, buckets, shards, total = (chunks, chunks, chunks, 0) if chunks else chunks_for(docs, text_col)
    dense, dense_chunks = crowded or X.crowd(chunks, shards, total, SEGMENT_BYTES)
    # white space at the end keeps the documents of a batch apart
    dealt = X.deal(docs.select(F.col(id_col).alias("doc_id"), F.concat(F.coalesce(text_col, F.lit("")), F.lit(" ")).alias("text")), chunks)

    def parsed(t: pa.Table) -> list[tuple]:
        """Words and segments of a chunk, batch by batch; the texts stay where Arrow has them."""
        out = []
        for part in X.batches(t, BATCH):
            data, offsets = X.buffers(part)
            w = words_of(data, offsets)
            s = segments(w, window)
            # places within a batch are small numbers, and the codes are not needed any more
            w = w._replace(start=w.start.astype(np.int32), end=w.end.astype(np.int32), code=w.code[:0])
            out.append((part, data, offsets, w, s._replace(first=s.first.astype(np.int32), last=s.last.astype(np.int32))))
        return out

    def keys_of(batches: list[tuple]):
        return _counted(np.concatenate([np.zeros(0, U), *(s.key for *_, s in batches)]))

    def emit(t: pa.Table):
        keys, counts = keys_of(parsed(t))
        return keys, counts > 1, counts >= dense

    def chosen(batches: list[tuple], answers: pa.Table) -> list[Segments]:
        """Of each batch the segments of repeated keys; those of crowded keys window by window."""
        keys, _ = keys_of(batches)
        told, many = X.read_flags(answers, keys, buckets)
        return [singled(s, keys[told], keys[many]) for *_, s in batches]

    # per distinct segment: name, key, count, number of windows; then the hashes of the windows
    def offer(key, t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return X.sent(0, [])
        found = []
        for s in chosen(parsed(t), answers):
            name, at, counts = np.unique(s.name, return_index=True, return_counts=True)
            first, size = s.first[at], (s.last - s.first + 1)[at]
            found.append((name, s.key[at], counts, size, s.hashes[gather(first, size)]))
        if not found:
            return X.sent(0, [])
        name, own, counts, size, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
        begin = np.cumsum(size) - size
        distinct, at, inverse = np.unique(name, return_index=True, return_inverse=True)
        total = np.bincount(inverse, weights=counts).astype(np.uint32)
        own, size, begin = own[at], size[at], begin[at]
        order, cuts = X.by_bucket(own, shards)
        rows = []
        for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if j > i:
                o = order[i:j]
                body = np.array([j - i], "<u8").tobytes() + own[o].astype("<u8").tobytes() + total[o].astype("<u4").tobytes() + size[o].astype("<u4").tobytes()
                rows.append((b, body + hashes[gather(begin[o], size[o])].astype("<u8").tobytes()))
        return X.sent(key[0].as_py(), rows)

    def judge(t: pa.Table) -> pa.Table:
        own, weight, hashes, ends = [], [], [], []
        for body in t["body"].to_pylist():
            n = int(np.frombuffer(body, "<u8", 1)[0])
            k, c, s = np.frombuffer(body, "<u8", n, 8), np.frombuffer(body, "<u4", n, 8 + 8 * n), np.frombuffer(body, "<u4", n, 8 + 12 * n)
            own.append(np.repeat(k, s))
            weight.append(np.repeat(c, s))
            hashes.append(np.frombuffer(body, "<u8", offset=8 + 16 * n))
            ends.append(int(s.sum()))
        own, weight, hashes = np.concatenate(own), np.concatenate(weight).astype(np.int64), np.concatenate(hashes)
        order = np.lexsort((own, hashes))
        own, hashes = own[order], hashes[order]
        head = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (own[1:] != own[:-1])]))
        many = np.add.reduceat(weight[order], head) > 1
        told = np.zeros(len(order), bool)
        told[order] = np.repeat(many, np.diff(np.concatenate([head, [len(order)]])))
        at = np.cumsum(ends)
        return pa.table({"chunk": t["chunk"], "bucket": t["bucket"], "body": pa.array([np.packbits(told[j - n : j]).tobytes() for n, j in zip(ends, at, strict=True)], pa.binary())})

    def apply(key, t: pa.Table, both: pa.Table) -> pa.Table:
        out = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
        if not t.num_rows:
            return pa.table({k: pa.array([], pa.string() if k.startswith("kept") else pa.int64()) for k in out if keep_text or k != "kept"})
        stage = both["stage"].to_numpy()
        answers, verdicts = both.filter(pa.array(stage == 0)), both.filter(pa.array(stage == 1))
        batches = parsed(t)
        picked = chosen(batches, answers)
        # the distinct segments once more, in the order in which they were offered
        names, keys, sizes = [], [], []
        for s in picked:
            name, at = np.unique(s.name, return_index=True)
            names.append(name), keys.append(s.key[at]), sizes.append((s.last - s.first + 1)[at])
        name, at = np.unique(np.concatenate(names), return_index=True)
        own, size = np.concatenate(keys)[at], np.concatenate(sizes)[at]
        order, cuts = X.by_bucket(own, shards)
        base = np.cumsum(size) - size
        flags = np.zeros(int(size.sum()), bool)
        for b, body in zip(verdicts["bucket"].to_pylist(), verdicts["body"].to_pylist(), strict=True):
            o = order[cuts[b] : cuts[b + 1]]
            flags[gather(base[o], size[o])] = np.unpackbits(np.frombuffer(body, np.uint8), count=int(size[o].sum())).astype(bool)
        for (part, data, offsets, w, _), s in zip(batches, picked, strict=True):
            gone = np.zeros(len(w.mark) + 1, np.int64)
            if len(s.name):
                which = np.searchsorted(name, s.name)
                p = gather(s.first, size[which])[flags[gather(base[which], size[which])]]
                np.add.at(gone, p, 1)
                np.add.at(gone, p + window, -1)
            removed = np.cumsum(gone[:-1]) > 0
            keep = ~removed & ~w.mark
            # a kept word goes with the white space after it, made one blank
            level = np.zeros(len(data) + 1, np.int64)
            np.add.at(level, w.start[keep], 1)
            np.add.at(level, w.end[keep] + 1, -1)
            mask = np.cumsum(level[:-1]) > 0
            clean = data.copy()
            clean[w.end[keep]] = 0x20
            place = np.concatenate([[0], np.cumsum(mask)])[offsets]
            body = clean[mask].tobytes()
            lost = np.concatenate([[0], np.cumsum(removed & ~w.mark)])
            out["doc_id"] += part["doc_id"].to_pylist()
            out["n_words"] += w.count.tolist()
            out["n_removed"] += (lost[w.first + w.count] - lost[w.first]).tolist()
            for i, j in zip(place[:-1], place[1:], strict=True):
                text = body[i : max(i, j - 1)]
                out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
                if keep_text:
                    out["kept"].append(text.decode("utf-8", "replace"))
        return pa.table({k: pa.array(v, pa.string() if k.startswith("kept") else pa.int64()) for k, v in out.items() if keep_text or k != "kept"})

    answers = X.repeated(dealt, emit, buckets, dense_chunks)
    offers = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(offer, X.SENT)
    verdicts = offers.groupBy("bucket").applyInArrow(judge, X.SENT)
    both = answers.withColumn("stage", F.lit(0)).unionByName(verdicts.withColumn("stage", F.lit(1)))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if keep_text else "")
    return dealt.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(apply, schema)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"), 35, keep_text=False)


ORACLE = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
x AS (SELECT k, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT k, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT k, i FROM x WHERE s IN (SELECT s FROM x GROUP BY s HAVING count(*) > 1)),
c AS (SELECT DISTINCT k, i + j AS i FROM r, (SELECT unnest(range(0, 35)) AS j)),
u AS (SELECT k, generate_subscripts(w, 1) AS i, unnest(w) AS t FROM d),
g AS (SELECT k, count(*) AS n, string_agg(t, ' ' ORDER BY i) AS kept FROM u ANTI JOIN c USING (k, i) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (k)
"""
}
