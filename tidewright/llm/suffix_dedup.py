"""Byte-level substring deduplication with suffix arrays (operator 8).

Each byte covered by a ``length``-byte string that also starts in a document with a
smaller id is removed; strings are judged on the input.

1. What can't repeat leaves first: the smallest hash among the ``GRAM``-byte strings of a window of ``length`` bytes is the
   window's key; neighbouring windows with one key form a segment.  Equal windows have equal keys, so a
   key that occurs in one document only proves its windows unique (packed exchange).
2. Each chunk sends its other distinct segments towards the bucket of the key, with the smallest document id the chunk has
   for each.  A key that very many chunks hold (a common phrase, with ever other text around it) would
   draw its segments into one bucket: its windows are dealt out one by one by their hash.
3. A bucket lays its segments out in shards of about ``SORTED`` bytes.  Each shard joins them to one string and sorts its suffixes by
   Larsson-Sadakane refinement: ranks by 8 bytes, then doubled, and only groups that are still
   tied are sorted again.  Kasai's algorithm gives the common prefixes of neighbours; where they reach ``length`` the windows are equal.
   Kasai's loop runs over all text places one after the other; here it runs in ``LANES`` stretches of the text side by side.
4. Windows of a key that the next shard holds as well are merged across shards by binary search among the sorted windows.
   Each distinct window ends up with its smallest document id.
5. Chunks find their answers by binary search and cut out what starts in an earlier document.

Results: null and empty texts have no bytes; a null id sorts after all others; rows with one id are
one document for the comparison and keep a result row each; other columns are ignored.
Windows are compared byte by byte.  Copies of a segment, which are sent once, are told by a 64-bit hash of the
content together with the key's, made by mixing functions (``hashing``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import exchange as X
from tidewright.llm.common import chunks_for
from tidewright.llm.hashing import U, byte_names, gather, mix, rolling
from tidewright.llm.substring_dedup import member

LENGTH, GRAM = 50, 20
BATCH = 1 << 20
SORTED = 2 << 20  # bytes of segments in one suffix array
LANES = 1 << 13
SEGMENT_BYTES = 20  # of text, for each segment that a chunk has
LAST = np.iinfo(np.int64).max
_ALONE, _NAMED = U(0xA24BAED4963EE407), U(0xC2B2AE3D27D4EB4F)


def words8(data: np.ndarray) -> np.ndarray:
    """At each byte, the eight from there on as one big-endian number; zeros after the end."""
    x = np.concatenate([data, np.zeros(8, np.uint8)]).astype(U)
    for step in (1, 2, 4):
        x = (x[:-step] << U(8 * step)) | x[step:]
    return x[: len(data)]


def suffix_array(data: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, to ``depth`` bytes at least (all, if None), and each suffix' rank.

    Equal ranks: not told apart.  A suffix that ends is less than its extensions.
    """
    n = len(data)
    depth = min(depth or n, n)
    # a word can't tell a missing byte from a zero; only the last seven suffixes have missing ones
    head_word = words8(data)
    tail = np.minimum(n - np.arange(n), 8)
    short = head_word[max(0, n - 7) :]
    plain = n > 7 and not np.isin(head_word[: n - 7], short).any() and len(np.unique(short)) == len(short)
    order = np.argsort(head_word) if plain else np.lexsort((tail, head_word))
    key, length = head_word[order], tail[order]
    head = np.concatenate([[True], (key[1:] != key[:-1]) | (length[1:] != length[:-1])]) if n else np.zeros(0, bool)
    first = np.flatnonzero(head)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.concatenate([first, [n]])))
    known = 8
    while known < depth:
        sizes = np.diff(np.concatenate([first, [n]]))
        tied = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places in the order
        if not len(tied):
            break
        at = order[tied]
        after = at + known
        follow = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        composite = (rank[at].astype(U) << U(32)) | follow.astype(U)
        o = np.argsort(composite)
        at, composite = at[o], composite[o]
        order[tied] = at
        fresh = np.concatenate([[True], composite[1:] != composite[:-1]])
        rank_of = tied[np.flatnonzero(fresh)]
        rank[at] = np.repeat(rank_of, np.diff(np.concatenate([np.flatnonzero(fresh), [len(at)]])))
        head[tied] = fresh
        first = np.flatnonzero(head)
        known *= 2
    return order, rank


def kasai(data: np.ndarray, order: np.ndarray, words: np.ndarray, most: int) -> np.ndarray:
    """The common prefix of each suffix with the one before it in the suffix array, up to ``most`` bytes.

    By text place the prefix shrinks by one at most from a place to the next (Kasai).  ``LANES`` stretches of the text
    keep this invariant side by side, and prefixes grow by eight bytes at a time.
    """
    n = len(data)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    lanes = min(n, LANES)
    step = -(-n // max(1, lanes))
    out = np.zeros(n, np.int32)
    at, have = np.arange(0, n, step), np.zeros(-(-n // max(1, step)), np.int64)
    for _ in range(step):
        if at[-1] >= n:
            at, have = at[:-1], have[:-1]
        to = before[at]
        have = np.where(to < 0, 0, np.maximum(have - 1, 0))
        room = np.minimum(most, n - np.maximum(at, to))
        grow = np.flatnonzero((to >= 0) & (have < room))
        while len(grow):
            off = have[grow]
            apart = words[at[grow] + off] ^ words[to[grow] + off]
            more = np.full(len(grow), 8)
            if (odd := np.flatnonzero(apart)).size:
                x = apart[odd]
                more[odd] = sum((x < U(1 << bits)).astype(np.int64) for bits in range(8, 64, 8))
            have[grow] = np.minimum(off + more, room[grow])
            grow = grow[(more == 8) & (have[grow] < room[grow])]
        out[at] = have
        at = at + 1
    return out[order]


def equal_windows(data: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows (their first bytes) in the order of the suffix array, and where each group of equal ones begins."""
    order, _ = suffix_array(data)
    words = words8(data)
    prefix = kasai(data, order, words, length)
    chosen = np.zeros(len(data), bool)
    chosen[windows] = True
    kept = np.flatnonzero(chosen[order])
    # between two windows lie suffixes of other places: their common prefix is the smallest on the way
    if not len(kept):
        return kept, kept
    least = np.minimum.reduceat(prefix[: kept[-1] + 1], np.concatenate([[0], kept[:-1] + 1]))
    return order[kept], np.flatnonzero(np.concatenate([[True], least[1:] < length]))


def windows_at(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The windows as fixed-length strings, which numpy orders byte by byte."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[at]).view(f"S{length}").ravel()


class Merger:
    """Smallest owners of equal windows over shards that are sorted one after the other.

    ``part`` says to which key (or group of keys) a window belongs; shards come in the order of their parts, so only
    the last part of a shard can go on in the next.
    """

    def __init__(self, length: int):
        self.length = length
        self.least: list[np.ndarray] = []  # of each distinct window
        self.known = 0
        self.open = -1
        self.text, self.number = np.zeros(0, f"S{length}"), np.zeros(0, np.int64)

    def add(self, data: np.ndarray, windows: np.ndarray, owner: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The number of each window's distinct string; its smallest owner so far is in ``least``."""
        order, head = equal_windows(data, windows, self.length)
        size = np.diff(np.concatenate([head, [len(order)]]))
        place = np.empty(len(data), np.int64)
        place[windows] = np.arange(len(windows))
        inside = place[order]
        number = self.known + np.arange(len(head))
        found = np.minimum.reduceat(owner[inside], head) if len(head) else owner[:0]
        of = part[inside[head]]
        first, last = int(part[0]), int(part[-1])
        if first == self.open:
            # merge: binary search of this shard's windows of the open part among those of the shards before
            mine = np.flatnonzero(of == first)
            strings = windows_at(data, order[head[mine]], self.length)
            spot = np.minimum(np.searchsorted(self.text, strings), max(0, len(self.text) - 1))
            met = self.text[spot] == strings if len(self.text) else np.zeros(len(mine), bool)
            number[mine[met]] = self.number[spot[met]]
        self.least.append(np.full(len(head), LAST))
        self.known += len(head)
        if len(self.least) > 1:
            self.least = [np.concatenate(self.least)]
        np.minimum.at(self.least[0], number, found)
        mine = np.flatnonzero(of == last)
        strings, numbers = windows_at(data, order[head[mine]], self.length), number[mine]
        if last == self.open:
            fresh = numbers >= self.known - len(head)
            strings, numbers = np.concatenate([self.text, strings[fresh]]), np.concatenate([self.number, numbers[fresh]])
            o = np.argsort(strings, kind="stable")
            strings, numbers = strings[o], numbers[o]
        self.open, self.text, self.number = last, strings, numbers
        told = np.empty(len(windows), np.int64)
        told[inside] = np.repeat(number, size)
        return told

    def owners(self) -> np.ndarray:
        return self.least[0] if self.least else np.zeros(0, np.int64)


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """first, last (inclusive) window, key and document of each segment."""
    n = len(data)
    starts = n - length + 1
    if starts <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(U), z
    low = rolling(data, gram)
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        low, have = np.minimum(low[:-have], low[have:]), have * 2
    if have < width:
        low = np.minimum(low[:starts], low[width - have : width - have + starts])
    # segments also end where a document does; of those, the ones that run into the next document go
    stops = np.concatenate([offsets[:-1], np.maximum(offsets[1:] - length + 1, offsets[:-1])])
    first = np.concatenate([np.flatnonzero(low[1:] != low[:-1]) + 1, stops[stops < starts]])
    first.sort()
    first = first[np.concatenate([[True], first[1:] != first[:-1]])]
    last = np.concatenate([first[1:], [starts]]) - 1
    doc = np.searchsorted(offsets, first, side="right") - 1
    use = last + length <= offsets[doc + 1]
    first, last, doc = first[use], last[use], doc[use]
    return first, last, mix(low[first]), doc


def singled(data: np.ndarray, first: np.ndarray, last: np.ndarray, key: np.ndarray, doc: np.ndarray, use: np.ndarray, crowded: np.ndarray, length: int):
    """first, last, key, name and document of the segments whose key is in ``use``; those of ``crowded`` keys are cut into single windows.

    A window's key tells whether it is crowded, so equal windows still meet.
    """
    many = member(key, crowded)
    plain = member(key, use) & ~many
    size = (last - first + 1)[many]
    each = gather(first[many], size)
    own = mix(rolling(data, length)[each] + _ALONE) if len(each) else key[:0]
    first, last, key, doc = (np.concatenate(x) for x in ((first[plain], each), (last[plain], each), (key[plain], own), (doc[plain], np.repeat(doc[many], size))))
    name = mix(byte_names(words8(data), first, last - first + length) + key * _NAMED) if len(first) else key
    return first, last, key, name, doc


def least_by(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sorted; the place of one; the smallest and the largest document of each; how often it occurs."""
    order = np.argsort(keys)
    k, d = keys[order], docs[order]
    if not len(k):
        return k, order, d, d, order
    head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[head], order[head], np.minimum.reduceat(d, head), np.maximum.reduceat(d, head), np.diff(np.concatenate([head, [len(k)]]))


def deduplicate(docs: DataFrame, length: int = LENGTH, *, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = True,
    chunks: int | None = None, crowded: tuple[int, int] | None = None, sorted_bytes: int = SORTED) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, and ``kept`` (binary) if asked for."""
    if length < gram or length < 8:
        raise ValueError("length must be at least gram and 8")
    chunks, buckets, shards, total = (chunks, chunks, chunks, 0) if chunks else chunks_for(docs, text_col)
    dense, dense_chunks = crowded or X.crowd(chunks, shards, total, SEGMENT_BYTES)
    dealt = X.deal(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text")), chunks)

    def ids_of(t: pa.Table) -> np.ndarray:
        return np.asarray(t["doc_id"].fill_null(LAST))

    def parsed(t: pa.Table) -> list[tuple]:
        """The segments of a chunk, batch by batch; the texts stay where Arrow has them."""
        out = []
        for part in X.batches(t, BATCH):
            data, offsets = X.buffers(part)
            first, last, key, doc = segments(data, offsets, length, gram)
            out.append((part, data, offsets, first, last, key, ids_of(part)[doc] if len(doc) else doc))
        return out

    def keys_of(batches: list[tuple]):
        """Distinct keys, their smallest and largest document, and how often they occur."""
        keys, ids = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for *_, key, doc in batches:
            keys.append(key), ids.append(doc)
        return least_by(np.concatenate(keys), np.concatenate(ids))

    def emit(t: pa.Table):
        keys, _, least, most, count = keys_of(parsed(t))
        return keys, least != most, count >= dense

    def chosen(batches: list[tuple], answers: pa.Table) -> list[tuple]:
        keys, *_ = keys_of(batches)
        told, many = X.read_flags(answers, keys, buckets)
        return [singled(data, first, last, own, doc, keys[told], keys[many], length) for _, data, _, first, last, own, doc in batches]

    def offer(key, t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return X.sent(0, [])
        batches = parsed(t)
        found, texts = [], []
        base = 0
        for (_, data, *_), (first, last, own, name, doc) in zip(batches, chosen(batches, answers), strict=True):
            names, at, least, *_ = least_by(name, doc)
            size = last[at] - first[at] + length
            found.append((names, own[at], least, size, base + np.cumsum(size) - size))
            texts.append(data[gather(first[at], size)])
            base += int(size.sum())
        name, own, doc, size, begin = (np.concatenate(x) for x in zip(*found, strict=True))
        text = np.concatenate(texts)
        name, at, doc, *_ = least_by(name, doc)
        own, size, begin = own[at], size[at], begin[at]
        order, cuts = X.by_bucket(own, shards)
        rows = []
        for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if j > i:
                o = order[i:j]
                body = np.array([j - i], "<u8").tobytes() + name[o].astype("<u8").tobytes() + doc[o].astype("<i8").tobytes() + size[o].astype("<u4").tobytes() + (own[o] & U(0xFFFF)).astype("<u2").tobytes()
                rows.append((b, body + text[gather(begin[o], size[o])].tobytes()))
        return X.sent(key[0].as_py(), rows)

    def judge(t: pa.Table) -> pa.Table:
        name, doc, size, part, text, counts = [], [], [], [], [], []
        for body in t["body"].to_pylist():
            n = int(np.frombuffer(body, "<u8", 1)[0])
            name.append(np.frombuffer(body, "<u8", n, 8))
            doc.append(np.frombuffer(body, "<i8", n, 8 + 8 * n))
            size.append(np.frombuffer(body, "<u4", n, 8 + 16 * n).astype(np.int64))
            part.append(np.frombuffer(body, "<u2", n, 8 + 20 * n).astype(np.int64))
            text.append(np.frombuffer(body, np.uint8, offset=8 + 22 * n))
            counts.append(n)
        name, doc, size, part, text = (np.concatenate(x) for x in (name, doc, size, part, text))
        begin = np.cumsum(size) - size
        distinct, at, doc, *_ = least_by(name, doc)
        begin, span, part = begin[at], size[at], part[at]
        wins = span - length + 1
        opens = np.cumsum(wins) - wins
        number = np.empty(int(wins.sum()), np.int64)
        # equal windows have equal keys, so shards in the order of the keys share one part of them at most
        order = np.argsort(part, kind="stable")
        shard = (np.cumsum(span[order]) - 1) // sorted_bytes
        merger = Merger(length)
        for s in np.split(order, np.flatnonzero(np.diff(shard)) + 1):
            local = text[gather(begin[s], span[s])]
            starts = np.cumsum(span[s]) - span[s]
            number[gather(opens[s], wins[s])] = merger.add(local, gather(starts, wins[s]), np.repeat(doc[s], wins[s]), np.repeat(part[s], wins[s]))
        least = merger.owners()[number]
        # runs of windows with one owner, by segment
        edge = np.concatenate([[True], least[1:] != least[:-1]])
        edge[opens] = True
        runs = np.flatnonzero(edge)
        lead = np.searchsorted(runs, opens)
        amount = np.diff(np.concatenate([lead, [len(runs)]]))
        where = np.searchsorted(distinct, name)
        ends, out = np.cumsum(counts), []
        for n, j in zip(counts, ends, strict=True):
            w = where[j - n : j]
            r = gather(lead[w], amount[w])
            out.append(amount[w].astype("<u4").tobytes() + (runs[r] - np.repeat(opens[w], amount[w])).astype("<u4").tobytes() + least[runs[r]].astype("<i8").tobytes())
        return pa.table({"chunk": t["chunk"], "bucket": t["bucket"], "body": pa.array(out, pa.binary())})

    def apply(key, t: pa.Table, both: pa.Table) -> pa.Table:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_bytes else [])]
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        out: dict[str, list] = {k: [] for k in names}
        batches = parsed(t) if t.num_rows else []
        if batches:
            stage = both["stage"].to_numpy()
            picked = chosen(batches, both.filter(pa.array(stage == 0)))
            verdicts = both.filter(pa.array(stage == 1))
            # the distinct segments in the order in which they were offered
            name, at = np.unique(np.concatenate([x[3] for x in picked]), return_index=True)
            own = np.concatenate([x[2] for x in picked])[at]
            order, cuts = X.by_bucket(own, shards)
            amount = np.zeros(len(name), np.int64)
            lead = np.zeros(len(name), np.int64)
            begins, leasts, base = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
            for b, body in zip(verdicts["bucket"].to_pylist(), verdicts["body"].to_pylist(), strict=True):
                o = order[cuts[b] : cuts[b + 1]]
                n = np.frombuffer(body, "<u4", len(o)).astype(np.int64)
                total = int(n.sum())
                amount[o], lead[o] = n, base + np.cumsum(n) - n
                begins.append(np.frombuffer(body, "<u4", total, 4 * len(o)).astype(np.int64))
                leasts.append(np.frombuffer(body, "<i8", total, 4 * (len(o) + total)))
                base += total
            begin, least = np.concatenate(begins), np.concatenate(leasts)
        for (part, data, offsets, *_), (first, last, _, segment, doc) in zip(batches, picked if batches else [], strict=True):
            gone = np.zeros(len(data) + 1, np.int64)
            if len(segment):
                which = np.searchsorted(name, segment)
                n = amount[which]
                r = gather(lead[which], n)
                start = begin[r]
                final = np.zeros(len(r), bool)
                final[np.cumsum(n) - 1] = True
                size = np.repeat(last - first + 1, n)
                end = np.where(final, size, np.concatenate([start[1:], start[-1:]]))  # exclusive
                take = least[r] < np.repeat(doc, n)
                origin = np.repeat(first, n)
                np.add.at(gone, (origin + start)[take], 1)
                np.add.at(gone, (origin + end - 1 + length)[take], -1)
            removed = np.cumsum(gone[:-1]) > 0
            lost = np.concatenate([[0], np.cumsum(removed)])[offsets]
            rise = removed.copy()
            rise[1:] &= ~removed[:-1]
            begins_doc = offsets[:-1][offsets[:-1] < len(data)]
            rise[begins_doc] = removed[begins_doc]
            spans = np.concatenate([[0], np.cumsum(rise)])[offsets]
            body = data[~removed].tobytes()
            place = offsets - lost
            out["doc_id"] += part["doc_id"].to_pylist()
            out["n_bytes"] += np.diff(offsets).tolist()
            out["n_removed"] += np.diff(lost).tolist()
            out["n_spans"] += np.diff(spans).tolist()
            kept = [body[i:j] for i, j in zip(place[:-1], place[1:], strict=True)]
            out["kept_sha256"] += [hashlib.sha256(x).hexdigest() for x in kept]
            if keep_bytes:
                out["kept"] += kept
        return pa.table({k: pa.array(v, kind) for (k, v), kind in zip(out.items(), kinds, strict=False)})

    answers = X.repeated(dealt, emit, buckets, dense_chunks)
    offers = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(offer, X.SENT)
    verdicts = offers.groupBy("bucket").applyInArrow(judge, X.SENT)
    both = answers.withColumn("stage", F.lit(0)).unionByName(verdicts.withColumn("stage", F.lit(1)))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_bytes else "")
    return dealt.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(apply, schema)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_bytes=False)


ORACLE = {
    "op8_suffix_dedup": """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(doc_id, 9223372036854775807) AS o, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT k, o, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT k, o, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100)),
m AS (SELECT s, min(o) AS least FROM x GROUP BY s),
r AS (SELECT k, i, i > lag(i) OVER (PARTITION BY k ORDER BY i) + 50 AS apart FROM x JOIN m USING (s) WHERE o > least),
e AS (SELECT k, i, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS run FROM r),
p AS (SELECT k, min(i) AS a, max(i) + 50 AS b FROM e GROUP BY k, run),
q AS (SELECT k, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS z FROM p),
g AS (SELECT k, count(*) AS n, sum(b - a)::BIGINT AS gone, max(b) AS last, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS head FROM q JOIN d USING (k) GROUP BY k)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN g USING (k)
"""
}
