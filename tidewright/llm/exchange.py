"""A packed exchange: which fingerprints occur more than once in the corpus, and where.

Sending each fingerprint as a row costs 30 to 40 bytes.  Here every chunk of
documents sends one binary value per bucket: its distinct fingerprints, sorted.  A bucket
answers each chunk with one small value in the same order.  Repetition inside a chunk is
folded before anything is sent, so a fingerprint that occurs in a third of all
documents costs one entry per chunk.  What such a crowded key stands for is not gathered under the key: the operators
deal its windows out one by one.

Three Spark operations: grouped map over the chunks, grouped map over the buckets, and
a cogrouped map that brings the answers back to the chunks.  The chunk exchange of the
documents is one and the same plan in each, so Spark reuses it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import thrifty

SENT = "chunk int, bucket int, body binary"
KEY_BYTES = 5
Emit = Callable[[pa.Table], np.ndarray]


def pack(keys: np.ndarray, *flags: np.ndarray, width: int = KEY_BYTES) -> bytes:
    """Their number, the low bytes of each key, then the bits of each flag."""
    low = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return b"".join([np.array([len(keys)], "<u4").tobytes(), low.tobytes(), *(np.packbits(f).tobytes() for f in flags)])


def unpack(body: bytes, width: int = KEY_BYTES) -> tuple[np.ndarray, ...]:
    n = int(np.frombuffer(body, "<u4", 1)[0])
    keys = np.zeros((n, 8), np.uint8)
    keys[:, :width] = np.frombuffer(body, np.uint8, n * width, 4).reshape(-1, width)
    bits = np.frombuffer(body, np.uint8, offset=4 + n * width).reshape(-1, (n + 7) // 8)
    return keys.view("<u8").ravel(), *(np.unpackbits(x, count=n).astype(bool) for x in bits)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """From the high bits, so that it adds to the 40 low bits that are sent."""
    return ((keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of distinct sorted keys by bucket (stable), and where each bucket begins."""
    of = bucket_of(keys, buckets)
    order = np.argsort(of, kind="stable")
    return order, np.searchsorted(of[order], np.arange(buckets + 1))


def deal(docs: DataFrame, chunks: int, id_col: str = "doc_id") -> DataFrame:
    """Documents with the chunk they belong to; copies of an id stay together."""
    return docs.withColumn("chunk", F.pmod(F.xxhash64(F.lit(17), id_col), F.lit(chunks)).cast("int"))


def _body(told: np.ndarray, crowded: np.ndarray) -> bytes:
    return np.packbits(told).tobytes() + np.packbits(crowded).tobytes()


def crowd(chunks: int, shards: int, total_bytes: int, segment_bytes: int) -> tuple[int, int]:
    """What makes a key crowded: so many segments in a chunk, in more than so many chunks.

    The first is half of what a chunk sends to a shard on average, the second a quarter of the chunks: such a key
    alone would be an eighth of a shard.
    """
    return max(16, total_bytes // (2 * segment_bytes * chunks * shards)), max(8, chunks // 4)


def repeated(dealt: DataFrame, emit: Callable[[pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: int, crowded_from: int) -> DataFrame:
    """``(chunk, bucket, body)``: for each distinct key of the chunk, in order, whether it is repeated, and whether it is crowded.

    ``emit`` gives a chunk's distinct sorted keys, which of them already count as
    repeated within it, and which are dense in it; a key that occurs in two chunks is repeated as well, one that is dense in over
    ``crowded_from`` chunks is crowded.
    """

    def send(t: pa.Table) -> pa.Table:
        chunk = t["chunk"][0].as_py()
        keys, flags, dense = emit(t)
        order, cuts = by_bucket(keys, buckets)
        keys, flags, dense = keys[order], flags[order], dense[order]
        rows = [(b, pack(keys[i:j], flags[i:j], dense[i:j])) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
        return sent(chunk, rows)

    def answer(t: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in t["body"].to_pylist()]
        keys, flags, dense = (np.concatenate([p[i] for p in parts]) for i in range(3))
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        known = np.zeros(len(counts), bool)
        known[inverse[flags]] = True
        told, crowded = (known | (counts > 1))[inverse], (np.bincount(inverse[dense], minlength=len(counts)) > crowded_from)[inverse]
        ends = np.cumsum([len(p[0]) for p in parts])
        bodies = [_body(told[j - len(p[0]) : j], crowded[j - len(p[0]) : j]) for p, j in zip(parts, ends, strict=True)]
        return pa.table({"chunk": t["chunk"], "bucket": t["bucket"], "body": pa.array(bodies, pa.binary())})

    return dealt.groupBy("chunk").applyInArrow(thrifty(send), SENT).groupBy("bucket").applyInArrow(thrifty(answer), SENT)


def weights(dealt: DataFrame, emit: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], buckets: int, width: int = 4) -> DataFrame:
    """As ``repeated``, but the answer is a byte per key: over all chunks that hold it, the sum of 1, or of 2
    where the chunk flags it; at most 255.

    So 1 means a single unflagged occurrence.  Two keys that agree in bucket and
    low bytes share a weight; the weight is still one and the same wherever a key occurs.
    """

    def send(t: pa.Table) -> pa.Table:
        chunk = t["chunk"][0].as_py()
        keys, flags = emit(t)
        order, cuts = by_bucket(keys, buckets)
        keys, flags = keys[order], flags[order]
        rows = [(b, pack(keys[i:j], flags[i:j], width=width)) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
        return sent(chunk, rows)

    def answer(t: pa.Table) -> pa.Table:
        parts = [unpack(x, width) for x in t["body"].to_pylist()]
        keys, flags = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        _, inverse = np.unique(keys, return_inverse=True)
        told = np.minimum(np.bincount(inverse, weights=1 + flags), 255).astype(np.uint8)[inverse]
        ends = np.cumsum([len(p[0]) for p in parts])
        return pa.table({"chunk": t["chunk"], "bucket": t["bucket"], "body": pa.array([told[j - len(p[0]) : j].tobytes() for p, j in zip(parts, ends, strict=True)], pa.binary())})

    return dealt.groupBy("chunk").applyInArrow(thrifty(send), SENT).groupBy("bucket").applyInArrow(thrifty(answer), SENT)


def read_weights(answers: pa.Table, keys: np.ndarray, buckets: int) -> np.ndarray:
    out = np.zeros(len(keys), np.uint8)
    order, cuts = by_bucket(keys, buckets)
    for b, body in zip(answers["bucket"].to_pylist(), answers["body"].to_pylist(), strict=True):
        out[order[cuts[b] : cuts[b + 1]]] = np.frombuffer(body, np.uint8)
    return out


def sent(chunk: int, rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"chunk": pa.array([chunk] * len(rows), pa.int32()), "bucket": pa.array([b for b, _ in rows], pa.int32()), "body": pa.array([x for _, x in rows], pa.binary())})


def read_flags(answers: pa.Table, keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The answers of ``repeated`` in the order of the chunk's keys: which are repeated, which crowded."""
    told, crowded = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    order, cuts = by_bucket(keys, buckets)
    for b, body in zip(answers["bucket"].to_pylist(), answers["body"].to_pylist(), strict=True):
        i, j = cuts[b], cuts[b + 1]
        bits = np.frombuffer(body, np.uint8).reshape(2, -1)
        for to, row in zip((told, crowded), bits, strict=True):
            to[order[i:j]] = np.unpackbits(row, count=j - i)
    return told, crowded


def batches(t: pa.Table, least_bytes: int) -> Iterator[pa.Table]:
    """Slices of whole documents with about so many bytes of text."""
    if not t.num_rows:
        return
    size = np.cumsum(np.asarray(pc.binary_length(t["text"]).fill_null(0)), dtype=np.int64)
    first = 0
    while first < t.num_rows:
        done = size[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(size, done + least_bytes, side="right")))
        yield t.slice(first, last - first)
        first = last


def buffers(t: pa.Table, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of bytes, and where each begins and ends in it."""
    a = t[column].combine_chunks() if t[column].num_chunks != 1 else t[column].chunk(0)
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], a.type)
    kind = np.int64 if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type) else np.int32
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(a.buffers()[1], kind)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
