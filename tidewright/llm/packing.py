"""Packing documents into fixed windows of tokens (operator 4).

Sum-of-squares online packing: a document's full windows are cut off first; its rest goes
to the fill level for which the sum of the squared counts of partially filled windows
grows least.  The counts are kept in a level array; new windows compete as level 0, and
ties go to the fullest window.  Each task packs what it reads and never holds
more than its open windows.  At the end of a task the windows still open are merged: the
emptiest are cut into the gaps of the fullest, until one is left, which is
written as sequences whose lengths are powers of two (these need no padding).

Results: null and empty texts have one token, the end mark; each id lies in exactly one piece;
offsets of a sequence are gapless from 0; repeated rows are packed each; other columns
are ignored; an empty table gives no rows.  Sequence ids hold the task's number in the high bits.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import thrifty

WINDOW = 1024
END = 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Letters for which both tokenizer libraries split alike whatever Unicode version they hold.
_OTHER = re.compile("[^\x00-ɏ‐-‧‰-⁞]|<\\|endoftext\\|>")
_LOADED: dict = {}


class Encoder:
    """Ids of ``tokenizers`` for a vocabulary file.

    A rank file of the same vocabulary lets ``tiktoken`` give the same ids in a
    quarter of the time; texts with letters outside the common blocks or with the
    special token's string always go to ``tokenizers``.
    """

    def __init__(self, path: str, ranks: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or _OTHER.search(text):
            found = self.slow.encode(text, add_special_tokens=False).ids
        else:
            found = self.fast.encode_ordinary(text)
        return np.array(found, "<u4")


def encoder(path: str, ranks: str | None = None, pattern: str | None = None) -> Encoder:
    key = (path, ranks)
    if key not in _LOADED:
        _LOADED[key] = Encoder(path, ranks, pattern)
    return _LOADED[key]


class Packer:
    """Online packing of one task; windows that are complete go to ``done``."""

    def __init__(self, window: int, first_id: int):
        self.window, self.next_id = window, first_id
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list] = [[] for _ in range(window + 1)]
        self.done: list[tuple] = []

    def _emit(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, at, ids))
            at += len(ids)
        self.next_id += 1

    def level(self, size: int) -> int:
        """The fill level that gets an item of this size."""
        c, w = self.count, self.window
        cost = 2 * (c[1 + size : w + 1] - c[1 : w - size + 1]) + 2
        cost[-1:] -= 1  # a full window is not counted any more
        cost[c[1 : w - size + 1] == 0] = np.iinfo(np.int64).max
        best = len(cost) - 1 - int(np.argmin(cost[::-1])) if len(cost) else -1
        return best + 1 if best >= 0 and cost[best] <= 2 * c[size] + 1 else 0

    def add(self, doc, ids: np.ndarray) -> None:
        total, w = len(ids), self.window
        full = total // w * w
        for i in range(0, full, w):
            self._emit([(doc, i, ids[i : i + w], total)])
        size = total - full
        if not size:
            return
        at = self.level(size)
        pieces = self.open[at].pop() if at else []
        if at:
            self.count[at] -= 1
        pieces.append((doc, full, ids[full:].copy(), total))
        if at + size == w:
            self._emit(pieces)
        else:
            self.open[at + size].append(pieces)
            self.count[at + size] += 1

    def close(self) -> None:
        """Merges the open windows by cutting the emptiest into the gaps of the fullest."""
        rest = [(h, p) for h in range(self.window - 1, 0, -1) for p in self.open[h]]
        lo, hi = 0, len(rest) - 1
        while lo < hi:
            level, pieces = rest[lo]
            gap = self.window - level
            while gap and lo < hi:
                donor = rest[hi][1]
                doc, start, ids, total = donor.pop()
                take = min(gap, len(ids))
                pieces.append((doc, start + len(ids) - take, ids[len(ids) - take :], total))
                if take < len(ids):
                    donor.append((doc, start, ids[: len(ids) - take], total))
                gap -= take
                if not donor:
                    hi -= 1
            if gap:
                rest[lo] = (self.window - gap, pieces)
                break
            self._emit(pieces)
            lo += 1
        if lo <= hi and lo < len(rest):
            self._powers(rest[lo][1])
        self.open = [[] for _ in range(self.window + 1)]
        self.count[:] = 0

    def _powers(self, pieces: list) -> None:
        left = sum(len(p[2]) for p in pieces)
        queue = list(reversed(pieces))
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            taken = []
            while size:
                doc, start, ids, total = queue.pop()
                n = min(size, len(ids))
                taken.append((doc, start, ids[:n], total))
                if n < len(ids):
                    queue.append((doc, start + n, ids[n:], total))
                size -= n
            self._emit(taken)


def pack(docs: DataFrame, tokenizer: str, *, ranks: str | None = None, pattern: str | None = None, window: int = WINDOW, end: int = END, id_col: str = "doc_id",
    text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece (``PIECES``), with its ``ids`` if asked for."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, ranks, pattern)
        packer = Packer(window, TaskContext.get().partitionId() << 36)

        def ready() -> pa.RecordBatch:
            columns = list(zip(*packer.done, strict=True))
            packer.done = []
            out = {name: pa.array(columns[i], pa.int64()) for i, name in enumerate(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))}
            if keep_ids:
                out["ids"] = pa.array([x.astype(np.int32) for x in columns[7]], pa.list_(pa.int32()))
            return pa.RecordBatch.from_pydict(out)

        for part in parts:
            for doc, text in zip(part["doc_id"].to_pylist(), part["text"], strict=True):
                packer.add(doc, np.append(enc.ids(text.as_py() or ""), np.uint32(end)))
                if len(packer.done) >= 20_000:
                    yield ready()
        packer.close()
        if packer.done:
            yield ready()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(thrifty(run), PIECES + (", ids array<int>" if keep_ids else ""))


def public_pack(docs: DataFrame, **more) -> DataFrame:
    """With the public byte-level vocabulary of 50k entries."""
    import public_tokenizers as P

    return pack(docs, P.path("byte_bpe_50k.json"), ranks=P.path("byte_bpe_50k.tiktoken"), pattern=P.PATTERN, **more)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return public_pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
