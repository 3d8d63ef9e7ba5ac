"""64-bit hashing in numpy: words, spans of them, and spans of bytes.

A polynomial modulo 2**64 gives equal hashes to Thue-Morse strings of 1,024 symbols whatever its base.  Where equal
hashes are taken for equal contents, every symbol therefore goes through a mixing function together with its place
(``word_codes``, ``byte_names``), or every step of a doubling scheme mixes (``Spans``).  Polynomials are
left where a false equality costs time only (``rolling``).
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_ODD, _LEFT, _RIGHT, _SIZE = U(0xD6E8FEB86659FD93), U(0x9FB21C651E98DF25), U(0xA24BAED4963EE407), U(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (xor-shift-multiply); returns a new array."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=U) * _ODD)
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def _powers(which: str, n: int) -> np.ndarray:
    if len(_POWERS[which]) < n:
        steps = np.full(max(n, 1 << 16), U(_BASE if which == "up" else _INVERSE))
        steps[0] = 1
        _POWERS[which] = np.cumprod(steps)
    return _POWERS[which][:n]


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A polynomial hash of each run of ``size`` bytes; not for deciding that two runs are equal."""
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_CODES[data] * _powers("up", len(data)), out=sums[1:])
    return (sums[size:] - sums[:-size]) * _powers("down", len(data) + 1)[: len(data) - size + 1]


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting; ``np.unique`` hashes them, which takes ten times as long for 64-bit numbers."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def gather(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices first[i], first[i]+1, ... of all ranges, one after the other."""
    begin = np.cumsum(size) - size
    return np.repeat(first - begin, size) + np.arange(int(size.sum()))


def _sums(each: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of so many values."""
    total = np.zeros(len(each) + 1, U)
    np.cumsum(each, out=total[1:])
    end = np.cumsum(count)
    return total[end] - total[end - count]


def word_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word: the sum of a random function of (place in the word, byte)."""
    size = end - start
    place = gather(np.zeros(len(size), np.int64), size).astype(U)
    place <<= U(8)
    place |= data[gather(start, size)]
    return mix(_sums(mix((place + U(1)) * _ODD), size) + size.astype(U) * _SIZE)


def byte_names(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each run of 8 bytes or more; ``words`` has the eight bytes from each place on as a number."""
    count = (size + 7) >> 3
    place = gather(np.zeros(len(size), np.int64), count)
    at = np.repeat(start, count) + np.minimum(8 * place, np.repeat(size - 8, count))
    return mix(_sums(mix(words[at] + (place + 1).astype(U) * _ODD), count) + size.astype(U) * _SIZE)


def fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _LEFT
    x += b * _RIGHT
    x ^= x >> U(32)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(29)
    return x


class Spans:
    """Hashes of spans of a stream of 64-bit codes.

    A block of 2**k codes is named by its halves, a span by its length and the two largest blocks that cover it.
    """

    def __init__(self, codes: np.ndarray):
        self.codes, self.blocks, self.k = codes, codes, 0

    def _level(self, k: int) -> np.ndarray:
        if k < self.k:
            self.blocks, self.k = self.codes, 0
        while self.k < k:
            half = 1 << self.k
            self.blocks, self.k = fold(self.blocks[:-half], self.blocks[half:]), self.k + 1
        return self.blocks

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        out = np.zeros(len(size), U)
        level = np.frexp(size.astype(np.float64))[1] - 1
        for k in np.flatnonzero(np.bincount(level[size > 0])).tolist():
            p, blocks = np.flatnonzero((level == k) & (size > 0)), self._level(k)
            out[p] = fold(blocks[start[p]], blocks[end[p] - (1 << k)] + size[p].astype(U) * _SIZE)
        return out

    def every(self, size: int) -> np.ndarray:
        """Of each span of this size, in the order of their starts."""
        if size > len(self.codes):
            return np.zeros(0, U)
        k = size.bit_length() - 1
        blocks, rest = self._level(k), size - (1 << k)
        return fold(blocks[: len(blocks) - rest], blocks[rest:] + np.full(1, size, U) * _SIZE)
