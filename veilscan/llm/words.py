"""Words and hashed n-grams of many texts at once, as numpy arrays over one byte buffer.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D in UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from veilscan.session import ship_by_value

ship_by_value(__name__)

#: Bytes of text worked on at once; a longer text is a piece of its own.
PIECE = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and their inverses."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        base, size = _BASES[which], max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            step = np.full(size, b, np.uint64)
            step[0] = 1
            both.append(np.multiply.accumulate(step))
        have = _POWERS[which] = (both[0], both[1])
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Final mixing of MurmurHash3."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """Hash of values[s:e] for each pair: differences of one running polynomial sum."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(values) + 1, which)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """Words of the texts of one piece: ``start``/``end`` in ``bytes``, ``doc`` row of each word,
    ``first`` word of each row (one longer than the rows)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.bytes = LOWER[data] if lower else data
        n = len(data)
        word = ~SPACE[data]
        head = np.zeros(n + 1, bool)
        head[offsets] = True
        self.start = np.flatnonzero(word & (np.concatenate(([True], ~word[:-1]))[:n] | head[:-1]))
        self.end = np.flatnonzero(word & (np.concatenate((~word[1:], [True]))[:n] | head[1:])) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.start, offsets)
        self.offsets = offsets

    def hashes(self) -> np.ndarray:
        return spans_hash(self.bytes, self.start, self.end, 0)

    def grams(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the n words from each word on, whether they lie in one text)."""
        m = len(hashes)
        if m < n:
            return np.zeros(m, np.uint64), np.zeros(m, bool)
        out, good = np.zeros(m, np.uint64), np.zeros(m, bool)
        at = np.arange(m - n + 1)
        out[: m - n + 1] = spans_hash(hashes, at, at + n, 1)
        good[: m - n + 1] = self.doc[: m - n + 1] == self.doc[n - 1 :]
        return out, good

    def word(self, i: int) -> bytes:
        return self.bytes[self.start[i] : self.end[i]].tobytes()


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of about ``size`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive slices values[first[i]:first[i + 1]] (0 where empty), along axis 0."""
    sums = np.concatenate((np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)))
    return sums[first[1:]] - sums[first[:-1]]
