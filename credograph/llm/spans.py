"""Words of a batch of texts as numpy arrays over Arrow's own UTF-8 buffer.

All separators used by the operators are ASCII, so words can be found on bytes. A word is
represented by a 64-bit polynomial hash of its bytes, taken for all words of a group at once
from one running sum. Nothing here keeps more than a few arrays of a group's size, and a group
is ``GROUP`` bytes of text or one document if that is longer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP = 1 << 20
#: Bytes that are hashed at once. Hashes don't depend on it; a worker holds 16 bytes for each.
SEGMENT = 1 << 17
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _lut(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: True for bytes that separate words.
BLANKS = _lut((0x20, 0x20), (0x09, 0x0D))
NON_ALNUM = _lut((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
NEWLINE = _lut((0x0A, 0x0A))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: int) -> np.ndarray:
    out = np.empty(SEGMENT + 1, np.uint64)
    out[0], n = 1, 1
    while n <= SEGMENT:
        k = min(n, SEGMENT + 1 - n)
        out[n : n + k] = out[:k] * np.uint64(pow(base, n, 1 << 64))
        n += k
    return out


_UP, _DOWN = _powers(_BASE), _powers(_BACK)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words under which every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]]; spans are ordered and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = max(int(np.searchsorted(ends, at + SEGMENT, "right")), i + 1)
        if int(ends[j - 1]) - at > SEGMENT:
            acc = 0
            for k in range(at, int(ends[i]), SEGMENT):
                block = data[k : min(k + SEGMENT, int(ends[i]))].astype(np.uint64) + np.uint64(1)
                part = int((block * _UP[: len(block)]).sum(dtype=np.uint64))
                acc = (acc + part * pow(_BASE, k - at, 1 << 64)) & _MASK
            out[i] = acc
        else:
            block = data[at : int(ends[j - 1])].astype(np.uint64) + np.uint64(1)
            run = np.zeros(len(block) + 1, np.uint64)
            np.cumsum(block * _UP[: len(block)], out=run[1:])
            s, e = starts[i:j] - at, ends[i:j] - at
            out[i:j] = (run[e] - run[s]) * _DOWN[s]
        i = j
    return mix(out)


def hash_words(words: list[bytes]) -> np.ndarray:
    """The hashes that ``Group`` gives to these words."""
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64) if words else ends
    return hash_spans(data, starts, ends)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` neighbours in ``h``; order within a run matters."""
    n = max(len(h) - k + 1, 0)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(_BASE) + h[i : i + n]
    return mix(out)


class Group:
    """Neighbouring documents of a batch: bytes, document bounds, and words on demand."""

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray):
        self.first, self.data, self.bounds = first, data, bounds
        self.n = len(bounds) - 1

    def spans(self, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words, and for each document the index of its first word."""
        if not len(self.data):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(self.n + 1, np.int64)
        inside = ~separators[self.data]
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        full = self.bounds[:-1] < self.bounds[1:]
        before[self.bounds[:-1][full]] = False
        after[self.bounds[1:][full] - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.bounds)

    def words(self, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes, and for each document the index of its first word."""
        starts, ends, first = self.spans(separators)
        return hash_spans(self.data, starts, ends), first


_calls = 0


def _hand_back() -> None:
    """Let the system have freed memory again; else a worker that is reused keeps its peak."""
    global _calls
    _calls += 1
    if _calls % 16 == 0:
        hand_back()


def hand_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def groups(column: pa.Array, lower: bool = False, limit: int = GROUP) -> Iterator[Group]:
    """``column`` (strings; null counts as empty) in groups of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1, i + 1)
        own = data[bounds[i] : bounds[j]]
        yield Group(i, LOWER[own] if lower else own, bounds[i : j + 1] - bounds[i])
        i = j
    _hand_back()
