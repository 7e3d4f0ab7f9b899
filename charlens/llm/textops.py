"""Vectorised word and n-gram work on Arrow text columns, used inside Spark tasks.

A batch of texts is handled as one byte buffer with offsets.  Work goes through
sub-blocks of about ``SUB_BYTES``; a longer text forms a sub-block of its own, so
whole texts are processed whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SUB_BYTES = 2 << 20
U = np.uint64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Mask over bytes: True for word bytes, False inside the given ranges."""
    ok = np.ones(256, dtype=bool)
    for lo, hi in ranges:
        ok[lo:hi + 1] = False
    return ok


#: words ``[^\x20\x09-\x0D]+``
NON_SPACE = _byte_class((0x20, 0x20), (0x09, 0x0D))
#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing A-Z)
ALNUM = _byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_POS = _rng.integers(1, 2**63, 1 << 16, dtype=np.uint64) * U(2) + U(1)
_WIN = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift multiply), elementwise."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def text_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls are empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays([c.cast(pa.large_string()) for c in col.chunks]) if col.num_chunks else pa.array([], pa.large_string())
    else:
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(bufs[2], np.uint8)[off[0]:off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def sub_blocks(off: np.ndarray, limit: int = SUB_BYTES, docs: int = 60000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes and at most ``docs`` texts."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = max(i + 1, min(j, i + docs, n))
        yield i, j
        i = j


class Words:
    """The words of one sub-block.

    ``start``/``end``: byte positions; ``bounds``: per text the first word index
    (one more entry than texts); ``hash``: 64-bit identity of each word.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, word: np.ndarray, lower: bool = True):
        self.off = off
        self.data = _LOWER[data] if lower else data
        n = len(data)
        flag = word[self.data]
        head = np.zeros(n + 1, bool)
        head[off] = True
        prev = np.empty(n, bool)
        if n:
            prev[0] = False
            prev[1:] = flag[:-1]
        prev &= ~head[:n]
        self.start = np.flatnonzero(flag & ~prev)
        nxt = np.empty(n, bool)
        if n:
            nxt[-1] = False
            nxt[:-1] = flag[1:]
        nxt &= ~head[1:]
        self.end = np.flatnonzero(flag & ~nxt) + 1
        self.bounds = np.searchsorted(self.start, off)
        self._flag = flag
        self._hash = None
        self._doc = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def doc(self) -> np.ndarray:
        """Text index of each word."""
        if self._doc is None:
            self._doc = np.repeat(np.arange(len(self.off) - 1), self.counts)
        return self._doc

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            if len(self.start) == 0:
                self._hash = np.zeros(0, np.uint64)
            else:
                s = int(self.start[0])
                pos = np.arange(s, len(self.data), dtype=np.int32 if len(self.data) < 2**31 else np.int64)
                pos -= np.repeat(self.start.astype(pos.dtype), np.diff(self.start, append=len(self.data)))
                pos &= 0xFFFF
                v = _BYTE[self.data[s:]]
                v *= _POS[pos]
                v[~self._flag[s:]] = 0
                h = np.add.reduceat(v, self.start - s)
                self._hash = mix(h + (self.end - self.start).astype(np.uint64) * U(0x9E3779B97F4A7C15))
        return self._hash

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word index, hash) of every run of ``k`` words inside one text."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        wh = self.hash
        h = np.full(n, U(k))
        for j in range(k):
            h += mix_step(wh[j:j + n], j)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1:])
        return at, mix(h[at])


def mix_step(h: np.ndarray, j: int) -> np.ndarray:
    """Contribution of the word at place ``j`` of a window."""
    return (h ^ _WIN[(j * 7) % 64]) * _WIN[j % 64]


def run_hash(words: Words, first: np.ndarray, length: int) -> np.ndarray:
    """Hash of ``length`` words from each index of ``first`` (as ``windows``)."""
    h = np.full(len(first), U(length))
    for j in range(length):
        h += mix_step(words.hash[first + j], j)
    return mix(h)


def run_lengths(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of each first value, length of its run) of a sorted array."""
    n = len(sorted_values)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    return first, np.diff(first, append=n)


def find(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index in ``sorted_keys`` of each wanted value, or -1."""
    if len(sorted_keys) == 0 or len(wanted) == 0:
        return np.full(len(wanted), -1, np.int64)
    at = np.searchsorted(sorted_keys, wanted)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == wanted, at, -1)


def cover(n: int, first: np.ndarray, length) -> np.ndarray:
    """Mask over ``n`` places: inside any run ``[first, first + length)``."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, first, 1)
    np.add.at(delta, first + length, -1)
    return np.cumsum(delta[:n]) > 0
