"""Whole-batch word and shingle hashing with numpy, straight on Arrow's string buffers."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_rng = np.random.default_rng(20240501)
BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=U)
BASE = U(0x9E3779B97F4A7C15)
BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
STEP = _rng.integers(1, 2**64 - 1, 16, dtype=U) | U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII other than digits and letters separates words; bytes of other scripts belong to words.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    NOT_ALNUM[_a:_b] = False

#: 1 for ASCII letters, 2 for ASCII marks but the apostrophe.
KIND = np.zeros(256, np.uint8)
KIND[33:127] = 2
KIND[48:58] = KIND[39] = 0
KIND[65:91] = KIND[97:123] = 1

_pow: dict[int, np.ndarray] = {}


def _powers(base: U, n: int) -> np.ndarray:
    have = _pow.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, U)
        steps[0] = 1
        have = _pow[int(base)] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def lean(run: Callable) -> Callable:
    """The same function of batches; when its task is over, what it has freed goes back to the system, as Python workers
    outlive their tasks and several of them share an executor's memory."""

    @functools.wraps(run)
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return out


def lean_group(run: Callable) -> Callable:
    """The same for a function of one group's table."""

    @functools.wraps(run)
    def out(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            give_back()

    return out


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, col: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds about `most` bytes of text; a longer text is a part of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(col)), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    i, n = 0, len(sizes)
    while i < n:
        base = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(i, j - i)
        i = j


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1) of a string array; null counts as empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


class Words:
    """Words of a batch of texts: hash, first byte and end byte of each; first[d]:first[d + 1] are those of text d."""

    def __init__(self, texts: pa.Array, separators: np.ndarray = SPACE, lower: bool = True, split_marks: bool = False) -> None:
        raw, off = buffers(texts)
        self.data = data = LOWER[raw] if lower else raw
        inside = ~separators[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[off] = True
        if split_marks:  # ASCII letters and ASCII marks other than ' are words of their own where they meet
            kind = KIND[data]
            cut[1:-1] |= (kind[:-1] | kind[1:]) == 3
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | cut[:-1]))
        after = np.empty(len(data), bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | cut[1:])) + 1
        n = len(data)
        sums = np.zeros(n + 1, U)
        np.cumsum(BYTE[data] * _powers(BASE, n), out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * _powers(BASE_INV, n)[self.start] + (self.end - self.start).astype(U)) if n else np.zeros(0, U)
        self.first = np.searchsorted(self.start, off)
        self.off = off

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each position on (those that cross a text's end are meaningless)."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, U)
        out = np.zeros(n - k + 1, U)
        for j in range(k):
            out += self.hash[j : n - k + 1 + j] * STEP[j]
        return mix(out)

    def shingle_sets(self, k: int = 5) -> Iterator[np.ndarray]:
        """Per text the sorted distinct hashes of its k-word shingles; a shorter text is one shingle as a whole."""
        g = self.grams(k)
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            if b - a >= k:
                s = np.sort(g[a : b - k + 1])
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield s[keep]
            elif b > a:
                short = np.zeros(1, U)
                for j in range(b - a):
                    short += self.hash[a + j : a + j + 1] * STEP[j]
                yield mix(short + STEP[15:] * U(b - a))
            else:
                yield np.zeros(0, U)
