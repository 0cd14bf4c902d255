"""Packing documents into training sequences by minimum bin slack.

A document's ids are cut into whole windows and one remainder.  What is packed is the histogram of remainder lengths:
at most capacity - 1 numbers, however many documents there are.  For the longest length left, a subset-sum over a
bitset (one Python integer, bit t set if t tokens can be filled) finds the multiset of the other lengths that comes
closest to the capacity; walking the stored bitsets backwards gives the count of each length.  The pattern found is
used as often as the counts allow, which uses up one length or more, so the plan has a bounded number of patterns.

Ranks that join pieces to plan places are made in two steps (counter inside a task, prefix sums over tasks), so no
length, however common, meets in one task.

Defined results: a null text counts as empty and is the end id alone; empty input gives no rows; repeated rows are
packed once each; a null doc_id stays null; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import Words, lean, slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, local long"
#: Words kept in a Python worker's cache (some 200 bytes each) before it starts anew.
CACHE_WORDS = 350_000


class Numbered(dict):
    """Gives each new key the next number."""

    def __missing__(self, key: int) -> int:
        at = self[key] = len(self)
        return at


class WordEncoder:
    """Ids of texts through a cache of ids of words between ASCII white space, by 64-bit hash of the word.  Exact for
    tokenizers that drop white space and never join across it, as the one named in the contract.  That one also lowers
    A-Z and parts letters from marks, so both are done before hashing, unless the texts could spell a special token.
    A tokenizer that gives other ids for the probes encodes whole texts instead."""

    PROBES = ("", "Don't STOP,don't x", "  two  blanks\tand\nlines\n", "a1b22 \u00e9lan'\u00c9LAN ... .!? #$", "leading end ", "\u03a3\u03af\u03c3 \u4f60\u597d")

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.by_word = True
        self._reset()
        probes = pa.array(self.PROBES)
        self.by_word = all(np.array_equal(x, y) for x, y in zip(self.encode(probes), self._whole(probes), strict=True))

    def _reset(self) -> None:
        self.known = Numbered()
        self.first, self.size, self.flat, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0

    def _learn(self, words: list[str]) -> None:
        at, n = len(self.known) - len(words), len(self.known)
        ids = [x.ids for x in self.tok.encode_batch(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(sizes.sum())
        while len(self.first) < n:
            self.first, self.size = np.concatenate([self.first, self.first]), np.concatenate([self.size, self.size])
        while len(self.flat) < self.used + total:
            self.flat = np.concatenate([self.flat, self.flat])
        self.size[at:n] = sizes
        self.first[at:n] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.used += total

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(x.ids, np.uint32) for x in self.tok.encode_batch(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of n + 1)."""
        if not self.by_word:
            return self._whole(texts)
        if len(self.known) > CACHE_WORDS:
            self._reset()
        special = pc.any(pc.match_substring(pc.fill_null(texts, ""), "<|")).as_py()
        w = Words(texts, lower=not special, split_marks=not special)
        kinds, where, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        had = len(self.known)
        at = np.fromiter(map(self.known.__getitem__, kinds.tolist()), np.int64, len(kinds))
        if len(self.known) > had:
            data, new = w.data.tobytes(), where[at >= had]  # numbered in the order met
            self._learn([data[a:b].decode() for a, b in zip(w.start[new].tolist(), w.end[new].tolist(), strict=True)])
        at = at[inverse]
        size = self.size[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.first[at] - ends[:-1], size)]
        return ids, ends[w.first]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each Python worker, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _cut(path: str, capacity: int, end_id: int, with_ids: bool):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, task = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in slices(batch, batch.schema.names[1], 1 << 21):
                flat, off = enc.encode(part.column(1))
                rows: list[list] = [[] for _ in range(8)]
                for d, doc in enumerate(part.column(0).to_pylist()):
                    ids = np.append(flat[off[d] : off[d + 1]], np.uint32(end_id))
                    for a in range(0, len(ids), capacity):
                        piece = ids[a : a + capacity]
                        n = len(piece)
                        for col, v in zip(rows, (doc, a, n, zlib.crc32(piece.astype("<u4").tobytes()), len(ids), task, int(seen[n]), piece.tolist() if with_ids else None), strict=True):
                            col.append(v)
                        seen[n] += 1
                yield _rows(rows, with_ids)

    return run


def _rows(rows: list[list], with_ids: bool) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.list_(pa.int32())]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "local", "ids"]
    n = 8 if with_ids else 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows[:n], kinds[:n], strict=True)], names[:n])


def fill(counts: dict[int, int], first: int, capacity: int) -> dict[int, int]:
    """The multiset {length: times} with `first` in it that fills capacity as nearly as counts allow."""
    room = capacity - first
    mask, bits = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for n in sorted(counts, reverse=True):
        most = min(counts[n] - (n == first), room // n)
        if most <= 0:
            continue
        steps.append((n, most, bits))
        k = 1
        while most:
            take = min(k, most)
            bits |= (bits << (n * take)) & mask
            most -= take
            k *= 2
        if bits >> room & 1:
            break
    goal, out = bits.bit_length() - 1, {first: 1}
    for n, most, before in reversed(steps):
        used = next(k for k in range(most + 1) if goal >= k * n and before >> (goal - k * n) & 1)
        if used:
            out[n] = out.get(n, 0) + used
            goal -= used * n
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(pattern {length: times}, repetitions)] that uses every count exactly."""
    left = {n: c for n, c in counts.items() if c > 0}
    out: list[tuple[dict[int, int], int]] = []
    while left:
        pattern = fill(left, max(left), capacity)
        times = min(left[n] // k for n, k in pattern.items())
        out.append((pattern, times))
        for n, k in pattern.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


def _places(patterns: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, times in a sequence, first sequence, offset), sorted by length and rank."""
    rank: dict[int, int] = {}
    rows, seq = [], 0
    for pattern, times in patterns:
        offset = 0
        for n in sorted(pattern, reverse=True):
            k = pattern[n]
            rows.append((n, rank.get(n, 0), k, seq, offset))
            rank[n] = rank.get(n, 0) + k * times
            offset += n * k
        seq += times
    return np.array(sorted(rows) or np.zeros((0, 5)), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """docs (doc_id, text) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and,
    with_ids, the ids themselves.  Sequences hold at most `capacity` ids."""
    schema = PIECES + (", ids array<int>" if with_ids else "")
    pieces = common.scratch(docs.select("doc_id", "text").mapInArrow(_cut(tokenizer_path, capacity, end_id, with_ids), schema))
    per = common.scratch(pieces.groupBy("task", "length").agg((F.max("local") + 1).alias("n")))
    hist = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = _places(plan(hist, capacity))
    keys = places[:, 0] << 48 | places[:, 1]
    from pyspark.sql import Window as W

    before = per.withColumn("base", F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1))).select("task", "length", F.coalesce("base", F.lit(0)).alias("base"))
    ranked = pieces.join(before, ["task", "length"]).withColumn("rank", F.col("base") + F.col("local"))
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    @lean
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = np.asarray(b.column("length")), np.asarray(b.column("rank"))
            row = places[np.searchsorted(keys, n << 48 | rank, "right") - 1]
            q = rank - row[:, 1]
            seq, off = row[:, 3] + q // row[:, 2], row[:, 4] + q % row[:, 2] * n
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(seq), pa.array(off)], [*cols, "sequence_id", "offset"])

    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    return ranked.select(*cols, "rank").mapInArrow(put, out)


def sequences(pieces: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """pack(with_ids=True) -> (sequence_id, ids, n_ids): the training sequences, padded to capacity unless they end at
    a power of two.  A group is bounded by capacity."""
    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    n = F.size(ids)
    full = (n.bitwiseAND(n - 1) == 0) | (n == capacity)
    return rows.select("sequence_id", F.when(full, ids).otherwise(F.concat(ids, F.array_repeat(F.lit(pad_id), capacity - n))).alias("ids"), n.alias("n_ids"))
