"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

The CGK walk reads a word sequence with a pointer: step i writes the word under it and moves on if a random bit of
(i, word) says so.  Two sequences a few edits apart fall into step again, so edit distance becomes Hamming distance,
and sampling coordinates of the walk is a locality-sensitive hash.  Windows of a document begin at every STRIDE-th
word; items are embedded from every word on, so one of them is aligned with a window of any leaked passage.  Items
of LONG words or more are walked for STEPS steps, about half as many words, of which SAMPLES are looked at: set for a
recall of 0.95 at least with a fifth of an item's words replaced, from the shortest such items on.  Shorter items are
sought by equal windows so small that a fifth of the words replaced, or one, leaves one of them whole.  Walks are evaluated for a whole batch at once and only as far as the last coordinate.  With several aligned
windows in a passage and several walks, recall is about 1 - (1 - p)^(windows * repeats) for the chance p that one window
survives the edits.  Edits inside most words of a passage at once leave no word to meet by, and are not found.

A candidate of LONG words or more goes on if the stretch of the document around it holds KEPT of the item's pairs of
neighbouring words: with a fifth of the words replaced nearly half of them are left even in the shortest such item,
while texts that only share the walk's few words have hardly any.  It is then verified: the least edit distance in characters between the item and any stretch of the document
around it (Sellers' alignment, bit-parallel) must be at most (1 - similarity) of the item's length.

Items are held in memory, `block` of them at a time (a bound); a larger set is worked off in blocks.

Defined results: items or texts without a word, null ones too, match nothing; an item without an id is sought like the
others and reported with a null item_id; a document that holds an item several
times gives one row with the best place (the earliest on ties); repeated rows give a row each; empty tables give no
rows; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import NOT_ALNUM, U, Words, lean, mix, slices

STRIDE = 2
REPEATS = 6
#: Least words of items that are walked, steps walked, coordinates sampled.
LONG, STEPS, SAMPLES = 16, 14, 7
#: Share of a long item's pairs of neighbouring words that a candidate's stretch of text has to hold.
KEPT = 0.3
MATCHES = "doc_id long, item_id long, first_word long, n_words long, distance long, similarity double"


class Walks:
    """`repeats` CGK walks with their sampled coordinates."""

    def __init__(self, steps: int, samples: int, repeats: int = REPEATS, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.steps = steps
        self.salt = rng.integers(1, 2**63, repeats, dtype=np.int64).astype(U)
        self.coords = [np.sort(rng.choice(steps, samples, replace=False)) for _ in range(repeats)]

    def keys(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
        """For each walk one key per window; a window reads words[start:end] and beyond its end a blank."""
        padded = np.append(words, U(0))
        for salt, coords in zip(self.salt, self.coords, strict=True):
            mixed = mix(padded ^ salt)
            mixed[-1] = 0
            at = starts.copy()
            key = np.full(len(starts), salt, U)
            for i in range(int(coords[-1]) + 1):
                here = mixed[np.minimum(at, ends)] if i else mixed[at]
                here = np.where(at < ends, here, U(0))
                if i in coords:
                    key = key * U(0x9E3779B97F4A7C15) + here
                at += (here >> U(i) & U(1)).astype(np.int64)
            yield mix(key)


def distance(item: str, text: str) -> tuple[int, int]:
    """(least edit distance of item to any substring of text, end of the first such substring); bit-parallel."""
    m = len(item)
    if not m:
        return 0, 0
    eq: dict[str, int] = {}
    for i, c in enumerate(item):
        eq[c] = eq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, where = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        x = eq.get(c, 0)
        d = (((x & up) + up) ^ up) | x | down
        plus, minus = down | (full & ~(d | up)), d & up
        score += bool(plus & top) - bool(minus & top)
        plus = plus << 1 & full
        up, down = (minus << 1 & full) | (full & ~(d | plus)), plus & d
        if score < best:
            best, where = score, j
    return best, where


class Items:
    """A block of benchmark items with the LSH keys of their windows: groups of (walks, stride, window size or None,
    [per walk: sorted keys, item, offset])."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float) -> None:
        self.ids = [r[0] for r in rows]
        w = Words(pc.utf8_lower(pa.array([r[1] for r in rows], pa.string())), NOT_ALNUM)
        data = w.data.tobytes()
        self.text = [" ".join(data[x:y].decode() for x, y in zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True)) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        self.words = np.diff(w.first)
        self.most = [int((1 - similarity) * len(t) + 1e-9) for t in self.text]
        self.pairs = [set(p) if m >= LONG else set() for p, m in zip(self._own(w), self.words.tolist(), strict=True)]
        self.needed = [int(KEPT * len(p)) for p in self.pairs]
        item = np.repeat(np.arange(len(rows)), self.words)
        offset = np.arange(len(w.hash)) - w.first[item]
        size = self.words[item]
        self.groups = []
        # a window starts where the walk, half as long in words on average, still ends inside the item
        chosen = [(Walks(STEPS, SAMPLES), STRIDE, None, (size >= LONG) & (offset <= np.maximum(STRIDE - 1, size - STEPS // 2)))]
        piece = np.maximum(1, size // (np.maximum(1, size // 5) + 1))
        for m in np.unique(piece[size < LONG]).tolist():  # equal windows have equal keys: one walk is enough
            chosen.append((Walks(2 * m, 2 * m, 1), 1, m, (size < LONG) & (piece == m) & (offset <= size - m)))
        for walks, stride, exact, use in chosen:
            if use.any():
                starts, found = np.flatnonzero(use), []
                for keys in walks.keys(w.hash, starts, starts + exact if exact else w.first[1:][item[use]]):
                    order = np.argsort(keys, kind="stable")
                    found.append((keys[order], item[use][order], offset[use][order]))
                self.groups.append((walks, stride, exact, found))


    @staticmethod
    def _own(w: Words) -> Iterator[list[int]]:
        """Each item's pairs of neighbouring words."""
        pairs = w.grams(2)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            yield pairs[a : max(a, b - 1)].tolist()


def _search(items: Items):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check = functools.lru_cache(1 << 14)(lambda k, text: distance(items.text[k], text))
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                yield _rows(part, check)

    def _rows(part: pa.RecordBatch, check) -> pa.RecordBatch:
        w = Words(pc.utf8_lower(pc.fill_null(part.column("text"), "")), NOT_ALNUM)
        doc_of = np.repeat(np.arange(part.num_rows), np.diff(w.first))
        inside = np.arange(len(w.hash)) - w.first[doc_of]
        cands: set[tuple[int, int, int]] = set()
        for walks, stride, exact, found in items.groups:
            starts = np.flatnonzero(inside % stride == 0)
            ends = w.first[1:][doc_of[starts]]
            if exact:
                ends = np.minimum(ends, starts + exact)
            for (known, item, offset), keys in zip(found, walks.keys(w.hash, starts, ends), strict=True):
                lo = np.searchsorted(known, keys, "left")
                for h in np.flatnonzero(known[np.minimum(lo, len(known) - 1)] == keys).tolist():
                    s = int(starts[h])
                    for q in range(int(lo[h]), int(np.searchsorted(known, keys[h], "right"))):
                        cands.add((int(doc_of[s]), int(item[q]), (s - int(offset[q])) // STRIDE))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        data, pairs = (w.data.tobytes(), w.grams(2)) if cands else (b"", None)
        for d, k, place in sorted(cands):
            m, most = int(items.words[k]), items.most[k]
            if best.get((d, k), (1, 0, 0))[0] == 0:
                continue  # an exact place is known
            slack = 6 + m // 5
            a = max(int(w.first[d]), place * STRIDE - slack)
            b = min(int(w.first[d + 1]), place * STRIDE + m + slack)
            if items.needed[k] and len(items.pairs[k].intersection(pairs[a : b - 1].tolist())) < items.needed[k]:
                continue
            text = " ".join(data[x:y].decode() for x, y in zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True))
            dist, end = check(k, text)
            if dist <= most and dist < best.get((d, k), (most + 1, 0, 0))[0]:
                last = a + text.count(" ", 0, end)
                best[d, k] = dist, max(int(w.first[d]), last - m + 1) - int(w.first[d]), m
        docs = part.column("doc_id").to_pylist()
        rows = [(docs[d], items.ids[k], first, m, dist, 1 - dist / len(items.text[k])) for (d, k), (dist, first, m) in sorted(best.items())]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.int64()] * 5 + [pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "first_word", "n_words", "distance", "similarity"])

    return run


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, block: int = 20_000) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> one row per document and item that it holds, with its place,
    edit distance in characters and similarity (1 - distance / item length, at least `similarity`)."""
    out = None
    for items in _blocks(benchmark, similarity, block):
        found = docs.select("doc_id", "text").mapInArrow(_search(items), MATCHES)
        out = found if out is None else out.unionByName(found)
    return out


def _blocks(benchmark: DataFrame, similarity: float, block: int) -> Iterator[Items]:
    """The items with a word, about `block` at a time; one empty block if there are none."""
    ids = benchmark.where(F.col("text").rlike("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]")).select("item_id", "text")
    n = max(1, -(-ids.count() // block))
    for k in range(n):
        part = ids if n == 1 else ids.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = [(r["item_id"], r["text"]) for r in part.collect()]
        yield Items(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])), similarity)


def _without(items: Items):
    search = _search(items)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column("text")], ["doc_id", "text"])
            keep = np.ones(batch.num_rows, bool)
            for found in search(iter([numbered])):
                keep[np.asarray(found.column("doc_id"))] = False
            yield batch.filter(pa.array(keep))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, block: int = 20_000) -> DataFrame:
    """The rows of docs that hold no item: each row is judged where it is read, without a join."""
    for items in _blocks(benchmark, similarity, block):
        docs = docs.mapInArrow(_without(items), docs.schema)
    return docs
