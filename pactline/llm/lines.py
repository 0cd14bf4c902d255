"""Fuzzy line dedup: SimHash of normalised lines, join on pigeonhole blocks, edit similarity, one line kept a group.

A line's words (lower case, letters and digits only) are its normal form; equal normal forms are one node, so copies
never meet each other.  A node's SimHash has PRINT_BITS bits: its runs of four letters, each once however often it stands
there, counted with a hashed sign in PLACES hashed places, times a fixed random matrix of +1 and -1, by sign.  A wrong
letter so costs four of them and not a word, and long lines don't come to look alike by what every line has.  It is cut into BLOCKS blocks of BLOCK_BITS bits, whatever the number
of nodes, so that recall doesn't depend on the size of the corpus: two fingerprints that differ in a share p of their
bits agree in a whole block (pigeonhole) with chance 1 - (1 - (1 - p)^BLOCK_BITS)^BLOCKS.  Nodes that share a block are
candidates, unless the first 64 bits of their fingerprints differ in more than FIRST_BITS, or the first 192 in more than
MOST_BITS.  Blocks are dealt out by fragments of the key range, a few blocks at a time; a fragment compares the nodes
under a key whose sizes can be like, and passes on only groups of like ones, so that a wide bucket's chance members part:
the pairs of small groups, and the nodes of wider ones under a key of the group's own.  A candidate is a link when edit
distance <= (1 - similarity) x the longer form's length.

Lines of fewer than `min_words` words have no fingerprint.  With `short` (as the query and the pipeline ask) they are
nodes by their normal form, so that their exact copies are found, also those of scripts without spaces, where a line is
one word; without it they are no nodes and are always kept.  A line without a word has no normal form and is kept.

Defined results: null and empty texts have no lines to judge; equal rows (doc_id and text) are judged alike, so the
first occurrence stays in each of them; a null doc_id sorts first; empty tables give no rows; further columns pass
through `dedup` untouched.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import NOT_ALNUM, U, Words, _powers, buffers, lean, lean_group, mix, slices

BLOCKS, BLOCK_BITS, PLACES, GRAM_BITS = 32, 16, 512, 15
PRINT_BITS = BLOCKS * BLOCK_BITS
#: Blocks dealt out at a time, which bounds the shuffle files.
AT_ONCE = 4
#: Fingerprints further apart are no candidates, in the first 64 bits and in the first 192 (unrelated ones differ in half).
FIRST_BITS, MOST_BITS, MARKS = 18, 46, 3
FRAGMENT_ROWS = 800_000
#: Buckets up to this size are compared by shifting all of them at once, wider ones one by one.
NARROW = 400
#: Share of nodes still to be compared from which on comparing all of them in their order is the faster way.
DENSE = 0.1
MIN_WORDS = 5
ORDER = U(0xD1342543DE82EF95)
ORDER_INV = U(pow(0xD1342543DE82EF95, -1, 2**64))
#: Nodes of a part of a bucket that is compared across its components.
PART = 256
#: Nodes that a task remembers, to send a fingerprint or a text once.
REMEMBERED = 400_000


class Lines:
    """Lines with at least min_words words: text number, line number, node, first and end word."""

    def __init__(self, texts: pa.Array, min_words: int) -> None:
        self.words = w = Words(texts, NOT_ALNUM)
        breaks = np.cumsum(w.data == 10) if len(w.data) else np.zeros(0, np.int64)
        at = breaks[w.start]
        doc = np.repeat(np.arange(len(w.off) - 1), np.diff(w.first))
        before = np.where(w.off[:-1] > 0, breaks[np.maximum(w.off[:-1] - 1, 0)], 0) if len(w.data) else np.zeros(len(w.off) - 1, np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        end = np.append(first[1:], len(at))
        keep = end - first >= min_words
        self.first, self.end = first[keep], end[keep]
        self.doc = doc[self.first]
        self.line = at[self.first] - before[self.doc]
        sums = np.concatenate([np.zeros(1, U), np.cumsum(w.hash * _powers(ORDER, len(w.hash)))])
        self.node = mix((sums[self.end] - sums[self.first]) * _powers(ORDER_INV, len(w.hash) + 1)[self.first] + (self.end - self.first).astype(U)).astype(np.int64)

    def forms(self, which: np.ndarray) -> pa.StringArray:
        """Normal forms of the lines `which`, in order: their words, a space between two."""
        w = self.words
        n = self.end[which] - self.first[which]
        word = np.repeat(self.first[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
        last = np.zeros(len(word), bool)
        last[np.cumsum(n) - 1] = True
        data, edge = w.data.copy(), np.zeros(len(w.data) + 1, np.int8)
        edge[w.start[word]] = 1
        edge[w.end[word][last]] -= 1
        space = w.end[word][~last]
        data[space] = 32
        after = space + 1
        edge[after] -= 1
        off = np.concatenate([[0], np.cumsum(self.sizes()[which])]).astype(np.int32)
        return pa.StringArray.from_buffers(len(which), pa.py_buffer(off), pa.py_buffer(data[np.cumsum(edge[:-1], dtype=np.int8) > 0]))

    def sizes(self) -> np.ndarray:
        """Bytes of the normal forms."""
        w = self.words
        letters = np.concatenate([[0], np.cumsum(w.end - w.start)])
        return letters[self.end] - letters[self.first] + self.end - self.first - 1

    def prints(self, which: np.ndarray) -> np.ndarray:
        """(lines, PRINT_BITS / 64) fingerprints."""
        signs = np.random.default_rng(5).integers(0, 2, (PLACES, PRINT_BITS)).astype(np.float32) * 2 - 1
        out, forms = np.empty((len(which), PRINT_BITS // 64), np.int64), self.forms(which)
        for a in range(0, len(which), 512):
            text, off = buffers(forms[a : a + 512])
            n = len(off) - 1
            line = np.repeat(np.arange(n, dtype=np.int32), np.diff(off) + 2)  # each form between two spaces
            data = np.full(len(line), 32, np.uint8)
            inner = np.ones(len(line), bool)
            inner[off[:-1] + 2 * np.arange(n)] = inner[off[1:] + 2 * np.arange(n) + 1] = False
            data[inner] = text
            four = np.ndarray(max(0, len(data) - 3), ">u4", data, strides=(1,)).astype(U)
            gram = (mix(four) >> U(64 - GRAM_BITS)).astype(np.int32)
            own = line[:-3] == line[3:]  # none of two lines
            at = np.sort((line[:-3] << GRAM_BITS | gram)[own])
            at = at[np.append(True, at[1:] != at[:-1])[: len(at)]]  # each run of a line once, however often
            place = (at >> GRAM_BITS) * (2 * PLACES) + (at & (2 * PLACES - 1))
            counts = np.bincount(place, minlength=n * 2 * PLACES).reshape(n, 2, PLACES)
            counts = (counts[:, 1] - counts[:, 0]).astype(np.float32)  # one more bit is the sign
            out[a : a + 512] = np.packbits(counts @ signs > 0, axis=1).view(np.int64)
        return out


def blocks(prints: np.ndarray) -> np.ndarray:
    """(lines, BLOCKS) keys of the fingerprints' blocks, different for different blocks."""
    flat = np.ascontiguousarray(prints).view(np.uint16).reshape(len(prints), -1)
    return flat.astype(np.int64) | np.arange(BLOCKS) << BLOCK_BITS


#: A distinct line of a task: node, lines that have it, size, its first place (doc_id, whether that is known, line) and, where this
#: task holds it, its fingerprint.
DISTINCT = np.dtype([("node", "<i8"), ("n", "<i8"), ("size", "<i8"), ("known", "u1"), ("doc_id", "<i8"), ("line_no", "<i8"), ("printed", "u1"), ("print", "<u8", PRINT_BITS // 64)])
#: A line with a fingerprint.
PRINTED = np.dtype([("node", "<i8"), ("n", "<i8"), ("size", "<i8"), ("print", "<u8", PRINT_BITS // 64)])
#: Distinct lines that a task gathers before it passes them on, and lines of a packed row.
GATHERED, PACKED = 200_000, 16_384


def _packed(rows: np.ndarray, fragment: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Rows as bytes by fragment: the fragments there are, and the bytes of each."""
    order = np.argsort(fragment.astype(np.min_scalar_type(int(fragment.max(initial=0)))), kind="stable")  # few bytes are sorted by digits
    kinds, starts = np.unique(fragment[order], return_index=True)
    off = (np.append(starts, len(order)) * rows.dtype.itemsize).astype(np.int32)
    return pa.array(kinds.astype(np.int64)), pa.Array.from_buffers(pa.binary(), len(kinds), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(rows[order]).view(np.uint8))])


def _unpacked(column: pa.Array | pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    """The packed rows of a column of bytes."""
    parts = []
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(chunk):
            off = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[off[0] : off[-1]])
    return np.concatenate(parts or [np.zeros(0, np.uint8)]).view(kind)


def _merged(rows: np.ndarray) -> np.ndarray:
    """One row a node: all its lines, the first place, the fingerprint."""
    order = np.lexsort((rows["line_no"], rows["doc_id"], rows["known"], rows["node"]))
    rows = rows[order]
    starts = np.flatnonzero(np.append(True, rows["node"][1:] != rows["node"][:-1])[: len(rows)])
    out = rows[starts]
    if len(starts) < len(rows):
        out["n"] = np.add.reduceat(rows["n"], starts)
        held = np.flatnonzero(rows["printed"])
        of = np.searchsorted(starts, held, "right") - 1
        out["print"][of], out["printed"][of] = rows["print"][held], 1
    return out


def _occurrences(min_words: int, short: bool, fragments: int):
    """Documents -> a row a line (with its form where the task meets it first) and, with `fragment`, the task's distinct
    lines as bytes."""
    names = ["doc_id", "row", "line_no", "node", "form", "fragment", "packed"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        gathered: list[np.ndarray] = []

        def passed() -> pa.RecordBatch:
            rows = _merged(np.concatenate(gathered))
            gathered.clear()
            kinds, packed = _packed(rows, mix(rows["node"].view(U)) % U(fragments))
            blank = [pa.nulls(len(kinds), pa.int64())] * 4
            return pa.RecordBatch.from_arrays([*blank, pa.nulls(len(kinds), pa.string()), kinds, packed], names)

        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                lines = Lines(part.column("text"), 1 if short else min_words)
                if not len(lines.node):
                    continue
                printed = np.flatnonzero(lines.end - lines.first >= min_words)
                kinds, where = np.unique(lines.node[printed], return_index=True)
                where = printed[where]
                fresh = np.sort(np.array([i for k, i in zip(kinds.tolist(), where.tolist(), strict=True) if k not in sent], np.int64))
                if len(sent) > REMEMBERED:
                    sent.clear()
                sent.update(lines.node[fresh].tolist())
                has = np.zeros(len(lines.node), bool)
                has[fresh] = True
                ids = part.column("doc_id")
                rows = np.zeros(len(has), DISTINCT)
                rows["node"], rows["n"], rows["size"], rows["line_no"], rows["printed"] = lines.node, 1, lines.sizes(), lines.line, has
                rows["known"] = np.asarray(ids.is_valid())[lines.doc]
                rows["doc_id"] = np.asarray(pc.fill_null(ids, 0))[lines.doc]
                rows["print"][fresh] = lines.prints(fresh).view(U)
                gathered.append(_merged(rows))
                forms = lines.forms(fresh).take(pa.array(np.cumsum(has) - 1, mask=~has)) if len(fresh) else pa.nulls(len(has), pa.string())
                docs, keys = ids.take(pa.array(lines.doc)), part.column("row").take(pa.array(lines.doc))
                yield pa.RecordBatch.from_arrays([docs, keys, pa.array(lines.line.astype(np.int64)), pa.array(lines.node), forms, pa.nulls(len(has), pa.int64()), pa.nulls(len(has), pa.binary())], names)
                if sum(map(len, gathered)) > GATHERED:
                    yield passed()
        if gathered:
            yield passed()

    return run


@lean_group
def _nodes(table: pa.Table) -> pa.Table:
    """Of one fragment of the nodes: a row a node (lines that have it and the first of them) and those with fingerprints as
    bytes."""
    rows = _merged(_unpacked(table.column("packed"), DISTINCT))
    held = rows[rows["printed"] == 1]
    some = np.empty(len(held), PRINTED)
    for c in PRINTED.names:
        some[c] = held[c]
    _, packed = _packed(some, np.arange(len(some)) // PACKED)
    k, names = len(packed), ["node", "n", "doc_id", "line_no", "printed"]
    each = [pa.array(rows["node"]), pa.array(rows["n"]), pa.array(rows["doc_id"], mask=rows["known"] == 0), pa.array(rows["line_no"]), pa.nulls(len(rows), pa.binary())]
    return pa.concat_tables([pa.table(each, names), pa.table([*[pa.nulls(k, pa.int64())] * 4, packed], names)])


#: Columns of a fingerprint's first 64-bit words.
_PRINT = [f"p{i}" for i in range(MARKS)]
#: A posting: block and its value, size, number of lines (at most 2^32 - 1; it only ranks), node and the first words of its fingerprint.
POSTING = np.dtype([("key", "<u4"), ("size", "<u4"), ("n", "<u4"), ("node", "<i8"), ("marks", "<u8", MARKS)])


def _postings(fragments: int, first: int):
    """Packed lines with fingerprints -> postings of AT_ONCE blocks from `first` on, as bytes by fragment of the key range."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                some = _unpacked(batch.column("printed").slice(i, 1), PRINTED)
                key = blocks(some["print"])[:, first : first + AT_ONCE]
                frag = (((key - (first << BLOCK_BITS)) * fragments) // (AT_ONCE << BLOCK_BITS)).ravel()
                rows = np.empty((len(some), AT_ONCE), POSTING)
                rows["key"] = key
                rows["size"], rows["node"], rows["n"] = some["size"][:, None], some["node"][:, None], np.minimum(some["n"], 2**32 - 1)[:, None]
                rows["marks"] = some["print"][:, None, :MARKS]
                yield pa.RecordBatch.from_arrays([*_packed(rows.ravel(), frag)], ["fragment", "postings"])

    return run


class Like:
    """Which of some nodes, with the first MARKS words of their fingerprints, can be near copies."""

    def __init__(self, marks: list[np.ndarray], size: np.ndarray, percent: int) -> None:
        self.marks, self.size, self.percent = marks, size, percent

    def rest(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        apart = sum(np.bitwise_count(m[i] ^ m[j]).astype(np.int64) for m in self.marks)
        a, b = self.size[i].astype(np.int64), self.size[j].astype(np.int64)
        return (apart <= MOST_BITS) & (np.minimum(a, b) * 100 >= np.maximum(a, b) * self.percent)

    def pairs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each k whether i[k] and j[k] can."""
        m = self.marks[0]
        hit = np.bitwise_count(m[i] ^ m[j]) <= FIRST_BITS
        at = np.flatnonzero(hit)
        hit[at] = self.rest(i[at], j[at])
        return hit

    def ahead(self, reach: int, end: np.ndarray) -> np.ndarray:
        """Nodes that can with the one `reach` places on, where that comes before their `end`; all of them at once."""
        m = self.marks[0]
        at = np.flatnonzero(np.bitwise_count(m[:-reach] ^ m[reach:]) <= FIRST_BITS)
        at = at[at + reach < end[at]]
        return at[self.rest(at, at + reach)]

    def table(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For each of i and each of j whether they can; not with themselves."""
        m = self.marks[0]
        hit = np.bitwise_count(m[i][:, None] ^ m[j]) <= FIRST_BITS
        a, b = np.nonzero(hit)
        hit[a, b] = (i[a] != j[b]) & self.rest(i[a], j[b])
        return hit


def _wide(like: Like, start: int, n: int) -> np.ndarray:
    """Of one wide bucket: each node's group of like ones, as the place of one of them.  A first pass leaves out those
    that are like no other; a group then grows from one of its own, and only by those not yet reached."""
    step = max(1, min(64, (1 << 21) // n))
    some, others, todo = np.zeros(n, bool), np.arange(n), np.arange(n)
    while len(todo):
        part, todo = todo[:step], todo[step:]
        hit = like.table(part + start, others + start)
        some[part] |= hit.any(1)
        some[others[hit.any(0)]] = True
        others = others[some[others] | (others > part[-1])]
        todo = todo[~some[todo]]
    label, left = np.arange(n), np.flatnonzero(some)
    while len(left):
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            hit = like.table(front[:step] + start, left + start).any(0)
            label[left[hit]] = root
            front, left = np.concatenate([front[step:], left[hit]]), left[~hit]
    return label + start


def _groups(start: np.ndarray, count: np.ndarray, like: Like) -> np.ndarray:
    """For each node, sorted by bucket and size, the place of one that stands for its group of like ones in the bucket.
    A node meets those after it up to the size that can still be like it."""
    n_all = len(like.size)
    label, here = np.arange(n_all), np.arange(n_all)
    bucket = np.repeat(np.arange(len(count)), count) << 32
    end = np.searchsorted(bucket | like.size, bucket | np.minimum(like.size * 100 // like.percent, (1 << 32) - 1), "right")
    reach = np.maximum.reduceat(end - here, start) if len(start) else start
    for s, n in zip(start[reach > NARROW].tolist(), count[reach > NARROW].tolist(), strict=True):
        label[s : s + n] = _wide(like, s, n)
    end = np.where(np.repeat(reach > NARROW, count), 0, end)
    pairs, reach = [], 0
    while len(here):
        reach += 1
        here = here[here + reach < end[here]]
        met = like.ahead(reach, end) if len(here) > DENSE * n_all else here[like.pairs(here, here + reach)]
        met = met[label[met] != label[met + reach]]  # the others are joined already by pairs found before
        if len(met):
            pairs.append((met, met + reach))
            low = np.minimum(label[met], label[met + reach])
            label[met] = low
            label[met + reach] = np.minimum(label[met + reach], low)
            label = label[label]
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (label[:0], label[:0])
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _shared(percent: int):
    """Of one fragment: the groups of like nodes under a key.  Of one of at most common.SMALL nodes the pairs that can link,
    each once; of a wider one the nodes, with a key for the group that depends on its nodes only."""

    @lean_group
    def run(table: pa.Table) -> pa.Table:
        rows = _unpacked(table.column("postings"), POSTING)
        rows = rows[np.argsort(rows["key"].astype(U) << U(32) | rows["size"])]
        key, size, n, node, marks = (np.ascontiguousarray(rows[c]) for c in POSTING.names)
        del rows
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        like = Like([np.ascontiguousarray(m) for m in marks.T], size.astype(np.int64), percent)
        label = _groups(start, np.diff(np.append(start, len(key))), like)
        size_of = np.bincount(label, minlength=len(label))[label]
        few = np.flatnonzero((size_of > 1) & (size_of <= common.SMALL))
        few = few[np.argsort(label[few], kind="stable")]
        met = [(few[:0], few[:0])]
        for reach in range(1, common.SMALL):
            at = np.flatnonzero(label[few[:-reach]] == label[few[reach:]])
            at = at[like.rest(few[at], few[at + reach])]
            met.append((few[at], few[at + reach]))
        a, b = (node[np.concatenate(x)] for x in zip(*met, strict=True))
        a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        keep = np.flatnonzero(size_of > common.SMALL)
        keep = keep[np.argsort(label[keep], kind="stable")]
        first = np.flatnonzero(np.append(True, label[keep][1:] != label[keep][:-1])[: len(keep)])
        names = mix(np.add.reduceat(mix(node[keep].view(U)), first)) if len(first) else np.zeros(0, U)
        names = np.repeat(names, np.diff(np.append(first, len(keep))))
        columns = (names, node[keep], -n[keep].astype(np.int64), size[keep], *(m[keep] for m in like.marks))
        wide = ["key", "node", "rank", "size", *_PRINT]
        pairs = pa.table([pa.array(a), pa.array(b), *[pa.nulls(len(a), pa.int64())] * len(wide)], ["a", "b", *wide])
        return pa.concat_tables([pairs, pa.table([*[pa.nulls(len(keep), pa.int64())] * 2, *(pa.array(c.astype(np.int64)) for c in columns)], ["a", "b", *wide])])

    return run


def _within(bitmap_of):
    """Rows (node, form) whose node is in the bitmap."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = np.asarray(batch.column("node"))
            yield batch.filter(pa.array(common.bit_set(bitmap_of.value, node & ((1 << common.LOG2_BITS) - 1))))

    return run


def script_cost(a: list[str], b: list[str], reach: int = 6) -> int | None:
    """Characters changed by one way of turning the words a into b: equal words stay, and after a difference the two
    meet again within `reach` words.  An upper bound of the edit distance; None where they don't meet."""
    i = j = cost = 0
    n, m = len(a), len(b)
    while i < n and j < m:
        if a[i] == b[j]:
            i += 1
            j += 1
            continue
        for d in range(1, reach + 1):
            steps = [(d, x) for x in range(d + 1)] + [(x, d) for x in range(d)]
            meet = next(((x, y) for x, y in steps if i + x < n and j + y < m and a[i + x] == b[j + y] and a[i + x + 1 : i + x + 2] == b[j + y + 1 : j + y + 2]), None)
            if meet:
                break
        else:
            return None
        cost += max(sum(map(len, a[i : i + meet[0]])) + meet[0], sum(map(len, b[j : j + meet[1]])) + meet[1])
        i, j = i + meet[0], j + meet[1]
    rest = lambda w: sum(map(len, w)) + len(w)
    return cost + max(rest(a[i:]), rest(b[j:]))


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """Both without their common ends, the shorter one first; the edit distance stays."""
    lo = len(os.path.commonprefix((a, b)))
    a, b = a[lo:], b[lo:]
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[len(a) - mid :] == b[len(b) - mid :] else (lo, mid - 1)
    a, b = a[: len(a) - lo], b[: len(b) - lo]
    return (a, b) if len(a) <= len(b) else (b, a)


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of a and b is at most `most`: yes if a cheap edit script is; else common ends are cut
    off and the rest is compared bit-parallel, as long as the bound can still be met."""
    cheap = script_cost(a.split(" "), b.split(" "))
    if cheap is not None and cheap <= most:
        return True
    a, b = _trimmed(a, b)
    if len(b) <= most or len(b) - len(a) > most:
        return len(b) <= most
    below = (most - len(b) + len(a)) // 2  # so many edits reach no diagonal further from the first, and come back
    wide, turn = most + 1, len(a) - below
    eq: dict[str, int] = {}
    for i, c in enumerate(a, wide - 1 - below):
        eq[c] = eq.get(c, 0) | 1 << i
    full, top = (1 << wide) - 1, wide - 1
    up, down, score = full >> (top - below) << (top - below), 0, below
    worst = most + len(b) - turn
    for j, c in enumerate(b):  # a window on the rows, one further down each time
        x = eq.get(c, 0) >> j & full
        d = (((x & up) + up) & full ^ up) | x | down
        plus, minus = down | (full & ~(d | up)), up & d
        if j < turn:
            score += not d >> top
            if score > worst:
                return False
        else:
            at = top - 1 - j + turn
            score += (plus >> at & 1) - (minus >> at & 1)
        up, down = minus | (full & ~(d >> 1 | plus)), d >> 1 & plus
    return score <= most


#: Longest forms that are compared in bands, many pairs at once; beyond, one by one.
BANDED = 2000
#: Characters of the shorter forms, and words of the table of their places, that such a comparison takes at a time.
CHARS, TABLE = 1 << 19, 1 << 22
#: Fewer pairs are compared one by one.
FEW = 48
#: Pairs and bytes of forms that are judged together.
TOGETHER = 16_000, 16 << 20


def _codes(words: list[str], size: int) -> np.ndarray:
    """(size, words) characters, one word a column, filled up with 0; as few bytes each as they need."""
    out = np.frombuffer("".join(w.ljust(size, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), size).T
    top = out.max(initial=0)
    return np.ascontiguousarray(out, np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


def _banded(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """For each pair, the shorter one in `a`, whether the edit distance is at most `most`, which is no less than the
    lengths' difference and less than the longer one's length.  All pairs go through the table of distances together,
    column by column, and only through the diagonals that so few edits can reach and come back from: bits of as many
    words as these take say how a cell differs from the one above it (Myers, in Hyyro's bands)."""
    n = len(a)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    below, above = (most - lb + la) // 2, (most + lb - la) // 2
    words, rows, cols = int((below + above).max()) // 64 + 1, int(la.max()), int(lb.max())
    top = 64 * words - 1  # the lowest row of a column's window
    left, right = _codes(a, rows), _codes(b, cols)
    code = np.zeros(int(max(left.max(), right.max())) + 1, np.int64)
    code[left.ravel()] = 1
    code[0] = 0
    kinds = int(code.sum()) + 1  # 0 stands for those that no shorter form has
    code[code > 0] = np.arange(1, kinds)
    deep = max((cols - 1) // 64 + words, (top + rows) // 64) + 1
    if n > 1 and deep * n * kinds > TABLE:
        return np.concatenate([_banded(a[s], b[s], most[s]) for s in (slice(n // 2), slice(n // 2, n))])
    first, base = top - below, np.arange(n) * kinds
    place = np.zeros((deep, n * kinds), U)  # where in its form each character stands
    row, who = np.nonzero(left)
    bit = first[who] + row
    np.add.at(place.ravel(), (bit >> 6) * (n * kinds) + base[who] + code[left[row, who]], U(1) << (bit & 63).astype(U))
    look = code[right] + base
    lowest = 64 * np.arange(words)[:, None]  # of a word's bits
    up, down = _from(first - lowest), np.zeros((words, n), U)
    out, met_below = np.zeros(n, bool), np.zeros(n, U)
    ends = np.argsort(lb, kind="stable")
    of = np.searchsorted(lb[ends], np.arange(cols + 2)).tolist()
    for j in range(cols):
        k, shift = j >> 6, U(j & 63)
        if shift:
            x = place[k : k + words + 1].take(look[j], 1)
            x = x[:-1] >> shift | x[1:] << U(64) - shift
        else:
            x = place[k : k + words].take(look[j], 1)
        total = (x & up) + up
        if words > 1:
            over = total < up
            for w in range(1, words):
                total[w] += over[w - 1]
                over[w] |= over[w - 1] & (total[w] == 0)
        same = (total ^ up) | x | down
        plus, minus = down | ~(same | up), same & up
        met_below += same[-1] >> U(63)
        moved = same >> U(1)
        if words > 1:
            moved[:-1] |= same[1:] << U(63)
        up, down = minus | ~(moved | plus), moved & plus
        if of[j + 1] < of[j + 2]:  # from the window's last row but one up to the form's own
            done = ends[of[j + 1] : of[j + 2]]
            beyond = _from((la - lb - below + top)[done] - lowest)
            beyond[-1] &= U(2**63 - 1)
            rise = np.bitwise_count(up[:, done] & beyond).sum(0, dtype=np.int64) - np.bitwise_count(down[:, done] & beyond).sum(0, dtype=np.int64)
            out[done] = below[done] + j + 1 - met_below[done].astype(np.int64) - rise <= most[done]
    return out


def _from(bit: np.ndarray) -> np.ndarray:
    """Words whose bits are set from `bit` on."""
    return np.where(bit < 64, U(2**64 - 1) << np.clip(bit, 0, 63).astype(U), U(0))


def _word_by_word(a: str, b: str, most: int) -> bool:
    """Whether exchanging the words that differ, each for the one in its place, takes no more than `most` edits."""
    left, right = a.split(" "), b.split(" ")
    return len(left) == len(right) and sum(max(len(x), len(y)) for x, y in zip(left, right, strict=True) if x != y) <= most


def alike(a: list[str], b: list[str], similarity_percent: int) -> np.ndarray:
    """For each pair of forms whether their edit distance is at most (1 - similarity) x the longer one's length: yes if
    exchanging words in place is enough; the rest is compared in bands, without common ends."""
    out, banded = np.zeros(len(a), bool), []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        most = max(len(x), len(y)) * (100 - similarity_percent) // 100
        if _word_by_word(x, y, most):
            out[i] = True
            continue
        x, y = _trimmed(x, y)
        if len(y) - len(x) > most or len(y) <= most:
            out[i] = len(y) <= most
        elif len(y) > BANDED or most > len(x) // 5 + 64:  # or in many more words than the others of this length
            out[i] = within(x, y, most)
        else:
            banded.append((len(x), i, x, y, most))
    banded.sort()
    at = 0
    while at < len(banded):  # pairs of about the same length
        size = banded[at][0]
        like = (p for p in banded[at : at + max(64, CHARS // (size + 1))] if p[0] <= 1.4 * size + 32)
        _, which, x, y, most = zip(*like, strict=True)
        out[list(which)] = _banded(x, y, np.array(most)) if len(which) >= FEW else [within(*z) for z in zip(x, y, most, strict=True)]
        at += len(which)
    return out


def _verified(similarity_percent: int):
    """Rows (a, b, fa, fb) whose forms are alike, judged many at a time."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def judged() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            good = alike(rows.column("fa").to_pylist(), rows.column("fb").to_pylist(), similarity_percent)
            return pa.concat_batches(rows.select(["a", "b"]).filter(pa.array(good)).to_batches()) if good.any() else None

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= TOGETHER[0] or sum(x.nbytes for x in held) >= TOGETHER[1]:
                if out := judged():
                    yield out
        if held and (out := judged()):
            yield out

    return run


def _shares(lists: pa.ListArray) -> np.ndarray:
    """For each two of some lists whether they have a value in common."""
    of, values = np.asarray(pc.list_parent_indices(lists)), np.asarray(lists.flatten())
    kinds, which, n = np.unique(values, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(n > 1)
    out = np.zeros((len(lists), len(lists)), bool)
    for a in range(0, len(twice), 2048):
        some = twice[a : a + 2048]
        place = np.full(len(kinds), -1)
        place[some] = np.arange(len(some))
        hit = np.flatnonzero(place[which] >= 0)
        has = np.zeros((len(lists), len(some)), np.float32)
        has[of[hit], place[which[hit]]] = 1
        out |= has @ has.T > 0
    return out


def _across(similarity_percent: int):
    """Of two parts of a bucket, or one with itself: the links between nodes of different components.  The pairs are those
    of link_buckets' condition, each under the least key of both, but only links become rows."""

    @lean_group
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        low, high, part = (np.asarray(table.column(c)) for c in ("low", "high", "part"))
        node, comp = (np.asarray(table.column(c)) for c in ("node", "comp"))
        like = Like([np.asarray(table.column(c)).view(U) for c in _PRINT], np.asarray(table.column("size")), similarity_percent)
        left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
        met = comp[left][:, None] != comp[right]
        if low[:1] == high[:1]:
            met &= node[left][:, None] < node[right]
        i, j = np.nonzero(met)
        can = like.rest(left[i], right[j])
        i, j = i[can], j[can]
        if len(i):
            can = ~_shares(table.column("lower").combine_chunks())[np.ix_(left, right)][i, j]
            i, j = i[can], j[can]
        i, j = left[i], right[j]
        forms = table.column("form").to_pylist() if len(i) else []
        good = [np.zeros(0, bool)]
        for a in range(0, len(i), TOGETHER[0]):
            some = slice(a, a + TOGETHER[0])
            good.append(alike([forms[x] for x in i[some].tolist()], [forms[x] for x in j[some].tolist()], similarity_percent))
        hit = np.concatenate(good)
        a, b = node[i[hit]], node[j[hit]]
        return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def groups(docs: DataFrame, similarity_percent: int = 90, min_words: int = MIN_WORDS, short: bool = False) -> DataFrame:
    """docs (doc_id, text) -> a row per line that has a near copy: doc_id, row (hash of doc_id and text), line_no (from
    0), node (hash of the normal form), group_id (smallest node), n_lines of the group, removed (all but the first by
    doc_id and line_no)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    lines = "doc_id long, row long, line_no long, node long, form string, fragment long, packed binary"
    both = common.scratch(rows.mapInArrow(_occurrences(min_words, short, 4 * common.partitions(spark)), lines))
    found = both.where("fragment is null")
    each = both.where("fragment is not null").groupBy("fragment").applyInArrow(_nodes, "node long, n long, doc_id long, line_no long, printed binary")
    each = common.scratch(each)
    nodes, printed = each.where("node is not null"), common.scratch(each.where("printed is not null").select("printed"))  # it is read often
    fresh = found.where("form is not null")
    n_nodes = printed.agg(F.sum(F.length("printed"))).head()[0] or 0
    n_nodes //= PRINTED.itemsize
    fragments = max(1, min(12, n_nodes * AT_ONCE // 10_000), n_nodes * AT_ONCE // FRAGMENT_ROWS)
    marks = ", ".join(f"{c} long" for c in _PRINT)
    parts = []
    for first in range(0, BLOCKS, AT_ONCE):
        posted = printed.mapInArrow(_postings(fragments, first), "fragment long, postings binary")
        parts.append(common.scratch(posted.groupBy("fragment").applyInArrow(_shared(similarity_percent), f"a long, b long, key long, node long, rank long, size long, {marks}")))
        del posted
        common.release(spark)
    shared = functools.reduce(DataFrame.unionByName, parts)
    members = common.scratch(shared.where("key is not null").drop("a", "b").dropDuplicates(["key", "node"]))  # the same group under several blocks
    narrow = shared.where("a is not null").select("a", "b")
    known_forms: list[DataFrame] = []

    def texts(ends: DataFrame) -> DataFrame:
        bits = spark.sparkContext.broadcast(common.low_bitmap(ends, "node"))
        return common.scratch(fresh.select("node", "form").mapInArrow(_within(bits), "node long, form string").join(ends.distinct(), "node", "left_semi").dropDuplicates(["node"]))

    def forms_of(pairs: DataFrame) -> DataFrame:
        """Forms of the first pairs and of all members of wide buckets, which later pairs are of."""
        if not known_forms:
            known_forms.append(texts(pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(members.select("node"))))
        return known_forms[0]

    def verify(pairs: DataFrame) -> DataFrame:
        forms = forms_of(pairs)
        both = pairs.join(forms.select(F.col("node").alias("a"), F.col("form").alias("fa")), "a").join(forms.select(F.col("node").alias("b"), F.col("form").alias("fb")), "b")
        return both.select("a", "b", "fa", "fb").mapInArrow(_verified(similarity_percent), "a long, b long")

    def across(rest: DataFrame) -> DataFrame:
        """Each bucket is dealt into parts, and each two parts meet in a place of their own."""
        dealt = rest.withColumn("parts", F.ceil(F.col("n") / PART).cast("int")).withColumn("part", F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int"))
        dealt = dealt.select("key", "node", "comp", "size", *_PRINT, "part", "parts", F.filter("keys", lambda k: k < F.col("key")).alias("lower"))
        met = dealt.join(known_forms[0], "node").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).drop("parts")
        met = met.select("*", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
        return met.groupBy("key", "low", "high").applyInArrow(_across(similarity_percent), "a long, b long").distinct()

    apart = " + ".join(f"bit_count(x.{c} ^ y.{c})" for c in _PRINT)
    comps = common.link_buckets(members, verify, f"{common.like_sizes(similarity_percent)} and {apart} <= {MOST_BITS}", ("size", *_PRINT), None, common.SMALL, narrow, across=across)
    common.drop(*parts, *known_forms)
    n, c = nodes.select("node", "n", F.struct("doc_id", "line_no").alias("first")).alias("n"), comps.alias("c")
    placed = n.join(c, F.expr("n.node = c.node"), "left").where("n.n > 1 or c.comp is not null")  # the others are alone
    placed = common.scratch(placed.select("n.*", F.expr("coalesce(c.comp, n.node)").alias("group_id")))
    per = placed.groupBy("group_id").agg(F.sum("n").alias("n_lines"), F.min("first").alias("keep")).where("n_lines > 1")
    known = common.scratch(placed.select("node", "group_id").join(per, "group_id"))
    common.drop(members, each, printed)
    out = found.select("doc_id", "row", "line_no", "node").join(known, "node")
    same = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("line_no") == F.col("keep.line_no"))
    return out.select("doc_id", "row", "line_no", "node", "group_id", "n_lines", (~same).alias("removed"))


def dedup(docs: DataFrame, similarity_percent: int = 90, min_words: int = MIN_WORDS, short: bool = False) -> DataFrame:
    """docs with the removed lines taken out of text (n_chars follows where there is such a column); a document whose
    lines all go stays, with empty text."""
    removed = groups(docs, similarity_percent, min_words, short).where("removed")
    key, gone = common.unused(docs, "key"), common.unused(docs, "gone")
    lost = removed.groupBy(F.col("row").alias(key)).agg(F.collect_set("line_no").alias(gone))  # a document's own lines
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    keyed = keyed.join(common.scratch(lost).hint("merge"), key, "left")  # what goes grows with the corpus: never broadcast
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col(gone), i.cast("long")))
    intact = F.col(gone).isNull()
    changed = {"text": F.when(intact, F.col("text")).otherwise(F.array_join(kept, "\n"))}
    if "n_chars" in docs.columns:
        length = F.length(F.array_join(kept, "\n")).cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(intact, F.col("n_chars")).otherwise(length)
    return keyed.withColumns(changed).select(*docs.columns)
