"""Substring dedup: paragraphs by MinHash banding, exact Jaccard of what collides, removals by components.

Paragraphs are of two kinds, both lists of words (lower case, letters and digits): lines of at least `min_words` words,
and windows of WINDOW words that begin at content-defined anchors, so that a passage is found wherever it stands inside
a line or across lines.  Anchors are the minima of every ANCHOR consecutive 3-word hashes: a passage of
ANCHOR + WINDOW words or more that two documents share has an anchor, and so a window, that is the same in both.

Lines have 8 bands of 3 MinHash values over their 5-word shingles (recall 0.998 at similarity 0.8, 0.9999 at 0.9); of
windows, of which a passage holds several, equal ones are sought.  Lines of different documents that collide in a band
are candidates; equal ones are one node and need no test, others are verified by their exact Jaccard similarity.  Bands are
dealt out by fragments of the hash range, each fragment finds the keys that several documents have, and stars instead
of pairs link large groups.  A component's first occurrence (by doc_id and place) stays; all others are removed, after
overlapping removals have been joined to spans.

Defined results: null and short texts have no paragraphs; copies inside one document alone are none of this operator's;
equal rows (doc_id and text) are judged alike; a null doc_id sorts first; empty tables give no rows; further columns
pass through `dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .words import NOT_ALNUM, U, Words, lean, lean_group, mix, slices

WINDOW, ANCHOR, SHINGLE = 32, 16, 5
MIN_WORDS = 32
BANDS, ROWS = 8, 3
REMEMBERED = 400_000
FRAGMENT_ROWS = 800_000
_rng = np.random.default_rng(77)
TURN = _rng.integers(1, 2**64 - 1, BANDS * ROWS + 1, dtype=U) | U(1)


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """min(x[i:i + n]) for every i that has n values."""
    width, out = 1, x
    while 2 * width <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(x) - n + 1], out[n - width :][: len(x) - n + 1]) if n > width else out


class Paragraphs:
    """Paragraphs of a batch: text number, first and end word, node, and band keys."""

    def __init__(self, texts: pa.Array, min_words: int) -> None:
        self.words = w = Words(texts, NOT_ALNUM)
        n = len(w.hash)
        doc = np.repeat(np.arange(len(w.off) - 1), np.diff(w.first))
        self.grams = g = w.grams(SHINGLE)
        # lines
        breaks = np.cumsum(w.data == 10)
        at = breaks[w.start] if n else np.zeros(0, np.int64)
        new = np.ones(n, bool)
        new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        end = np.append(first[1:], n) if n else first
        long = end - first >= max(min_words, SHINGLE)
        lf, le = first[long], end[long]
        # anchored windows
        a = w.grams(3)
        wf = np.zeros(0, np.int64)
        if len(a) >= ANCHOR and n >= WINDOW:
            low = _sliding_min(a, ANCHOR)
            at_low = np.zeros(len(a), bool)
            for j in range(ANCHOR):  # the minimum of any run of ANCHOR is an anchor
                at_low[j : j + len(low)] |= a[j : j + len(low)] == low
            wf = np.flatnonzero(at_low)
            wf = wf[(wf + WINDOW <= n)]
            wf = wf[doc[wf] == doc[wf + WINDOW - 1]]
        we = wf + WINDOW
        self.n_lines = len(lf)
        self.first, self.end = np.concatenate([lf, wf]), np.concatenate([le, we])
        self.doc = doc[self.first] if n else np.zeros(0, np.int64)
        # a node is the run of a paragraph's shingles, in order
        place = np.concatenate([[U(1)], np.multiply.accumulate(np.full(n, TURN[-1]))]) if n else np.ones(1, U)
        inverse = np.concatenate([[U(1)], np.multiply.accumulate(np.full(n, U(pow(int(TURN[-1]), -1, 2**64))))]) if n else np.ones(1, U)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(w.hash * place[:n])])
        self.node = mix((sums[self.end] - sums[self.first]) * inverse[self.first] + (self.end - self.first).astype(U)).astype(np.int64)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(number of the paragraph, band key) of all bands of all paragraphs."""
        g, k = self.grams, self.n_lines
        which, keys = [], []
        if k:
            seg = np.stack([self.first[:k], self.end[:k] - SHINGLE + 1], 1).ravel()
            pad = np.append(g, U(2**64 - 1))
            for b in range(BANDS):
                key = np.full(k, U(b + 1))
                for r in range(ROWS):
                    key = mix(key + np.minimum.reduceat(pad * TURN[b * ROWS + r], seg)[::2])
                which.append(np.arange(k))
                keys.append(key)
        if len(self.first) > k:
            which.append(np.arange(k, len(self.first)))
            keys.append(self.node[k:].astype(U))
        return (np.concatenate(which), np.concatenate(keys)) if keys else (np.zeros(0, np.int64), np.zeros(0, U))

    def shingles(self, i: int) -> np.ndarray:
        return np.unique(self.grams[self.first[i] : self.end[i] - SHINGLE + 1]).astype(np.int64)


_POSTINGS = ["fragment", "key", "node", "row", "size"]


def _postings(min_words: int, fragments: int):
    def pack(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, node, row, size = (np.concatenate(c) for c in zip(*held, strict=True))
        frag = ((key >> U(32)) * U(fragments) >> U(32)).astype(np.int64)
        order = np.argsort(frag, kind="stable")
        kinds, first = np.unique(frag[order], return_index=True)
        off = pa.array(np.append(first, len(key)), pa.int32())
        cols = [pa.ListArray.from_arrays(off, pa.array(c[order])) for c in (key.astype(np.int64), node, row, size)]
        return pa.RecordBatch.from_arrays([pa.array(kinds), *cols], _POSTINGS)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        met: dict[int, int | None] = {}  # node -> its document, or None once two documents have been sent
        for batch in batches:
            for part in slices(batch, "text"):
                p = Paragraphs(part.column("text"), min_words)
                row = np.asarray(part.column("row"))[p.doc]
                which, key = p.keys()
                # two documents of a node are enough to say that it is shared
                use = np.zeros(len(p.node), bool)
                for i, (x, r) in enumerate(zip(p.node.tolist(), row.tolist(), strict=True)):
                    had = met.get(x, 0)
                    if had == 0:
                        met[x], use[i] = r, True
                    elif had is not None and had != r:
                        met[x], use[i] = None, True
                use = use[which]
                which, key = which[use], key[use]
                held.append((key, p.node[which], (row[which] & 0x7FFFFFFF).astype(np.int32), (p.end - p.first)[which].astype(np.int32)))
                total += len(key)
                if len(met) > 2 * REMEMBERED:
                    met.clear()
                if total >= 500_000:
                    yield pack(held)
                    held, total = [], 0
        if total:
            yield pack(held)

    return run


@lean_group
def _shared(table: pa.Table) -> pa.Table:
    """Of one fragment: the nodes under keys that several documents have, with the number of documents seen."""
    key, node, row, size = (np.asarray(table.column(c).combine_chunks().flatten()) for c in _POSTINGS[1:])
    order = np.lexsort((row, node, key))
    key, node, row, size = key[order], node[order], row[order], size[order]
    if not len(key):
        return pa.table([pa.array([], pa.int64())] * 4, ["key", "node", "rank", "size"])
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    lo, hi = np.minimum.reduceat(row, starts), np.maximum.reduceat(row, starts)
    several = np.repeat(lo != hi, np.diff(np.append(starts, len(key))))
    key, node, size = key[several], node[several], size[several]
    if not len(key):
        return pa.table([pa.array([], pa.int64())] * 4, ["key", "node", "rank", "size"])
    new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
    count = np.diff(np.append(new, len(key)))
    return pa.table([pa.array(key[new]), pa.array(node[new]), pa.array(-count.astype(np.int64)), pa.array(size[new].astype(np.int64))], ["key", "node", "rank", "size"])


def _of_nodes(min_words: int, bitmap_of, sets: bool):
    """Paragraphs whose node is in the bitmap: their shingle sets (once a task), or all their places."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, sent = bitmap_of.value, set()
        for batch in batches:
            for part in slices(batch, "text"):
                p = Paragraphs(part.column("text"), min_words)
                hit = np.flatnonzero(common.bit_set(bitmap, p.node & ((1 << common.LOG2_BITS) - 1))) if len(p.node) else np.zeros(0, np.int64)
                if sets:
                    hit = np.array([i for i in hit.tolist() if p.node[i] not in sent and not sent.add(p.node[i])], np.int64)
                    if len(sent) > REMEMBERED:
                        sent.clear()
                if not len(hit):
                    continue
                if sets:
                    yield pa.RecordBatch.from_arrays([pa.array(p.node[hit]), pa.array([p.shingles(i) for i in hit.tolist()], pa.list_(pa.int64()))], ["node", "shingles"])
                else:
                    take = pa.array(p.doc[hit])
                    w, base = p.words, p.words.off[p.doc[hit]]
                    where = [p.first[hit] - w.first[p.doc[hit]], p.end[hit] - w.first[p.doc[hit]], w.start[p.first[hit]] - base, w.end[p.end[hit] - 1] - base]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("row").take(take), pa.array(p.node[hit]), *(pa.array(x.astype(np.int64)) for x in where)], _PLACES)

    return run


_PLACES = ["doc_id", "row", "node", "first_word", "end_word", "first_byte", "end_byte"]


def occurrences(docs: DataFrame, percent: int = 80, min_words: int = MIN_WORDS) -> DataFrame:
    """A row per paragraph that another document has too: doc_id, row, node, places, group_id, removed."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).head()["n"]
    fragments = max(1, min(64, size // 200_000), size // 25 // FRAGMENT_ROWS)
    posted = rows.mapInArrow(_postings(min_words, fragments), "fragment long, key array<long>, node array<long>, row array<int>, size array<int>")
    members = common.scratch(posted.groupBy("fragment").applyInArrow(_shared, "key long, node long, rank long, size long"))

    def verify(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
        bitmap = spark.sparkContext.broadcast(common.low_bitmap(ends, "node"))
        sets = common.scratch(rows.mapInArrow(_of_nodes(min_words, bitmap, True), "node long, shingles array<long>").join(ends.distinct(), "node", "left_semi").dropDuplicates(["node"]))
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        c = F.size(F.array_intersect("sa", "sb"))
        return both.where(100 * c >= percent * (F.size("sa") + F.size("sb") - c)).select("a", "b")

    def refine(rest: DataFrame) -> tuple[DataFrame, str]:
        """Buckets by prefix shingles, rarest first: lines about one much-shared passage meet no more than lines that
        can reach the similarity."""
        nodes = rest.select("node", "comp").distinct()
        bitmap = spark.sparkContext.broadcast(common.low_bitmap(nodes, "node"))
        sets = common.scratch(rows.mapInArrow(_of_nodes(min_words, bitmap, True), "node long, shingles array<long>").join(nodes, "node").dropDuplicates(["node"]))
        return common.rare_prefixes(sets.withColumnRenamed("shingles", "elements"), percent)

    comps = common.link_buckets(members.where("key <> node"), verify, common.like_sizes(percent), refine=refine)
    n, c = members.select("node").distinct().alias("n"), comps.alias("c")
    known = common.scratch(n.join(c, F.expr("n.node = c.node"), "left").select("n.node", F.expr("coalesce(c.comp, n.node)").alias("group_id")))
    bitmap = spark.sparkContext.broadcast(common.low_bitmap(known, "node"))
    places = rows.mapInArrow(_of_nodes(min_words, bitmap, False), "doc_id long, row long, node long, first_word long, end_word long, first_byte long, end_byte long")
    placed = common.scratch(places.join(known, "node"))
    per = placed.groupBy("group_id").agg(F.min("row").alias("lo"), F.max("row").alias("hi"), F.min(F.struct("doc_id", "row")).alias("keep")).where("lo <> hi").select("group_id", "keep")
    out = placed.join(common.scratch(per), "group_id")
    return out.select(*_PLACES, "group_id", (F.col("row") != F.col("keep.row")).alias("removed"))


def spans(docs: DataFrame, percent: int = 80, min_words: int = MIN_WORDS) -> DataFrame:
    """Joined spans: doc_id, row, removed, first_word, end_word, first_byte, end_byte, n_paragraphs, group_id (the
    smallest of the span's groups).  A stretch that any removed paragraph covers is removed."""
    o = occurrences(docs, percent, min_words)
    own = Window.partitionBy("row", "removed").orderBy("first_word", "end_word")  # one document's paragraphs
    reach = F.max("end_word").over(own.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.sum(F.when(reach.isNull() | (F.col("first_word") > reach), 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, 0))
    each = o.dropDuplicates(["row", "first_word", "end_word"]).withColumn("part", cut)
    return each.groupBy("doc_id", "row", "removed", "part").agg(*(f(c).alias(c) for f, c in ((F.min, "first_word"), (F.max, "end_word"), (F.min, "first_byte"), (F.max, "end_byte"), (F.min, "group_id"))), F.count(F.lit(1)).alias("n_paragraphs")).drop("part")


def dedup(docs: DataFrame, percent: int = 80, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the removed spans cut out of text."""
    key, gone = common.unused(docs, "key"), common.unused(docs, "gone")
    removed = spans(docs, percent, min_words).where("removed").groupBy(F.col("row").alias(key))
    lost = removed.agg(F.array_sort(F.collect_list(F.struct("first_byte", "end_byte"))).alias(gone))  # one document's spans
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text")).join(common.scratch(lost).hint("merge"), key, "left")
    raw = F.encode("text", "utf-8")
    start = F.struct(raw.substr(1, 0).alias("kept"), F.lit(0).cast("long").alias("at"))
    size = lambda a, x: F.greatest(x["first_byte"] - a["at"], F.lit(0)).cast("int")
    rest = lambda a, n: F.substring(raw, (a["at"] + 1).cast("int"), n)
    step = lambda a, x: F.struct(F.concat(a["kept"], rest(a, size(a, x))).alias("kept"), x["end_byte"].alias("at"))
    cut = F.aggregate(gone, start, step, lambda a: F.concat(a["kept"], rest(a, F.octet_length("text"))))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.decode(cut, "utf-8"))
    return keyed.withColumn("text", text).select(*docs.columns)
