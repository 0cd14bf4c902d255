"""N-gram Jaccard join of whole documents by vertical partitioning.

All shingles are put into one global order: rare ones by hash, then frequent ones by frequency.  Which ones are frequent
comes from counts over every document; a fixed number of the most frequent is kept (any order gives the same result,
a better one gives fewer candidates).  The order is cut into fragments:

1. candidates: two sets of similarity t or more share a shingle among the first n - ceil(t n) + 1 of each in the order.
   These prefixes are dealt out by fragment, and each fragment finds the shingles that several sets have;
2. bound: a set's shingles are counted in cells of the hash range, about three to a cell.  The lesser counts of two
   sets, summed over the cells, are at least their overlap, so pairs whose sum falls short part without their sets
   being read;
3. overlap: the sets of the pairs left are cut into fragments, every fragment counts the partial overlap of each pair
   by itself, and the partial counts are summed per pair.  A pair links when 100 * overlap >= percent * union.

Equal sets are one node from the start, and large groups are linked through stars (see common.link_buckets), so copies
are never paired.  Sets are recomputed from the text instead of being stored: that is cheaper than shuffling them.

Defined results: a text without words (null, empty) has an empty set, links with nothing and is its own component; a
text of fewer than k words is one shingle; repeated rows share a component; a null doc_id is ignored when the smallest
id is sought; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import U, Words, lean, lean_group, mix, slices

#: Frequent shingles put at the end of the order: a table of at most 4 MB.
MOST_FREQUENT, FREQUENT = 1 << 18, 8
#: Shingles held back before counting; postings of a fragment; fragments of the verification.
COUNTED, FRAGMENT_ROWS, SEGMENT_BITS = 2_500_000, 800_000, 3
SEGMENTS = 1 << SEGMENT_BITS
REMEMBERED = 400_000


def node_of(shingles: np.ndarray) -> int:
    """A set's own 64-bit hash."""
    return int(mix(np.array([mix(shingles.copy()).sum(dtype=U) + U(len(shingles))], U)).astype(np.int64)[0])


def cells(shingles: np.ndarray) -> bytes:
    """How many of a set's shingles lie in each of 2^b equal cells of the hash range, one byte a cell (255: or more)."""
    bits = max(0, (len(shingles) - 1).bit_length() - 2)
    at = (shingles >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(shingles), np.int64)
    return np.minimum(np.bincount(at, minlength=1 << bits), 255).astype(np.uint8).tobytes()


def most_shared(a: bytes, b: bytes, n_a: int, n_b: int) -> int:
    """An upper bound of the overlap of two sets by their cells; the finer cells are joined to match the coarser ones."""
    x, y = (np.frombuffer(c, np.uint8).astype(np.int64) for c in (a, b))
    unsaid = n_a - int(x.sum()) + n_b - int(y.sum())  # beyond 255 in a cell
    few = min(len(x), len(y))
    return int(np.minimum(x.reshape(few, -1).sum(1), y.reshape(few, -1).sum(1)).sum()) + unsaid


def _possible(percent: int):
    """Pairs (a, b, na, nb, ca, cb) -> (a, b, size of their union if they link at all) of those that can still link."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (np.asarray(batch.column(c)) for c in ("na", "nb"))
            sums = zip(*(batch.column(c).to_pylist() for c in ("ca", "cb", "na", "nb")), strict=True)
            most = np.fromiter((most_shared(*x) for x in sums), np.int64, len(na))
            keep = (100 + percent) * most >= percent * (na + nb)
            out = [batch.column("a"), batch.column("b"), pa.array(na + nb, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, ["a", "b", "both"]).filter(pa.array(keep))

    return run


def _survey(k: int):
    """Rows of documents (doc_id, row, n, node, cells) and of locally frequent shingles (shingle, count)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, sent = [], 0, set()
        for batch in batches:
            for part in slices(batch, "text"):
                n, node, cell = [], [], []
                for s in Words(part.column("text")).shingle_sets(k):
                    n.append(len(s))
                    node.append(node_of(s) if len(s) else None)
                    fresh = len(s) > 0 and node[-1] not in sent
                    cell.append(cells(s) if fresh else None)
                    if fresh:
                        sent.add(node[-1])
                        held.append(s)
                        size += len(s)
                yield _survey_rows(part.column("doc_id"), part.column("row"), n, node, cell)
                if size >= COUNTED:
                    yield _counts(held)
                    held, size = [], 0
                if len(sent) > REMEMBERED:
                    sent.clear()
        if held:
            yield _counts(held)

    return run


_SURVEY = ["doc_id", "row", "n", "node", "cells", "shingle", "count"]
_SURVEY_TYPE = "doc_id long, row long, n long, node long, cells binary, shingle long, count long"


def _survey_rows(docs: pa.Array, rows: pa.Array, n: list, node: list, cell: list) -> pa.RecordBatch:
    none = pa.nulls(len(n), pa.int64())
    own = [pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(cell, pa.binary())]
    return pa.RecordBatch.from_arrays([docs, rows, *own, none, none], _SURVEY)


def _counts(held: list[np.ndarray]) -> pa.RecordBatch:
    kinds, count = np.unique(np.concatenate(held), return_counts=True)
    often = count >= 2
    none = pa.nulls(int(often.sum()), pa.int64())
    found = [pa.array(kinds[often].astype(np.int64)), pa.array(count[often])]
    return pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(none), pa.binary()), *found], _SURVEY)


def _prefixes(k: int, percent: int, fragments: int, frequent_of):
    """Prefix postings as lists by fragment; those of frequent shingles go to fragments of their own, by node."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rank = frequent_of.value
        held, size, sent = [], 0, set()
        for batch in batches:
            for part in slices(batch, "text"):
                for s in Words(part.column("text")).shingle_sets(k):
                    if not len(s) or (node := node_of(s)) in sent:
                        continue
                    sent.add(node)
                    most = len(s) - -(-percent * len(s) // 100) + 1
                    place = np.searchsorted(frequent, s)
                    often = frequent[np.minimum(place, len(frequent) - 1)] == s if len(frequent) else np.zeros(len(s), bool)
                    rare = s[~often]
                    own = rare[:most]
                    tail = s[often][np.argsort(rank[place[often]], kind="stable")[: most - len(own)]] if len(own) < most else s[:0]
                    held.append((own, tail, node, len(s), len(rare)))
                    size += most
                if len(sent) > REMEMBERED:
                    sent.clear()
                if size >= 600_000:
                    yield _postings(held, fragments)
                    held, size = [], 0
        if held:
            yield _postings(held, fragments)

    return run


#: Lists: keys, the place of each one's set in the record's own lists of nodes, and its place in that set's order.
_POSTINGS = ["fragment", "key", "at", "pos", "node", "size", "rank"]
#: Fragments at least that the frequent shingles' postings are spread over, beside the others.
SALTS = 16


def _postings(held: list[tuple], fragments: int) -> pa.RecordBatch:
    node, size, rank = (np.array([x[i] for x in held], np.int64) for i in (2, 3, 4))
    cols = []
    for which in (0, 1):
        n = np.array([len(x[which]) for x in held])
        key, at = np.concatenate([x[which] for x in held]), np.repeat(np.arange(len(held)), n)
        pos = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n) + which * rank[at]
        frag = ((key >> U(32)) * U(fragments) >> U(32)).astype(np.int64) if which == 0 else fragments + node[at] % SALTS
        cols.append((frag, key, at, pos))
    frag, key, at, pos = (np.concatenate(c) for c in zip(*cols, strict=True))
    rows: list[list] = [[] for _ in _POSTINGS]
    order = np.argsort(frag, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(frag[order])) + 1):
        if len(part):
            sets, own = np.unique(at[part], return_inverse=True)
            for col, v in zip(rows, (frag[part[0]], key[part].astype(np.int64), own.astype(np.int32), pos[part].astype(np.int32), node[sets], size[sets].astype(np.int32), rank[sets].astype(np.int32)), strict=True):
                col.append(v)
    kinds = [pa.int64(), *(pa.list_(t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], _POSTINGS)


_MEMBERS = ["key", "node", "rank", "size", "pos"]


def _shared(fragments: int):
    """Postings of one fragment whose shingle more than one node has; of frequent shingles, all."""

    @lean_group
    def run(table: pa.Table) -> pa.Table:
        flat = {c: np.asarray(table.column(c).combine_chunks().flatten()) for c in _POSTINGS[1:]}
        n_keys = np.asarray(pc.list_value_length(table.column("key").combine_chunks()))
        n_sets = np.asarray(pc.list_value_length(table.column("node").combine_chunks()))
        at = flat["at"] + np.repeat(np.cumsum(n_sets) - n_sets, n_keys)
        key, pos = flat["key"], flat["pos"]
        node = flat["node"][at]
        order = np.lexsort((node, key))
        key, node, at, pos = key[order], node[order], at[order], pos[order]
        new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))[: len(key)]
        key, node, at, pos = key[new], node[new], at[new], pos[new]
        if table.column("fragment")[0].as_py() < fragments:
            same = np.zeros(len(key) + 1, bool)
            same[1:-1] = key[1:] == key[:-1]
            keep = same[1:] | same[:-1]
            key, node, at, pos = key[keep], node[keep], at[keep], pos[keep]
        return pa.table([pa.array(np.asarray(c, np.int64)) for c in (key, node, flat["rank"][at], flat["size"][at], pos)], _MEMBERS)

    return run


def _sets(k: int, bitmap_of):
    """The sets of nodes in the bitmap: a row (node, fragment, elements) for each of SEGMENTS fragments of the order."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, sent = bitmap_of.value, set()
        for batch in batches:
            for part in slices(batch, "text"):
                node, sets = [], []
                for s in Words(part.column("text")).shingle_sets(k):
                    if not len(s) or (x := node_of(s)) in sent:
                        continue
                    at = x & ((1 << common.LOG2_BITS) - 1)
                    if bitmap[at >> 3] >> (at & 7) & 1:
                        sent.add(x)
                        node.append(x)
                        sets.append(s)
                if len(sent) > REMEMBERED:
                    sent.clear()
                if node:
                    yield _cut(node, sets)

    return run


def _cut(node: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    place = owner * SEGMENTS + (flat >> U(64 - SEGMENT_BITS)).astype(np.int64)  # ascending: sets are sorted
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(flat)), pa.int32()), pa.array(flat.astype(np.int64)))
    whose = pa.array(np.array(node, np.int64)[owner[first]])
    return pa.RecordBatch.from_arrays([whose, pa.array((place[first] % SEGMENTS).astype(np.int32)), lists], ["node", "fragment", "elements"])


def _elements(k: int, bitmap_of, fragments: int):
    """All elements of the sets of nodes in the bitmap, as lists by fragment."""

    def pack(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        key, at = np.concatenate([s for _, s in held]), np.repeat(np.arange(len(held)), [len(s) for _, s in held])
        node = np.array([x for x, _ in held], np.int64)
        frag = ((key >> U(32)) * U(fragments) >> U(32)).astype(np.int64)
        order = np.argsort(frag, kind="stable")
        cuts = np.flatnonzero(np.diff(frag[order])) + 1
        off = pa.array(np.concatenate([[0], cuts, [len(key)]]), pa.int32())
        cols = [pa.ListArray.from_arrays(off, pa.array(c[order])) for c in (key.astype(np.int64), node[at])]
        return pa.RecordBatch.from_arrays([pa.array(frag[order][np.concatenate([[0], cuts])]), *cols], ["fragment", "key", "node"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, sent, held, size = bitmap_of.value, set(), [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                for s in Words(part.column("text")).shingle_sets(k):
                    if not len(s) or (x := node_of(s)) in sent:
                        continue
                    at = x & ((1 << common.LOG2_BITS) - 1)
                    if bitmap[at >> 3] >> (at & 7) & 1:
                        sent.add(x)
                        held.append((x, s))
                        size += len(s)
                if len(sent) > REMEMBERED:
                    sent.clear()
                if size >= 500_000:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)

    return run


@lean_group
def _counted(table: pa.Table) -> pa.Table:
    """Of one fragment: each node's elements that other nodes have too, with the number of nodes."""
    key, node = (np.asarray(table.column(c).combine_chunks().flatten()) for c in ("key", "node"))
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
    key, node = key[new], node[new]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    times = np.diff(np.append(starts, len(key)))
    n = np.repeat(times, times)
    key, node, n = key[n > 1], node[n > 1], n[n > 1]
    order = np.argsort(node, kind="stable")
    key, node, n = key[order], node[order], n[order]
    first = np.flatnonzero(np.append(True, node[1:] != node[:-1])[: len(node)])
    off = pa.array(np.append(first, len(node)), pa.int32())
    return pa.table([pa.array(node[first], pa.int64()), pa.ListArray.from_arrays(off, pa.array(key, pa.int64())), pa.ListArray.from_arrays(off, pa.array(n.astype(np.int64)))], ["node", "key", "n"])


def _rare_first(percent: int):
    """(node, comp, size, key, n) -> the shared elements in each set's prefix, with their places in its order."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places = [], []
            for size, key, n in zip(batch.column("size").to_pylist(), batch.column("key"), batch.column("n"), strict=True):
                key, n = (np.asarray(c.values) for c in (key, n))
                most, alone = size - -(-percent * size // 100) + 1, size - len(key)
                order = np.lexsort((key, n))[: max(0, most - alone)]
                keys.append(key[order])
                places.append(alone + np.arange(len(order)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("comp"), batch.column("size"), pa.array(keys, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int64()))], ["node", "comp", "size", "key", "pos"])

    return run


def components(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, node (hash of the set: documents with equal sets are one class) and
    component_id (smallest doc_id reachable by links)."""
    return _placed(docs, percent, k).select("doc_id", F.col("n").alias("n_shingles"), "node", F.coalesce("component_id", "doc_id").alias("component_id"))


def _placed(docs: DataFrame, percent: int, k: int) -> DataFrame:
    """A row per document: doc_id, row (hash of doc_id and text), n, node, comp (a node of its component; null without
    words), component_id."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    texts = docs.select("doc_id", "text")
    survey = common.scratch(rows.mapInArrow(_survey(k), _SURVEY_TYPE))
    often = survey.where("shingle is not null").groupBy("shingle").agg(F.sum("count").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).toArrow()
    keys, freq = np.asarray(often.column("shingle").combine_chunks()).astype(np.int64).astype(U), np.asarray(often.column("n").combine_chunks()).astype(np.int64)
    order = np.argsort(keys)
    frequent = spark.sparkContext.broadcast((keys[order], freq[order]))
    known = survey.where("shingle is null")
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head()["n"]
    fragments = max(1, min(12, total // 20_000), -(-total * (100 - percent) // 100 // FRAGMENT_ROWS))
    posted = texts.mapInArrow(_prefixes(k, percent, fragments, frequent), "fragment long, key array<long>, at array<int>, pos array<int>, node array<long>, size array<int>, rank array<int>")
    members = common.scratch(posted.groupBy("fragment").applyInArrow(_shared(fragments), "key long, node long, rank long, size long, pos long"))

    common.release(spark)

    sizes = known.where("node is not null").groupBy("node")
    sizes = common.scratch(sizes.agg(F.min("doc_id").alias("low"), F.max("n").alias("n"), F.max("cells").alias("c")))

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda x: sizes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("c").alias(f"c{x}")).hint("merge")
        wide = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ca", "cb")
        able = common.scratch(wide.mapInArrow(_possible(percent), "a long, b long, both long"))
        bitmap = spark.sparkContext.broadcast(common.low_bitmap(able.select(F.explode(F.array("a", "b")).alias("node")), "node"))
        cut = texts.select("text").mapInArrow(_sets(k, bitmap), "node long, fragment int, elements array<long>")
        cut = common.scratch(cut.dropDuplicates(["node", "fragment"]))
        of = lambda x: cut.select(F.col("node").alias(x), "fragment", F.col("elements").alias(f"e{x}")).hint("merge")  # noqa: E731  sets grow with the corpus: never broadcast
        each = able.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))))
        met = each.join(of("a"), ["a", "fragment"]).join(of("b"), ["b", "fragment"])
        partial = met.select("a", "b", "both", F.size(F.array_intersect("ea", "eb")).cast("long").alias("c"))
        total = partial.groupBy("a", "b", "both").agg(F.sum("c").alias("c"))
        out = common.scratch(total.where((100 + percent) * F.col("c") >= percent * F.col("both")).select("a", "b"))
        common.drop(able, cut)
        return out

    def refine(rest: DataFrame) -> tuple[DataFrame, str]:
        """Buckets by prefixes with the rarest first among these sets, counted fragment by fragment."""
        nodes = common.scratch(rest.select("node", "comp", "size").distinct())
        bitmap = spark.sparkContext.broadcast(common.low_bitmap(nodes, "node"))
        parts = max(1, nodes.agg(F.coalesce(F.sum("size"), F.lit(0))).head()[0] // FRAGMENT_ROWS)
        found = texts.select("text").mapInArrow(_elements(k, bitmap, parts), "fragment long, key array<long>, node array<long>").groupBy("fragment").applyInArrow(_counted, "node long, key array<long>, n array<long>")
        per = found.groupBy("node").agg(F.flatten(F.collect_list("key")).alias("key"), F.flatten(F.collect_list("n")).alias("n"))  # one set's elements
        sub = per.join(nodes.hint("merge"), "node").select("node", "comp", "size", "key", "n").mapInArrow(_rare_first(percent), "node long, comp long, size long, key array<long>, pos array<long>")
        return common.scratch(sub.select("node", "comp", "size", F.explode(F.arrays_zip("key", "pos")).alias("x")).select("x.key", "node", "comp", "size", "x.pos")), near

    # sizes, and what the two sets can still share from this shingle on in the order, were it their first common one
    room = f"least(x.size - x.pos, y.size - y.pos) * {100 + percent}L >= {percent}L * (x.size + y.size)"
    near = f"{common.like_sizes(percent)} and {room}"
    comps = common.link_buckets(members, verify, near, ("size", "pos"), refine)
    common.drop(members)
    n, c = sizes.alias("n"), comps.alias("c")
    placed = common.scratch(n.join(c, F.expr("n.node = c.node"), "left").select("n.node", "n.low", F.expr("coalesce(c.comp, n.node)").alias("comp")))
    smallest = placed.groupBy("comp").agg(F.min("low").alias("component_id"))
    ids = common.scratch(placed.join(smallest, "comp").select(F.col("node").alias("k"), "comp", "component_id"))
    common.drop(sizes, placed)
    return known.join(ids, known["node"] == ids["k"], "left").select("doc_id", "row", "n", "node", "comp", "component_id")


def keep_one(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """One row of each component: that of the smallest doc_id (nulls last), of repeated rows one.  Documents without
    words stay."""
    key = common.unused(docs, "row_key")
    placed = common.scratch(_placed(docs, percent, k).where("comp is not null").select("doc_id", F.col("row").alias(key), "comp"))
    first = placed.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key)).alias("f"))
    kept = common.scratch(first.select(f"f.{key}"))
    gone = common.scratch(placed.join(kept.hint("merge"), key, "left_anti").select(key).distinct())
    again = common.scratch(placed.join(kept.hint("merge"), key, "left_semi").groupBy(key).count().where("count > 1").select(key))
    common.drop(placed, kept)
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    out = keyed.join(gone.hint("merge"), key, "left_anti")  # what goes grows with the corpus: never broadcast
    if not again.isEmpty():  # rows that are equal in doc_id and text
        more = keyed.join(again.hint("merge"), key, "left_semi").dropDuplicates([key])
        out = out.join(again.hint("merge"), key, "left_anti").select(*keyed.columns).unionByName(more)
    return out.select(*docs.columns)
