"""Hard-negative mining with product quantisation.

Components become integers, floor(256 x).  A vector is cut into sub-vectors; each is coded by the nearest of 256 integer
centroids, and the length of what is left over, the residual, is stored beside the code.  An anchor's score with a row is
then the sum of table entries of the row's codes, give or take the sum over sub-vectors of the anchor's length times the
residual's (Cauchy-Schwarz).  Rows whose interval can't reach the first `positives` of the anchor's label, or can't fall
into the first `depth` of a positive's window, are filtered out; all others are scored exactly in integers.  So results
don't depend on the codebook, which is fitted on at most SAMPLE rows.

The anchors, a stated set of queries, meet all rows in blocks: rows are dealt into blocks by a hash of their number, not by
label, and each block gives its own first ones, which a ranking merges.  No block grows with the table, and nothing but
the sample and the codebook goes through the driver.

Defined results: rows with a null label, a null vector or a component that is null, NaN or infinite take no part; a shorter
vector counts as padded with zeros; a null vec_id is no anchor and comes last among ties; of repeated rows each is a row
of its own, so a copy of an anchor can be its positive; scores beyond 2^53 either way count as that; an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, words

SCALE, EXACT = 256, 1 << 53
SAMPLE, CENTROIDS, ROUNDS, MOST_SUBS = 4096, 256, 6, 64
ROWS_A_BLOCK, ANCHORS_A_BLOCK, TILE_BYTES = 1 << 17, 4096, 1 << 23
FOUND = "anchor long, slot int, row long, id long, score long"


def usable(rows: DataFrame) -> DataFrame:
    """(id, label, v): rows that take part."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: x.cast("double"))
    return rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound).select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), v.alias("v"))


class Codebook:
    """Integer centroids (subs, centroids, width) and how integers are stored."""

    def __init__(self, sample: np.ndarray, dim: int, largest: float) -> None:
        self.width = max(2, -(-dim // MOST_SUBS))
        self.subs = max(1, -(-dim // self.width))
        self.kind = np.dtype("<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<f8")
        self.safe = self.subs * self.width * largest * largest < EXACT
        parts = self.pad(sample).reshape(len(sample), self.subs, self.width)
        rng = np.random.default_rng(13)
        first = parts[rng.permutation(len(parts))[:CENTROIDS]]
        self.centroids = np.stack([self._fit(parts[:, m], first[:, m].copy()) for m in range(self.subs)])

    def pad(self, v: np.ndarray) -> np.ndarray:
        return np.pad(v, ((0, 0), (0, self.subs * self.width - v.shape[1])))

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)

    def _fit(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        for _ in range(ROUNDS):
            near = self._nearest(x, c)
            n = np.bincount(near, minlength=len(c))
            for j in range(self.width):
                c[:, j] = np.where(n > 0, np.bincount(near, x[:, j], len(c)) / np.maximum(n, 1), c[:, j])
        return np.rint(c)

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and lengths of the residuals, rounded up."""
        parts = v.reshape(len(v), self.subs, self.width)
        codes = np.empty((len(v), self.subs), np.uint8)
        for m in range(self.subs):
            codes[:, m] = self._nearest(parts[:, m], self.centroids[m])
        left = parts - self.centroids[np.arange(self.subs), codes]
        return codes, np.nextafter(np.sqrt((left * left).sum(2)).astype(np.float32), np.float32(np.inf))


def _matrix(col: pa.Array | pa.ChunkedArray, kind: np.dtype, width: int) -> np.ndarray:
    """Rows of a binary column, each of `width` numbers."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if not len(col):
        return np.zeros((0, width), kind)
    ends = np.frombuffer(col.buffers()[1], np.int32 if pa.types.is_binary(col.type) else np.int64)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], kind, (int(ends[-1]) - int(ends[0])) // kind.itemsize, int(ends[0])).reshape(-1, width)


def _numbers(col) -> tuple[np.ndarray, np.ndarray]:
    """Values, and which of them are null."""
    return np.asarray(col.fill_null(0)).astype(np.int64), np.asarray(col.is_null())


def index(rows: DataFrame) -> tuple[DataFrame, Codebook] | None:
    """(row, id, label, q, codes, left) for all usable rows, as a scratch table, and the codebook; None without rows."""
    good = usable(rows)
    n, dim, largest = good.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).head()
    if not n:
        return None
    part = min(1.0, 2 * SAMPLE / n)
    drawn = good.where(F.pmod(F.xxhash64("id", F.slice("v", 1, 4)), F.lit(1 << 20)) < int(part * (1 << 20)) + 1).select("v").limit(SAMPLE).collect()
    dim = max(1, dim)
    sample = np.zeros((max(1, len(drawn)), dim))
    for i, r in enumerate(drawn):
        sample[i, : len(r["v"])] = np.floor(np.array(r["v"], float) * SCALE)
    book = Codebook(sample, dim, float(largest or 0) * SCALE + 1)

    @words.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), 4096):
                batch = whole.slice(k, 4096)
                v = batch.column("v")
                size = np.asarray(v.value_lengths()).astype(np.int64)
                q = np.zeros((len(batch), book.subs * book.width))
                q[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.floor(np.asarray(v.flatten()) * SCALE)
                codes, left = book.encode(q)
                q = q.astype(book.kind)
                binary = lambda a: pa.array([x.tobytes() for x in a], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "label")), binary(q), binary(codes), binary(left)], ["row", "id", "label", "q", "codes", "left"])

    coded = good.select(F.monotonically_increasing_id().alias("row"), "id", "label", "v").mapInArrow(run, "row long, id long, label long, q binary, codes binary, left binary")
    return common.scratch(coded), book


class Block:
    """A block of rows, ready for anchors."""

    def __init__(self, table: pa.Table, book: Codebook) -> None:
        self.book, dim = book, book.subs * book.width
        self.q = _matrix(table.column("q"), book.kind, dim).astype(np.float64)
        self.codes = _matrix(table.column("codes"), np.dtype(np.uint8), book.subs)
        self.left = _matrix(table.column("left"), np.dtype("<f4"), book.subs).astype(np.float64)
        self.length = np.sqrt((self.q * self.q).sum(1))
        self.row, self.label = (np.asarray(table.column(c)).astype(np.int64) for c in ("row", "label"))
        self.id, self.no_id = _numbers(table.column("id"))

    def intervals(self, a: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number, least and greatest possible score of every row) for each anchor of a."""
        book, n = self.book, len(self.row)
        tile = max(1, TILE_BYTES // (8 * max(1, n)))
        for k in range(0, len(a), tile):
            parts = a[k : k + tile].reshape(-1, book.subs, book.width)
            score = np.zeros((n, len(parts)))
            for m in range(book.subs):
                table = book.centroids[m] @ parts[:, m].T  # centroids x anchors
                score += table[self.codes[:, m]]
            own = np.sqrt((parts * parts).sum(2))
            with np.errstate(invalid="ignore", over="ignore"):
                room = self.left @ own.T
                room = np.nan_to_num(room * (1 + 1e-6) + 1e-9 * np.outer(self.length, np.sqrt((own * own).sum(1))) + 1, nan=np.inf)
                low, high = (np.clip(np.nan_to_num(x, nan=y), -EXACT, EXACT).T for x, y in ((score - room, -np.inf), (score + room, np.inf)))
            for j in range(len(parts)):
                yield k + j, low[j], high[j]

    def exact(self, some: np.ndarray, a: np.ndarray) -> np.ndarray:
        if self.book.safe:
            return (self.q[some] @ a).astype(np.int64)
        big = [sum(int(x) * int(y) for x, y in zip(r, a, strict=True)) for r in self.q[some]]
        return np.array([max(-EXACT, min(EXACT, s)) for s in big], np.int64)

    def first(self, some: np.ndarray, score: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The first `depth` of the rows: higher scores, then smaller ids, null ones last."""
        if len(some) > depth:
            keep = score >= np.partition(score, -depth)[-depth]
            some, score = some[keep], score[keep]
        order = np.lexsort((self.row[some], self.id[some], self.no_id[some], -score))[:depth]
        return some[order], score[order]


def _floor_of_best(low: np.ndarray, depth: int) -> float:
    """So much the `depth`-th best row scores at least."""
    return np.partition(low, -depth)[-depth] if len(low) >= depth else -np.inf


def _near(block: Block, anchors: pa.Table, positives: int) -> Iterator[tuple]:
    a = _matrix(anchors.column("q"), block.book.kind, block.q.shape[1]).astype(np.float64)
    row, label = (np.asarray(anchors.column(c)) for c in ("row", "label"))
    for j, low, high in block.intervals(a):
        same = np.flatnonzero((block.label == label[j]) & (block.row != row[j]))
        some = same[high[same] >= _floor_of_best(low[same], positives)]
        some, score = block.first(some, block.exact(some, a[j]), positives)
        yield row[j], 0, some, score


def _windowed(block: Block, anchors: pa.Table, depth: int, share: tuple[int, int]) -> Iterator[tuple]:
    a = _matrix(anchors.column("q"), block.book.kind, block.q.shape[1]).astype(np.float64)
    row, label, wants = np.asarray(anchors.column("row")), np.asarray(anchors.column("label")), anchors.column("wants").to_pylist()
    for j, low, high in block.intervals(a):
        windows = [(w["slot"], -(-share[0] * w["score"] // 100), share[1] * w["score"] // 100) for w in wants[j]]
        windows = [w for w in windows if w[1] <= w[2]]
        if not windows:
            continue
        lo, hi = min(w[1] for w in windows), max(w[2] for w in windows)
        reach = np.flatnonzero((block.label != label[j]) & (high >= lo) & (low <= hi))
        below, above = low[reach], high[reach]
        for slot, lo, hi in windows:
            sure = _floor_of_best(below[(below >= lo) & (above <= hi)], depth)
            some = reach[(above >= max(lo, sure)) & (below <= hi)]
            score = block.exact(some, a[j])
            fits = (score >= lo) & (score <= hi)
            yield row[j], slot, *block.first(some[fits], score[fits], depth)


def _meet(rows: DataFrame, anchors: DataFrame, book: Codebook, search, blocks: tuple[int, int]) -> DataFrame:
    """search(block of rows, block of anchors) over all pairs of blocks; blocks: how many of either."""

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out = [[] for _ in range(5)]
        if len(mine) and len(theirs):
            block = Block(mine, book)
            for anchor, slot, some, score in search(block, theirs):
                for col, x in zip(out, (np.full(len(some), anchor), np.full(len(some), slot, np.int32), block.row[some], np.ma.masked_array(block.id[some], block.no_id[some]), score), strict=True):
                    col.append(x)
        kinds = (np.int64, np.int32, np.int64, np.int64, np.int64)
        cols = [np.ma.concatenate(c) if c else np.ma.masked_array(np.zeros(0, k)) for c, k in zip(out, kinds, strict=True)]
        words.give_back()
        return pa.table([pa.array(np.ma.getdata(c).astype(k), mask=np.ma.getmaskarray(c)) for c, k in zip(cols, kinds, strict=True)], names=["anchor", "slot", "row", "id", "score"])

    mine, theirs = blocks
    number = F.xxhash64("row", F.lit(1))
    left = rows.withColumn("block", F.pmod(number, F.lit(mine)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(theirs - 1))))
    right = anchors.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(theirs)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(mine - 1))))
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(run, FOUND)


def _ranked(found: DataFrame, depth: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth)


def blocks_of(n: int, anchors: int, partitions: int) -> tuple[int, int]:
    """Blocks of rows and of anchors: as many of rows as there are partitions to fill, or as their size asks for."""
    return max(-(-n // ROWS_A_BLOCK), min(partitions, -(-n // 512)), 1), max(1, -(-anchors // ANCHORS_A_BLOCK))


def mine(rows: DataFrame, every: int = 100, positives: int = 5, depth: int = 10, share: tuple[int, int] = (30, 90)) -> DataFrame:
    """rows (vec_id, embedding, label) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).
    Anchors are the rows whose vec_id is divisible by `every`; a negative of another label scores from share[0] to share[1]
    per cent of its positive."""
    spark = rows.sparkSession
    made = index(rows)
    if made is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    coded, book = made
    asked = coded.where(F.col("id") % every == 0).select("row", "id", "label", "q")
    blocks = blocks_of(coded.count(), asked.count(), common.partitions(spark))
    near = _ranked(_meet(coded, asked.drop("id"), book, lambda b, a: _near(b, a, positives), blocks), positives)
    near = common.scratch(near.select("anchor", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    wants = near.groupBy("anchor").agg(F.collect_list(F.struct("slot", F.col("positive_score").alias("score"))).alias("wants"))  # at most `positives`
    windows = common.scratch(asked.join(wants, F.col("row") == F.col("anchor")).select("row", "label", "q", "wants"))
    far = _ranked(_meet(coded, windows, book, lambda b, a: _windowed(b, a, depth, share), blocks), depth)
    names = asked.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    out = far.join(near, ["anchor", "slot"]).join(names, "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabelled(rows: DataFrame) -> DataFrame:
    """Where vec_id is divisible by 7 the label becomes the next of ten."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
