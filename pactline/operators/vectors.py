"""An approximate index of vectors by cells, with exact re-ranking.

A coarse quantiser, k-means over at most SAMPLE unit vectors, gives at most a few thousand centres.  Every vector lies in the
folder of its nearest centre; more vectors are appended at any time, without training anew.  A search probes, for each
query, the cells whose centres are nearest, as many as reach a target recall on the sample, and scores their vectors
exactly.

With exact=True it goes on: a cell keeps the widest angle between its centre and a vector, so none of its vectors is nearer
to a query than the angle to the centre less that.  Cells that could still hold one of the best k are probed too, others
are left alone, and the answer is that of a full scan.

Large cells are searched in parts by a hash of the id, so no task or group holds a cell whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLE, ROUNDS, ASKED, PART = 8192, 8, 512, 1 << 15
HITS = "qid long, id long, score double"


def _rows(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Vectors of a list column at unit length (a zero vector stays)."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    v = np.asarray(col.flatten(), np.float64).reshape(-1, dim)
    length = np.sqrt((v * v).sum(1))
    return v / np.where(length == 0, 1, length)[:, None]


def train(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of unit length, by k-means on the sphere."""
    rng = np.random.default_rng(7)
    centres = sample[rng.permutation(len(sample))[:cells]].copy()
    for _ in range(ROUNDS):
        near = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        length = np.sqrt((sums * sums).sum(1))
        centres = np.where(length[:, None] > 0, sums / np.where(length == 0, 1, length)[:, None], centres)
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, target: float, k: int = 20) -> int:
    """How many cells have to be probed so that the share `target` of the k nearest is found, among the sample's own
    vectors.  Where vectors lie denser than in the sample, their nearest are nearer and fewer cells would do."""
    q = sample[:ASKED]
    by = q @ centres.T
    place = np.argsort(np.argsort(-by, axis=1), axis=1)  # of each cell, for each query
    scores = q @ sample.T
    scores[np.arange(len(q)), np.arange(len(q))] = -2  # itself
    near = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
    cell = np.argmax(sample @ centres.T, axis=1)
    needed = np.sort(np.take_along_axis(place, cell[near], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) if len(needed) else 1


class VectorIndex:
    """An index at a path: tables centres (cell, centre), settings (probes) and vectors (cell, id, embedding, angle)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int = 128, target: float = 0.95) -> VectorIndex:
        """vectors (id, embedding), all of one length; rows with a null or a component that is none are left out.  How many
        cells a search probes is set for the recall `target`, measured on the sample."""
        index = cls(vectors.sparkSession, path)
        good = cls.usable(vectors)
        n = max(1, good.count())
        drawn = good.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(min(1.0, 2 * SAMPLE / n) * (1 << 20)) + 1).select("embedding").limit(SAMPLE).collect()
        if not drawn:
            raise ValueError("an index needs vectors")
        sample = _rows(pa.array([r[0] for r in drawn]), len(drawn[0][0]))
        centres = train(sample, cells)
        index.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{index.path}/centres")
        index.spark.createDataFrame([(probes_for(sample, centres, target),)], "probes int").coalesce(1).write.parquet(f"{index.path}/settings")
        index.insert(vectors)
        return index

    @staticmethod
    def usable(vectors: DataFrame) -> DataFrame:
        sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return vectors.where(F.col("id").isNotNull() & F.col("embedding").isNotNull() & sound).select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def centres(self) -> np.ndarray:
        rows = sorted(self.spark.read.parquet(f"{self.path}/centres").collect())
        return np.array([r["centre"] for r in rows])

    def insert(self, vectors: DataFrame) -> None:
        """Adds vectors.  Each goes to the folder of its cell; a vector of another length is an error."""
        centres = self.centres()
        dim = centres.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _rows(batch.column("embedding"), dim)
                by = v @ centres.T
                near = np.argmax(by, axis=1) if len(v) else np.zeros(0, np.int64)
                angle = np.arccos(np.clip(by[np.arange(len(v)), near], -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("embedding"), pa.array(angle), pa.array(near.astype(np.int32))], ["id", "embedding", "angle", "cell"])

        fits = F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.lit(f"dimension {dim} expected")).cast("array<double>"))
        dealt = self.usable(vectors).select("id", fits.alias("embedding")).mapInArrow(run, "id long, embedding array<double>, angle double, cell int")
        dealt.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("append").partitionBy("cell").parquet(f"{self.path}/vectors")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def _plan(self, queries: DataFrame, centres: np.ndarray, choose) -> DataFrame:
        """(qid, embedding, cell) for the cells that choose(angles to all centres, bars) names; bars: column `bar`."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = _rows(batch.column("embedding"), centres.shape[1])
                angles = np.arccos(np.clip(q @ centres.T, -1, 1))
                take = choose(angles, np.asarray(batch.column("bar")))
                row, cell = np.nonzero(take)
                yield pa.RecordBatch.from_arrays([batch.column("qid").take(pa.array(row)), batch.column("embedding").take(pa.array(row)), pa.array(cell.astype(np.int32))], ["qid", "embedding", "cell"])

        return queries.select("qid", "embedding", "bar").mapInArrow(run, "qid long, embedding array<double>, cell int")

    def _scan(self, asked: DataFrame, k: int, dim: int) -> DataFrame:
        """Best k of each query in each part of the cells it asks for."""
        cells = [r[0] for r in asked.select("cell").distinct().collect()]  # at most as many as there are centres
        rows = self.read().where(F.col("cell").isin(cells))
        sizes = F.broadcast(rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")))  # a row a cell
        left = rows.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "embedding")
        right = asked.join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "qid", F.col("embedding").alias("q"))

        def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
            qid, ids, scores = [], [], []
            if len(mine) and len(theirs):
                v, q = _rows(mine.column("embedding"), dim), _rows(theirs.column("q"), dim)
                own, names = np.asarray(mine.column("id")), np.asarray(theirs.column("qid"))
                for at in range(0, len(q), 256):
                    for name, s in zip(names[at : at + 256], q[at : at + 256] @ v.T, strict=True):
                        keep = np.flatnonzero(s >= np.partition(s, -k)[-k]) if len(s) > k else np.arange(len(s))
                        keep = keep[np.lexsort((own[keep], -s[keep]))[:k]]
                        qid.append(np.full(len(keep), name))
                        ids.append(own[keep])
                        scores.append(s[keep])
            flat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0, t))
            return pa.table([flat(qid, np.int64), flat(ids, np.int64), flat(scores, np.float64)], names=["qid", "id", "score"])

        return left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(run, HITS)

    @staticmethod
    def _best(hits: DataFrame, k: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")) - 1
        return hits.withColumn("rank", place).where(F.col("rank") < k).select("qid", "rank", "id", "score")

    def search(self, queries: DataFrame, k: int = 20, probes: int | None = None, exact: bool = False) -> DataFrame:
        """queries (qid, embedding) -> (qid, rank from 0, id, score): cosine similarity, ties by id."""
        probes = probes or self.spark.read.parquet(f"{self.path}/settings").head()[0]
        centres = self.centres()
        dim, cells = centres.shape[1], len(centres)
        q = queries.select(F.col("qid").cast("long").alias("qid"), F.col("embedding").cast("array<double>").alias("embedding"), F.lit(None).cast("double").alias("bar"))

        def nearest(angles: np.ndarray, _: np.ndarray) -> np.ndarray:
            take = np.zeros(angles.shape, bool)
            np.put_along_axis(take, np.argsort(angles, axis=1)[:, :probes], True, axis=1)
            return take

        first = self._best(self._scan(self._plan(q, centres, nearest), k, dim), k)
        if not exact:
            return first
        widest = np.full(cells, -1.0)
        for r in self.read().groupBy("cell").agg(F.max("angle").alias("a")).collect():  # a row a cell
            widest[r["cell"]] = r["a"]
        bars = first.where(F.col("rank") == k - 1).select("qid", F.col("score").alias("bar"))

        def could(angles: np.ndarray, bar: np.ndarray) -> np.ndarray:
            near = np.cos(np.maximum(0, angles - widest)) + 1e-9
            return (near >= np.where(np.isnan(bar), -2, bar)[:, None]) & (widest >= 0) & ~nearest(angles, bar)

        more = self._scan(self._plan(q.drop("bar").join(bars, "qid", "left"), centres, could), k, dim)
        return self._best(first.select("qid", "id", "score").unionByName(more), k)
