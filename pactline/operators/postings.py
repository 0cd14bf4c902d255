"""A stored inverted index, and BM25 search for many questions at once.

Documents are dealt into segments of about SEGMENT by a hash of their id.  A term's postings in a segment are one block: the
documents with what the term adds to their scores, before its weight, and the greatest of these; no posting list is ever
one row or one group, however frequent its term.  Texts are shuffled once, by segment, and all else is counted where they
lie.  Each file is sorted by term, so that a search which names its terms to the scan reads the pages of those only.

A search first reads the blocks' heads.  A segment can add at most the sum of its blocks' maxima, and at least the largest
of them, as some document has that; segments hold different documents, so the k-th largest of the latter is a score
that k documents reach.  Only segments that can reach it too are opened, each in one place, so that no more than k
documents of a segment are shuffled for a question.  Scores are those of retrieval.bm25."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import dims
from ..shipping import cut, spread
from .retrieval import K1, B, idf

SEGMENT, NAMED_TERMS, QUESTIONS_TOGETHER, FEW_WEIGHTS = 512, 500, 2000, 200_000


class PostingsIndex:
    """An index at a path: tables terms, blocks and stats."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}")

    @classmethod
    def build(cls, docs: DataFrame, path: str, text: str = "text", id_col: str = "id", stopwords: list[str] | None = None) -> PostingsIndex:
        """Writes the index of docs.  Texts are split twice, for the mean length and for the postings, which needs less room
        than keeping the terms of every document."""
        index = cls(docs.sparkSession, path)
        tokens = X.tokens(F.coalesce(F.col(text), F.lit("")), stopwords)
        sums = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(tokens)), F.lit(0)).alias("tokens"))
        sums.select("n", F.coalesce(F.try_divide("tokens", "n"), F.lit(0.0)).alias("avg_len")).coalesce(1).write.parquet(f"{index.path}/stats")
        n, avg = index.stats()
        segment = F.pmod(F.xxhash64(F.col(id_col), F.lit("segment")), F.lit(max(1, -(-n // SEGMENT)))).cast("int")
        dealt = spread(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), segment.alias("segment")), "segment")
        held = dealt.select("segment", "id", X.tokens(F.coalesce("text", F.lit("")), stopwords).alias("t")).select("segment", "id", F.size("t").alias("len"), F.explode("t").alias("term"))
        counted = held.groupBy("segment", "term", "id").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))
        adds = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.greatest("len", F.lit(1)) / F.lit(avg or 1.0)))
        blocks = counted.select("segment", "term", F.struct(adds.alias("adds"), "id").alias("p")).groupBy("segment", "term").agg(F.count(F.lit(1)).alias("n"), F.max("p.adds").alias("top"), F.collect_list("p").alias("posts"))  # a segment's documents
        blocks.sortWithinPartitions("term", "segment").write.option("compression", "zstd").parquet(f"{index.path}/blocks")
        terms = index.read("blocks").groupBy("term").agg(F.sum("n").alias("df"))
        terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{index.path}/terms")
        return index

    def stats(self) -> tuple[int, float]:
        """Number of documents and their mean length."""
        row = self.read("stats").head()
        return row["n"], row["avg_len"]

    def asked(self, questions: DataFrame, stopwords: list[str] | None = None) -> DataFrame:
        """questions (qid, text) -> (qid, term, times)."""
        words = questions.select("qid", F.explode(X.tokens(F.coalesce("text", F.lit("")), stopwords)).alias("term"))
        return words.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))

    def pruned(self, table: str, asked: DataFrame) -> DataFrame:
        """The table's rows; where at most NAMED_TERMS terms are asked for, the scan is told which."""
        terms = [r[0] for r in asked.select("term").distinct().limit(NAMED_TERMS + 1).collect()]
        rows = self.read(table)
        return rows.where(F.col("term").isin(terms)) if len(terms) <= NAMED_TERMS else rows

    def weights(self, asked: DataFrame) -> DataFrame:
        """(qid, term, weight): idf, as often as the question has the term."""
        n, _ = self.stats()
        return asked.join(self.pruned("terms", asked), "term").select("qid", "term", (F.col("times") * idf(F.lit(n), F.col("df"))).alias("weight"))

    def candidates(self, weights: DataFrame, heads: DataFrame, k: int) -> DataFrame:
        """(qid, segment): the segments that have to be opened for a question.  weights stand on one side of a join with all
        blocks; up to FEW_WEIGHTS of them are broadcast."""
        near = F.broadcast(weights) if weights.count() <= FEW_WEIGHTS else weights
        most = F.col("weight") * F.col("top")
        each = heads.select("term", "segment", "top").join(near, "term").groupBy("qid", "segment").agg(F.sum(most).alias("most"), F.max(most).alias("least"))
        each = cut(each)
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("least")))
        bar = each.withColumn("_r", place).where(F.col("_r") == k).select("qid", F.col("least").alias("bar"))
        return each.join(bar, "qid", "left").where(F.col("bar").isNull() | (F.col("most") * (1 + 1e-9) >= F.col("bar"))).select("qid", "segment")

    def search(self, questions: DataFrame, k: int = 10, stopwords: list[str] | None = None) -> DataFrame:
        """questions (qid, text) -> (qid, rank from 0, id, score): the k best documents of each, ties by id.  A term that
        a question has twice counts twice; a question without a known term has no rows."""
        asked = self.asked(questions, stopwords)
        weights, blocks = cut(self.weights(asked)), self.pruned("blocks", asked)
        live = self.candidates(weights, blocks, k)
        wants = weights.groupBy("qid").agg(F.collect_list(F.struct("term", "weight")).alias("wants"))  # a question's terms
        terms = weights.select("term").distinct()
        terms = F.broadcast(terms) if terms.count() <= FEW_WEIGHTS else terms
        parts = -(-questions.count() // QUESTIONS_TOGETHER) or 1
        left = blocks.join(terms, "term", "left_semi").select(F.col("segment").alias("_segment"), "term", "posts", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
        right = live.join(wants, "qid").select("segment", "qid", "wants", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int").alias("part"))
        kinds = f"qid {dict(weights.dtypes)['qid']}, id {blocks.schema['posts'].dataType.elementType['id'].dataType.simpleString()}, score double"
        best = left.groupBy("_segment", "_part").cogroup(right.groupBy("segment", "part")).applyInArrow(_best_of_segment(k), kinds)
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")) - 1
        return best.withColumn("rank", place).where(F.col("rank") < k).select("qid", "rank", "id", "score")


def _best_of_segment(k: int):
    """The k best documents of one segment for each of some questions.  A document's terms are all here, so its score is
    whole, and only k rows of a question leave the segment."""

    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        posts = blocks.column("posts").combine_chunks()
        flat, ends = posts.flatten(), np.asarray(posts.offsets) - (posts.offsets[0].as_py() if len(posts) else 0)
        ids = flat.field("id").dictionary_encode()
        doc, adds = np.asarray(ids.indices), np.asarray(flat.field("adds"))
        place = np.empty(len(ids.dictionary), np.int64)
        place[np.asarray(pc.sort_indices(ids.dictionary))] = np.arange(len(place))
        at = {term: i for i, term in enumerate(blocks.column("term").to_pylist())}
        wants = asked.column("wants").combine_chunks()
        each, until = wants.flatten(), np.asarray(wants.offsets) - (wants.offsets[0].as_py() if len(wants) else 0)
        block = [at.get(t) for t in each.field("term").to_pylist()]
        weights = np.asarray(each.field("weight"))
        row, hits, scores = [], [], []
        for q in range(len(wants)):
            score = np.zeros(len(place))
            for r in range(until[q], until[q + 1]):
                if (b := block[r]) is not None:
                    score[doc[ends[b] : ends[b + 1]]] += weights[r] * adds[ends[b] : ends[b + 1]]
            hit = np.flatnonzero(score > 0)
            if len(hit) > k:
                hit = hit[score[hit] >= np.partition(score[hit], -k)[-k]]
            hit = hit[np.lexsort((place[hit], -score[hit]))[:k]]
            row.append(np.full(len(hit), q))
            hits.append(hit)
            scores.append(score[hit])
        join = lambda x, t: pa.array(np.concatenate(x).astype(t) if x else np.zeros(0, t))
        return pa.table([asked.column("qid").combine_chunks().take(join(row, np.int64)), ids.dictionary.take(join(hits, np.int64)), join(scores, np.float64)], names=["qid", "id", "score"])

    return run


def record_text() -> Column:
    """What of a record is searched (retrieval.records)."""
    return F.concat_ws(" ", "contract", "kind", "title", "body", "quote")


def build_records(records: DataFrame, path: str) -> PostingsIndex:
    return PostingsIndex.build(records.select("id", record_text().alias("text")), path, stopwords=dims.STOPWORDS)
