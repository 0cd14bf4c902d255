"""Scoring extractions against gold: greedy span matching, precision, recall, F1."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    both = F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0))
    return F.coalesce(F.try_divide(both, (a_end - a_start) + (b_end - b_start) - both), F.lit(0.0))


def _hits(said: list[tuple[int, int]], free: list[tuple[int, int]], least: float) -> int:
    """How many spans find a free gold span, each taking the one it overlaps best."""
    tp = 0
    for a, b in said:
        best, at = 0.0, None
        for i, (c, d) in enumerate(free):
            both = max(0, min(b, d) - max(a, c))
            score = both / ((b - a) + (d - c) - both) if both else 0.0
            if score >= least and score > best:
                best, at = score, i
        if at is not None:
            free.pop(at)
            tp += 1
    return tp


def match(predicted: DataFrame, gold: DataFrame, least: float = 0.3) -> DataFrame:
    """Per doc_id and clause_type: each prediction in order takes the free gold span it overlaps best.  tp, fp, fn.

    The spans of a document and type are collected into one row, and Python meets rows by batches: a call for each group
    would cost more than the matching."""
    keys, side = ["doc_id", "clause_type"], {"p": predicted, "g": gold}
    one = lambda name, df: df.select(*keys, F.lit(name).alias("side"), F.col("seq").cast("double").alias("seq"), F.col("char_start").cast("long").alias("s"), F.col("char_end").cast("long").alias("e"))
    spans = one("p", predicted).unionByName(one("g", gold))
    held = spans.groupBy(*keys).agg(*(F.array_sort(F.collect_list(F.when(F.col("side") == k, F.struct("seq", "s", "e")))).alias(k) for k in side))
    held = held.select(*keys, *(F.transform(F.col(f"{k}.{f}"), lambda x: F.coalesce(x, F.lit(0))).alias(k + f) for k in side for f in ("s", "e")))

    sides = list(side)  # the frames stay with the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = {c: batch.column(c).flatten().to_pylist() for c in ("ps", "pe", "gs", "ge")}
            p, g = (list(zip(flat[k + "s"], flat[k + "e"], strict=True)) for k in sides)
            n_p, n_g = (batch.column(k + "s").value_lengths().to_pylist() for k in sides)
            tp, i, j = [], 0, 0
            for n, m in zip(n_p, n_g, strict=True):
                tp.append(_hits(p[i : i + n], g[j : j + m], least))
                i, j = i + n, j + m
            counts = (tp, [n - t for n, t in zip(n_p, tp, strict=True)], [m - t for m, t in zip(n_g, tp, strict=True)])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(c, pa.int64()) for c in counts)], [*keys, "tp", "fp", "fn"])

    kind = dict(predicted.dtypes)["doc_id"]
    return held.mapInArrow(run, f"doc_id {kind}, clause_type string, tp long, fp long, fn long")


def prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    zero = F.lit(0.0)
    p, r = F.coalesce(F.try_divide(tp, tp + fp), zero), F.coalesce(F.try_divide(tp, tp + fn), zero)
    return p, r, F.coalesce(F.try_divide(2 * p * r, p + r), zero)


def score(matched: DataFrame, by: str | None = "clause_type") -> DataFrame:
    """Per type, or micro over all with by=None."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]
    g = matched.groupBy(by).agg(*sums) if by else matched.agg(*sums)
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return g.select(*([by] if by else []), "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


# Least F1 of a type that is close to solved, reliable, mixed.
BANDS = (("solved", 0.95), ("reliable", 0.85), ("mixed", 0.6))


def report(matched: DataFrame) -> DataFrame:
    """matched (clause_type, tp, fp, fn, ...) -> a row for each type and one for all (clause_type null), from one pass:
    counts, gold, precision, recall, f1, and a band; extra where the gold has nothing of the type."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]
    g = matched.groupingSets([["clause_type"], []], "clause_type").agg(*sums, F.grouping("clause_type").alias("total"))
    p, r, f = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    g = g.select("clause_type", "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("gold"), p.alias("precision"), r.alias("recall"), f.alias("f1"), (F.col("total") == 1).alias("total"))
    band = F.when(F.col("gold") == 0, "extra")
    for name, least in BANDS:
        band = band.when(F.col("f1") >= least, name)
    return g.withColumn("band", band.otherwise("weak"))


def evaluate(predicted: DataFrame, gold: DataFrame, least: float = 0.3) -> DataFrame:
    """The report of spans (doc_id, clause_type, seq, char_start, char_end) against a gold table of the same columns."""
    return report(match(predicted, gold, least))


def write_report(found: DataFrame, path: str) -> None:
    """Weakest types first, the row for all last."""
    found.coalesce(1).sortWithinPartitions("total", "f1", "clause_type").write.mode("overwrite").json(path)


REPORT = "clause_type string, tp long, fp long, fn long, gold long, precision double, recall double, f1 double, total boolean, band string"


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A report as written; without rows where there is none yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(REPORT).json(path) if there else spark.createDataFrame([], REPORT)
