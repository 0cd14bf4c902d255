"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the columns of documents.
A document that has lost all its words to line dedup goes with that stage; one that had none before is the quality
rules' affair.

Defined results: a null or empty text fails the quality rules and goes; rows are judged as rows, so that of repeated
ones (also those of a null doc_id) the Jaccard join keeps one, and other rows of the same doc_id stay; ties are broken by
the smallest doc_id, then by a hash of the text; an empty table goes through as an empty one; columns beyond doc_id and
text pass through all stages but packing under any name; texts of any length are read whole.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline.llm import common, decontam, jaccard, lines, packing, quality
from pactline.llm.queries import prepare, table, tokenizer_path

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def _stage(f):
    """A stage as the pipeline calls it.  Its result reads scratch tables, which stay as long as the driver does unless the
    caller removes them after it has written the result, as run() does."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        common.release(spark)
        out = f(spark, docs, sf_dir)
        common.release(spark)
        return out

    return run


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep."""
    return quality.keep(docs)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; those left without a word go."""
    return lines.dedup(docs, short=True).where(F.col("text").rlike(WORD))


@_stage
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.keep_one(docs)


@_stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


@_stage
def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", sequence_packing),
]

#: SQL can't express SimHash blocks, edit-verified components or subset-sum packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and read again as the next one's docs."""
    docs, read = table(spark, sf_dir, "documents"), set()
    for name, stage in STAGES:
        before = common.held()
        out = stage(spark, docs, sf_dir)
        if name == STAGES[-1][0]:
            return out
        docs = common.scratch(out)
        written = {docs._scratch_path}
        common.drop_paths(spark, (common.held() - before - written) | read)  # what the stage made, and its own docs
        read = written
