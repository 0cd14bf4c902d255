"""Streams: files into contracts, counts by event time, a rolling token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import readers
from ..sources.store import Store


def ingest(spark: SparkSession, path: str, store: Store, checkpoint: str, clock: str = "current_timestamp()"):
    """Each new file becomes a document and a contract of its own, appended to the tenant's tables.  Replayed batches
    write the same keys, and reads keep the latest row of a key, so results are the same."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    raw = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.make_valid_utf8(F.col("content").cast("string")).alias("raw"))

    def batch(df: DataFrame, _: int) -> None:
        docs = readers.documents_of(df)
        store.append("documents", docs.withColumn("created_at", F.expr(clock)))
        store.append("contracts", readers.one_contract_per_file(docs).withColumn("created_at", F.expr(clock)))

    return raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """Events by type and window of event time; works on streams and tables alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def budget(events: DataFrame, tokens: str, limit: int, seconds: int = 60, by: str | None = None) -> DataFrame:
    """spent: tokens of the `seconds` before each request; admitted if they and its own stay within the limit, or if
    nothing was spent."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy(at).rangeBetween(1 - seconds * 1_000_000, -1)
    spent = F.coalesce(F.sum(tokens).over(w), F.lit(0))
    return events.withColumn("spent", spent).withColumn("admitted", (F.col("spent") + F.col(tokens) <= limit) | (F.col("spent") == 0))
