"""Tables by tenant on Parquet: upsert by keeping the latest, cascading delete, append-only audit, vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def keep_latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    latest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_r", latest).where("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str = "created_at") -> DataFrame:
    """Rows of new take the place of those with equal keys in old; on equal order the new one wins."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    latest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new")))
    return both.withColumn("_r", latest).where("_r = 1").drop("_r", "_new")


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


class Store:
    """One tenant's view; the tenant is fixed at construction and part of every read."""

    def __init__(self, spark: SparkSession, path: str, tenant: str) -> None:
        self.spark, self.path, self.tenant = spark, path.rstrip("/"), tenant

    def read(self, table: str) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/{table}").where(F.col("tenant_id") == self.tenant)

    def append(self, table: str, rows: DataFrame) -> None:
        rows.withColumn("tenant_id", F.lit(self.tenant)).write.mode("append").partitionBy("tenant_id").parquet(f"{self.path}/{table}")

    def current(self, table: str, keys: list[str], order: str = "created_at") -> DataFrame:
        """The latest row of each key (writes are appends, so a lost task can't lose rows)."""
        rows = keep_latest(self.read(table), keys, order)
        return rows.where(~F.col("deleted")) if "deleted" in rows.columns else rows

    def audit(self, rows: DataFrame) -> None:
        """rows: actor, action, subject_id, detail, at."""
        self.append("audit", rows)

    def audit_tail(self, n: int = 200) -> DataFrame:
        return self.read("audit").orderBy(F.desc("at"), F.desc("subject_id")).limit(n)


def unit(v: Column) -> Column:
    """A vector divided by its length (a zero vector stays)."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.transform(v, lambda x: (x / F.when(n == 0, 1.0).otherwise(n)).cast("float"))


def vector_rows(items: DataFrame, dimension: int) -> DataFrame:
    """items (namespace, id, contract_id, text, embedding) ready to be stored: no blank text, unit length, text cut to
    what is shown; a vector of another dimension is an error."""
    checked = F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit(f"dimension {dimension} expected, got "), F.size("embedding").cast("string"))))
    return items.where(F.trim("text") != "").withColumns({"embedding": unit(checked), "text": F.substring("text", 1, 400)})


def vector_payload(records: DataFrame, passages: DataFrame) -> DataFrame:
    """What is embedded: records as title, body and quote, passages as they are; at most 1800 characters."""
    r = records.select("id", "contract_id", "kind", F.concat_ws(" ", F.concat("title", F.lit(".")), "body", "quote").alias("text"))
    p = passages.select("id", "contract_id", F.lit("passage").alias("kind"), "text")
    return r.unionByName(p).withColumn("text", F.substring("text", 1, 1800))


def out_of_sync(vectors: DataFrame, payload: DataFrame) -> DataFrame:
    """Payload rows that the vector table lacks."""
    return payload.join(vectors.select("id"), "id", "left_anti")


def counts(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))


def empty_vectors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "namespace string, id string, contract_id string, kind string, text string, embedding array<float>")


def union(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
