"""Sources: contract texts, extraction JSON, cached extractions, stored payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

CLAUSE = "clause_type string, quote string, party_favored string, amount double, currency string, percent double, days int, months int, uptime_percent double, unilateral boolean, survives_termination boolean, note string, confidence double"
RULE = "kind string, anchor string, offset_days int, recurrence_months int, condition string, consequence string, owed_by string, quote string"
EXTRACTION = f"counterparty_name string, our_role string, effective_date_text string, annual_value double, currency string, clauses array<struct<{CLAUSE.replace(' ', ':').replace(',:', ',')}>>, temporal_rules array<struct<{RULE.replace(' ', ':').replace(',:', ',')}>>"


def documents_of(raw: DataFrame) -> DataFrame:
    """raw (filename, raw text) -> documents: normalised text, one page mark, type, hash of the raw text."""
    t = raw.select("filename", F.sha2("raw", 256).alias("sha256"), X.normalise(F.col("raw")).alias("text"))
    page = F.array(F.struct(F.lit(1).alias("page"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"), F.lit(None).cast("double").alias("ocr_confidence")))
    return t.select(F.substring("sha256", 1, 16).alias("doc_id"), "filename", "text", X.contract_type(F.col("filename"), F.col("text")).alias("contract_type"), "sha256", page.alias("pages"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return documents_of(files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.make_valid_utf8(F.col("content").cast("string")).alias("raw")))


def one_contract_per_file(documents: DataFrame) -> DataFrame:
    """Contracts of an upload of many files: id from the hash, name from the file."""
    return documents.select(F.concat(F.lit("k_"), F.substring("sha256", 1, 8)).alias("contract_id"), "doc_id", F.col("filename").alias("title"), X.counterparty(F.col("filename")).alias("counterparty"), "contract_type")


def families(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Uploads of several files, a folder each (path/upload/file): (documents with contract_id and seq, contracts).  The files
    of a folder are one contract, in the order of their names; its id comes from their texts, so that the same upload
    under another name is the same contract; its counterparty is that of the first file's name."""
    files = spark.read.format("binaryFile").load(path)
    raw = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("upload"), F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.make_valid_utf8(F.col("content").cast("string")).alias("raw"))
    named = raw.withColumn("filename", F.concat_ws("/", "upload", "filename"))
    docs = documents_of(named.select("filename", "raw")).withColumns({"upload": F.substring_index("filename", "/", 1), "filename": F.substring_index("filename", "/", -1)})
    per = docs.groupBy("upload").agg(F.array_sort(F.collect_list(F.struct("filename", "doc_id", "sha256"))).alias("d"))  # an upload's files
    ids = F.sha2(F.array_join(F.array_sort(F.transform("d", lambda x: x["sha256"])), ":"), 256)
    per = per.select("upload", F.concat(F.lit("k_"), F.substring(ids, 1, 8)).alias("contract_id"), "d")
    order = per.select("upload", "contract_id", F.posexplode("d").alias("seq", "x")).select(F.col("upload").alias("_u"), "contract_id", "seq", F.col("x.filename").alias("_f"))
    family = docs.join(order, (F.col("upload") == F.col("_u")) & (F.col("filename") == F.col("_f"))).drop("_u", "_f", "upload")
    contracts = per.dropDuplicates(["contract_id"]).select("contract_id", F.col("upload").alias("title"), X.counterparty(F.col("d")[0]["filename"]).alias("counterparty"), F.transform("d", lambda x: x["doc_id"]).alias("doc_ids"))
    return family.dropDuplicates(["contract_id", "doc_id"]), contracts


def extractions(spark: SparkSession, path: str) -> DataFrame:
    """Extraction JSON files, one object each, with their file name; every field may be null."""
    return spark.read.schema(EXTRACTION).json(path, multiLine=True).withColumn("filename", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1))


def clauses_of(found: DataFrame) -> DataFrame:
    return found.select("filename", F.posexplode_outer("clauses").alias("pos", "c")).select("filename", "pos", "c.*")


def rules_of(found: DataFrame) -> DataFrame:
    return found.select("filename", F.posexplode_outer("temporal_rules").alias("pos", "r")).select("filename", "pos", "r.*")


def cache_key(sha256, party, model, version: str = "v1"):
    return F.substring(F.sha2(F.concat_ws(":", sha256, party, model, F.lit(version)), 256), 1, 16)


def cached(documents: DataFrame, cache: DataFrame, party: str, model: str) -> DataFrame:
    """Documents with their cached extraction (null where there is none); cache: key, extraction."""
    return documents.withColumn("key", cache_key(F.col("sha256"), F.lit(party), F.lit(model))).join(cache, "key", "left")


def payloads(rows: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Stored JSON payloads -> (parsed, those that can't be read)."""
    p = rows.withColumn("parsed", F.from_json("payload", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("parsed").isNull() | F.col("parsed._corrupt_record").isNotNull()
    return p.where(~bad).select(*(c for c in rows.columns if c != "payload"), "parsed.*").drop("_corrupt_record"), p.where(bad).select(*rows.columns)


def to_payload(df: DataFrame, key: str, version: int = 1) -> DataFrame:
    return df.select(key, F.to_json(F.struct(F.lit(version).alias("version"), *df.columns)).alias("payload"))
