"""Agreement-shaped tables made from order tables, so that the operators can be run and checked on them.  SQL has the
same tables for DuckDB, as common table expressions."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TODAY = datetime.date(2001, 9, 1)
TYPES = ["liability_cap", "indemnification", "auto_renewal", "notice_period", "termination_for_convenience", "early_termination_fee", "price_increase", "payment_terms", "breach_notification", "subprocessors", "data_retention_deletion", "sla", "unilateral_amendment", "audit_rights", "confidentiality", "term", "governing_law"]
KINDS = ["msa", "sow", "dpa", "order_form", "nda", "amendment", "unknown"]
ROLES = ["buyer", "seller", "mutual"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One for each order."""
    o = table(spark, sf_dir, "orders")
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), (n % len(names)).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("contract_id"), F.concat(F.lit("Agreement "), F.col("o_orderkey").cast("string")).alias("title"), F.concat(F.lit("Party "), F.col("o_custkey").cast("string")).alias("counterparty"), F.col("o_custkey"),
        pick(ROLES, F.col("o_orderkey")).alias("our_role"), pick(KINDS, F.col("o_custkey")).alias("contract_type"), F.col("o_orderdate").cast("date").alias("effective_date"), F.col("o_totalprice").alias("annual_value"), F.lit("USD").alias("currency"),
    )


CONTRACTS = f"""contracts AS (SELECT o_orderkey AS contract_id, 'Agreement ' || o_orderkey AS title, 'Party ' || o_custkey AS counterparty, o_custkey,
  {ROLES}[(o_orderkey % 3)::INT + 1] AS our_role, {KINDS}[(o_custkey % 7)::INT + 1] AS contract_type,
  o_orderdate::DATE AS effective_date, o_totalprice AS annual_value, 'USD' AS currency FROM orders)"""

#: (number, kind, anchor, offset in days, recurrence)
RULES = [(1, "renewal", "term_end", 0, "P12M"), (2, "notice", "term_end", -60, None), (3, "report", "quarter_end", 15, None), (4, "payment", "effective_date", 30, "P1M"), (5, "payment", "invoice_date", 30, None)]


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same five rules for every contract."""
    r = spark.createDataFrame(RULES, "seq int, kind string, anchor string, offset_days int, recurrence string")
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("contract_id"))
    each = F.array(*(F.struct(*(F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, r.dtypes, strict=True))) for row in RULES))
    c = c.select("contract_id", F.explode(each).alias("r")).select("contract_id", "r.*")
    no = F.lit(None).cast("string")
    return c.select("contract_id", F.concat_ws(":", F.col("contract_id").cast("string"), F.col("seq").cast("string")).alias("rule_id"), "seq", "kind", "anchor", "offset_days", "recurrence", no.alias("condition"), no.alias("consequence"), F.lit("us").alias("owed_by"), F.lit("").alias("quote"))


def claims(spark: SparkSession, sf_dir: str, place: bool = False) -> DataFrame:
    """One for each line of an order.  With place, where it stands in the table: line numbers repeat."""
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("int")
    kind = F.get(F.array(*map(F.lit, TYPES)), (F.col("l_partkey") % len(TYPES)).cast("int"))
    return li.select(
        F.col("l_orderkey").alias("contract_id"), F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("claim_id"), F.col("l_linenumber").cast("int").alias("seq"), kind.alias("clause_type"),
        F.when(F.col("l_returnflag") == "A", "counterparty").when(F.col("l_returnflag") == "N", "us").otherwise("mutual").alias("party_favored"),
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 40).cast("int").alias("char_start"), (F.col("l_linenumber") * 40 + q).cast("int").alias("char_end"), F.concat(F.lit("line "), q.cast("string")).alias("quote"),
        F.when(kind == "liability_cap", F.col("l_extendedprice")).alias("amount"), F.when(q % 3 != 0, (q % 60).cast("double")).alias("percent"), (q * 3).alias("days"), (q % 24).alias("months"), (99 + (q % 10) / 10.0).cast("double").alias("uptime_percent"),
        (F.col("l_linestatus") == "O").alias("unilateral"), (q % 2 == 0).alias("survives_termination"), F.lit(None).cast("string").alias("superseded_by"),
        *([F.struct("_metadata.file_path", "_metadata.row_index").alias("place")] if place else []),
    )


CLAIMS = f"""claims AS (SELECT *, CASE WHEN clause_type = 'liability_cap' THEN l_extendedprice END AS amount FROM (
  SELECT l_orderkey AS contract_id, l_orderkey || ':' || l_linenumber AS claim_id, l_linenumber::INT AS seq, {TYPES}[(l_partkey % {len(TYPES)})::INT + 1] AS clause_type,
  CASE l_returnflag WHEN 'A' THEN 'counterparty' WHEN 'N' THEN 'us' ELSE 'mutual' END AS party_favored, l_orderkey AS doc_id, (l_linenumber * 40)::INT AS char_start, (l_linenumber * 40 + l_quantity::INT)::INT AS char_end,
  'line ' || l_quantity::INT AS quote, CASE WHEN l_quantity::INT % 3 <> 0 THEN (l_quantity::INT % 60)::DOUBLE END AS percent, l_quantity::INT * 3 AS days, l_quantity::INT % 24 AS months,
  99 + (l_quantity::INT % 10) / 10.0::DOUBLE AS uptime_percent, l_linestatus = 'O' AS unilateral, l_quantity::INT % 2 = 0 AS survives_termination, l_extendedprice FROM lineitem))"""
