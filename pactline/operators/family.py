"""Document families: order, supersession by amendments, lineage, effective date, annual value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import temporal as T
from ..plans import dims
from ..shipping import cut

AMENDMENT_NO = r"(?i)amendment\s+(?:no\.?|number)\s*(\d+)"


def order_documents(documents: DataFrame) -> DataFrame:
    """documents (contract_id, doc_id, seq, filename, contract_type, text) with doc_rank: base documents as given, then
    amendments by number (in the text's head, else the file name), else by date, then file name."""
    number = F.coalesce(*(F.nullif(F.regexp_extract(c, AMENDMENT_NO, 1), F.lit("")).cast("int") for c in (F.substring("text", 1, 400), F.col("filename"))))
    signed = F.datediff(T.parse_date(F.substring("text", 1, 600)), F.lit("0001-01-01").cast("date")) + 1
    amends = (F.col("contract_type") == "amendment").cast("int")
    d = documents.withColumn("_a", amends).withColumn("_n", F.when(F.col("_a") == 1, F.coalesce(number, signed, F.lit(0))).otherwise(F.col("seq"))).withColumn("_f", F.when(F.col("_a") == 1, F.col("filename")).otherwise(""))
    return d.withColumn("doc_rank", F.row_number().over(Window.partitionBy("contract_id").orderBy("_a", "_n", "_f", "seq"))).drop("_a", "_n", "_f")


def supersede(claims: DataFrame, ordered: DataFrame) -> DataFrame:
    """claims with superseded_by and supersedes.  In each contract and clause type the first claim holds; a later one
    takes over if it stands in another document, an amendment, and measures something the holder measures (or either
    measures nothing).  Types that may stand side by side are left alone."""
    measured = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in dims.MEASURED)))
    c = claims.join(ordered.select("doc_id", "doc_rank", (F.col("contract_type") == "amendment").alias("amends")), "doc_id").withColumn("measured", measured)
    row = F.struct("doc_rank", "seq", "claim_id", "doc_id", "amends", "measured")
    kind = c.select(row.alias("r")).schema["r"].dataType.simpleString()
    start = F.struct(F.lit(None).cast(kind).alias("held"), F.expr("cast(array() as array<struct<new:string,old:string>>)").alias("links"))

    def step(acc, x):
        h = acc["held"]
        takes = (h["doc_id"] != x["doc_id"]) & x["amends"] & ((F.size(h["measured"]) == 0) | (F.size(x["measured"]) == 0) | F.arrays_overlap(h["measured"], x["measured"]))
        link = F.struct(x["claim_id"].cast("string").alias("new"), h["claim_id"].cast("string").alias("old"))
        return F.when(h.isNull(), F.struct(x.alias("held"), acc["links"].alias("links"))).when(takes, F.struct(x.alias("held"), F.array_append(acc["links"], link).alias("links"))).otherwise(acc)

    groups = c.where(~F.col("clause_type").isin(*dims.MULTI_INSTANCE)).groupBy("contract_id", "clause_type").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    links = groups.select(F.explode(F.aggregate("rows", start, step, lambda a: a["links"])).alias("l")).select("l.new", "l.old")
    out = claims.drop("superseded_by", "supersedes")
    new, old = links.select(F.col("new").alias("_n"), F.col("old").alias("supersedes")), links.select(F.col("old").alias("_o"), F.col("new").alias("superseded_by"))
    out = out.join(new, out["claim_id"].cast("string") == new["_n"], "left").drop("_n")
    return out.join(old, out["claim_id"].cast("string") == old["_o"], "left").drop("_o")


def lineage(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """claim_id, lineage: what set the clause and what it replaced, to the end of the chain, each clause once.

    Chains are doubled: in each round a chain that is still open takes over the chain of the clause it has come to, so
    a chain of n clauses takes log2(n) rounds.  A circle ends where a clause comes up again."""
    names = documents.select(F.col("doc_id").alias("_d"), "filename")
    c = claims.join(names, F.col("doc_id") == F.col("_d"), "left").select(F.col("claim_id").cast("string").alias("claim_id"), F.coalesce("filename", F.col("doc_id").cast("string")).alias("file"), F.col("supersedes").cast("string").alias("next"))
    walk = cut(c.select("claim_id", F.array(F.struct(F.col("claim_id").alias("id"), "file")).alias("chain"), "next"))
    done, open_ = [walk.where("next is null")], walk.where("next is not null")
    while not open_.isEmpty():
        known = reduce(DataFrame.unionByName, [*done, open_]).select(F.col("claim_id").alias("_id"), F.col("chain").alias("_chain"), F.col("next").alias("_next"))
        joined = open_.join(known, open_["next"] == known["_id"], "left").withColumn("_all", F.when(F.col("_id").isNull(), F.col("chain")).otherwise(F.concat("chain", "_chain")))
        once = joined.withColumn("chain", F.array_distinct("_all"))
        open_ = cut(once.select("claim_id", "chain", F.when(F.size("chain") == F.size("_all"), F.col("_next")).alias("next")))
        done, open_ = [*done, open_.where("next is null")], open_.where("next is not null")
    text = F.transform("chain", lambda x, i: F.concat(F.when(i == 0, "set by ").otherwise("supersedes "), x["file"]))
    return reduce(DataFrame.unionByName, done).select("claim_id", F.array_join(text, "; ").alias("lineage"))


def annual_value(claims: DataFrame) -> DataFrame:
    """The first minimum commitment's amount, else the largest amount whose quote speaks of a year."""
    c = claims.where(F.col("superseded_by").isNull() & F.col("amount").isNotNull() & ~F.col("clause_type").isin(*dims.NOT_VALUE))
    first = F.min_by(F.when(F.col("clause_type") == "minimum_commitment", F.col("amount")), F.when(F.col("clause_type") == "minimum_commitment", F.col("seq")))
    return c.groupBy("contract_id").agg(F.coalesce(first, F.max(F.when(F.col("quote").rlike(dims.ANNUAL), F.col("amount")))).alias("annual_value"))


def facts(documents: DataFrame) -> DataFrame:
    """contract_id, effective_date (first document that can carry one, else any), contract_type (first that is no
    amendment or order form)."""
    d = order_documents(documents).withColumn("date", T.parse_date(F.substring("text", 1, 1200)))
    bears = F.col("contract_type").isin("order_form", "msa", "nda", "sow") & F.col("date").isNotNull()
    base = ~F.col("contract_type").isin("amendment", "order_form", "unknown")
    first = lambda what, when, by: F.min_by(F.when(when, F.col(what)), F.when(when, F.col(by)))
    return d.groupBy("contract_id").agg(F.coalesce(first("date", bears, "doc_rank"), first("date", F.col("date").isNotNull(), "seq")).alias("effective_date"), F.coalesce(first("contract_type", base, "seq"), F.lit("unknown")).alias("contract_type"), F.array_sort(F.collect_list(F.struct("seq", "doc_id"))).alias("_d")).withColumn("doc_ids", F.transform("_d", lambda x: x["doc_id"])).drop("_d")
