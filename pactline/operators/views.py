"""Views for people: findings and clauses of a contract, its documents as one text, numbered quotes, figures before and
after, notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import family

FINDING = "finding_id string, contract_ids array<string>, kind string, severity string, title string, evidence array<struct<doc_id:string,char_start:int,char_end:int,quote:string>>"
SPAN = "struct<doc_id:string,char_start:int,char_end:int,quote:string>"
JOIN = "\n\n\n"


def _spans(evidence: Column | str) -> Column:
    return F.transform(evidence, lambda s: F.struct(s["doc_id"].cast("string").alias("doc_id"), s["char_start"].cast("int").alias("char_start"), s["char_end"].cast("int").alias("char_end"), s["quote"].alias("quote")))


def _finding(df: DataFrame, id_: Column, kind: str, severity: Column, title: Column, evidence: Column) -> DataFrame:
    return df.select(id_.alias("finding_id"), F.array(F.col("contract_id").cast("string")).alias("contract_ids"), F.lit(kind).alias("kind"), severity.alias("severity"), title.alias("title"), evidence.alias("evidence"))


def findings(silence: DataFrame, patterns: DataFrame, asymmetry: DataFrame, injections: DataFrame, owners: DataFrame) -> DataFrame:
    """All findings in one shape: missing clauses (without evidence), one-sided terms, imbalance, injections.  owners
    (doc_id, contract_id) says whose documents the injections stand in."""
    none, contract = F.array().cast(f"array<{SPAN}>"), F.col("contract_id").cast("string")
    name = lambda *parts: F.concat_ws("_", *(F.lit(p) if isinstance(p, str) else p for p in parts))
    out = _finding(silence, name("missing", contract, F.col("clause_type")), "missing_clause", F.col("severity"), F.concat(F.lit("No "), F.replace("clause_type", F.lit("_"), F.lit(" ")), F.lit(" clause")), none)
    out = out.unionByName(_finding(patterns, name("adv", contract, F.col("key"), F.col("seq").cast("string")), "adversarial_pattern", F.col("severity"), F.replace("key", F.lit("_"), F.lit(" ")), _spans("evidence")))
    uneven = asymmetry.where("severity is not null")
    out = out.unionByName(_finding(uneven, name("asym", contract), "asymmetry", F.col("severity"), F.concat(F.col("their_rights").cast("string"), F.lit(" rights of theirs against "), F.col("our_rights").cast("string"), F.lit(" of ours")), none))
    owned = injections.join(owners.select("doc_id", "contract_id"), "doc_id")
    return out.unionByName(_finding(owned, F.col("finding_id"), "injection", F.col("severity"), F.col("title"), _spans("evidence")))


def of_contract(all_findings: DataFrame, gap_findings: DataFrame, contract_id: str) -> DataFrame:
    """A contract's own findings and the gaps that name it, worst first."""
    both = all_findings.unionByName(gap_findings, allowMissingColumns=True).where(F.array_contains("contract_ids", contract_id))
    return both.orderBy(X.severity_rank(F.col("severity")), "kind", "finding_id")


def gap_findings(gaps: DataFrame) -> DataFrame:
    ids = F.transform("contract_ids", lambda x: x.cast("string"))
    title = F.concat_ws(" ", F.col("key"), F.lit("promised to"), F.col("out_title"), F.lit("but not by"), F.col("in_title"))
    return gaps.select(F.concat_ws("_", F.lit("gap"), "key", F.col("out_id").cast("string"), F.col("in_id").cast("string")).alias("finding_id"), ids.alias("contract_ids"), F.lit("gap").alias("kind"), "severity", title.alias("title"), _spans("evidence").alias("evidence"))


def clause_listing(claims: DataFrame, documents: DataFrame, effective_only: bool = True) -> DataFrame:
    """Clauses with the document and page that they stand on and what they replaced."""
    pages = documents.select(F.col("doc_id").alias("_d"), "filename", "pages")
    shown = claims.where("superseded_by is null") if effective_only else claims
    page = F.get(F.filter("pages", lambda p: (F.col("char_start") >= p["char_start"]) & (F.col("char_start") < p["char_end"])), 0)["page"]
    chains = family.lineage(claims, documents).withColumnRenamed("claim_id", "_c")
    out = shown.join(pages, shown["doc_id"] == pages["_d"], "left").withColumn("page", page)
    return out.join(chains, out["claim_id"].cast("string") == chains["_c"], "left").drop("_c", "_d", "pages")


def contract_detail(contracts: DataFrame, documents: DataFrame, axes: DataFrame, obligations: DataFrame) -> DataFrame:
    """A contract with its documents in order, its scores by axis and its number of obligations."""
    docs = documents.groupBy("contract_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "doc_id", "filename"))), lambda d: d["filename"]).alias("files"))
    scores = axes.groupBy("contract_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("axis", "score")))).alias("scores"))
    due = obligations.groupBy("contract_id").agg(F.count(F.lit(1)).alias("n_obligations"))
    out = contracts
    for part in (docs, scores, due):
        out = out.join(part, "contract_id", "left")
    return out.na.fill(0, ["n_obligations"])


def combined(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents (contract_id, doc_id, seq, text) -> (contract_id, text of all joined by blank lines), and (contract_id,
    doc_id, base): the place at which each document begins there."""
    before = Window.partitionBy("contract_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum(F.length("text") + len(JOIN)).over(before), F.lit(0)).cast("int")
    rows = F.array_sort(F.collect_list(F.struct("seq", "text")))
    whole = documents.groupBy("contract_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), JOIN).alias("text"))
    return whole, documents.select("contract_id", "doc_id", base.alias("base"))


def quote_registry(spans: DataFrame) -> DataFrame:
    """spans (contract_id, pos, doc_id, char_start, char_end, quote) -> quote_id q1, q2, ... by first use in each
    contract; of equal places the first wins."""
    place = ["contract_id", "doc_id", "char_start", "char_end"]
    first = spans.groupBy(*place).agg(F.min("pos").alias("pos"), F.min_by("quote", "pos").alias("quote"))
    number = F.row_number().over(Window.partitionBy("contract_id").orderBy("pos", "doc_id", "char_start", "char_end"))
    return first.select(*place, "quote", F.concat(F.lit("q"), number.cast("string")).alias("quote_id"))


def interface_counts(contracts: DataFrame, claims: DataFrame, all_findings: DataFrame, obligations: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row of counts; subtract two of them with delta()."""
    n = F.count(F.lit(1))
    parts = [contracts.agg(n.alias("contracts")), claims.where("superseded_by is null").agg(n.alias("claims")), all_findings.agg(n.alias("findings")), obligations.agg(n.alias("obligations")), gaps.agg(n.alias("gaps"))]
    out = parts[0]
    for p in parts[1:]:  # each is a single row
        out = out.crossJoin(p)
    return out


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """What changed between two rows of counts."""
    b = before.select(*(F.col(c).alias(f"_{c}") for c in before.columns))
    return after.crossJoin(b).select(*((F.col(c) - F.col(f"_{c}")).alias(c) for c in after.columns))


def urgency(days: Column, headline: Column) -> Column:
    """MISSED: a headline deadline that is past; urgent: any that is past, or a headline one within 90 days."""
    return F.when((days < 0) & headline, "MISSED").when((days < 0) | (headline & (days <= 90)), "urgent").otherwise("")


def notices(obligations: DataFrame, quarantined: DataFrame, all_findings: DataFrame, rates: DataFrame, headline: Column) -> DataFrame:
    """One row: missed deadlines, those of the next 90 days, contracts held back for a quarantined document, findings
    without evidence, the least grounding rate."""
    d = F.col("days_remaining")
    due = obligations.agg(F.count_if((d < 0) & headline).alias("missed"), F.count_if(d.between(0, 90)).alias("next90"))
    held = quarantined.where("quarantined").agg(F.count_distinct("contract_id").alias("held"))
    bare = all_findings.agg(F.count_if(F.size("evidence") <= 0).alias("absence"))
    rate = rates.agg(F.coalesce(F.min("grounding_rate"), F.lit(1.0)).alias("grounding_rate"))
    return due.crossJoin(held).crossJoin(bare).crossJoin(rate)  # each is a single row


def ordered(rows: DataFrame, what: str) -> DataFrame:
    """Rows in the order in which they are shown: obligations, deadlines, calendar, compare, newest."""
    by = {
        "obligations": ["due_date", "seq", "occurrence"], "deadlines": ["days_remaining", "contract_id", "seq", "occurrence"],
        "calendar": ["date", "kind", "contract_id"], "compare": [F.desc_nulls_last("value"), "contract_id"], "newest": [F.desc("created_at")],
    }
    return rows.orderBy(*by[what])


def quote_places(quotes: DataFrame, documents: DataFrame) -> DataFrame:
    """quotes (quote_id, doc_id, quote, char_start, char_end) -> quote_id, doc_id, quote, char_start, char_end, verified: the
    offsets given, where the text there is the quote; else the first place of the quote in the text; else null."""
    d = documents.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
    j = quotes.join(d, F.col("doc_id") == F.col("_doc"), "left")
    size = F.col("char_end") - F.col("char_start")
    holds = F.coalesce((F.col("char_start") >= 0) & (size > 0) & (F.col("_text").substr(F.col("char_start") + 1, size) == F.col("quote")), F.lit(False))
    found = F.when(F.length("quote") > 0, F.nullif(F.expr("locate(quote, _text)"), F.lit(0)) - 1)
    start = F.when(holds, F.col("char_start")).otherwise(found)
    return j.select("quote_id", "doc_id", "quote", start.alias("char_start"), (start + F.length("quote")).alias("char_end"), holds.alias("verified"))


def sentences(obligations: DataFrame, contracts: DataFrame) -> DataFrame:
    """contract_id, rule_id, due_date, sentence: what an obligation asks for, in words.  A notice about the end of the term
    speaks of the renewal, with the year's value where there is one; a consequence that is told at length speaks for itself."""
    k = contracts.select(F.col("contract_id").alias("_k"), F.coalesce(F.nullif("counterparty", F.lit("")), F.lit("the counterparty")).alias("party"), F.nullif("annual_value", F.lit(0.0)).alias("value"))
    j = obligations.join(k.hint("merge"), F.col("contract_id") == F.col("_k"))  # contracts grow: never a broadcast
    day = F.date_format("due_date", "d MMMM")
    renews = (F.col("kind") == "notice") & (F.col("anchor") == "term_end")
    said = F.when(F.length("consequence") > 25, F.col("consequence")) if "consequence" in obligations.columns else F.lit(None).cast("string")
    at = lambda words: F.when(F.col("value").isNotNull(), F.concat(F.lit(words), X.money(F.col("value")), F.lit("."))).otherwise(".")
    text = (
        F.when(renews & (F.col("days_remaining") < 0), F.concat(F.lit("Too late to stop the renewal since "), day, at("; the new term costs ")))
        .when(renews, F.concat(F.lit("Tell "), "party", F.lit(" in writing by "), day, F.lit(", else the term renews"), at(" at ")))
        .when(said.isNotNull(), said)
        .when(F.col("kind") == "report", F.concat(F.lit("A written report to "), "party", F.lit(" is due, as every time.")))
        .when(F.col("kind") == "payment", F.concat(F.lit("A payment to "), "party", F.lit(" is due.")))
        .when(F.col("kind") == "expiry", F.concat(F.lit("What was agreed with "), "party", F.lit(" ends.")))
        .when(F.col("kind") == "cure", F.lit("Last day to put a breach right."))
        .when(F.col("kind") == "notice", F.concat(F.lit("Last day for written notice to "), "party", F.lit(".")))
        .otherwise(F.concat("kind", F.lit(" due.")))
    )
    return j.select("contract_id", "rule_id", "due_date", text.alias("sentence"))
