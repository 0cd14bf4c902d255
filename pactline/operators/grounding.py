"""Verbatim grounding: spans checked against texts, pruning, merging and deduplicating of extracted clauses."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as X
from ..plans import dims


def span_reason(text: Column, start: Column, end: Column, quote: Column) -> Column:
    """Null for a span that holds; else the first thing wrong with it."""
    return (
        F.when(text.isNull(), "no such document")
        .when((start < 0) | (end > F.length(text)), "offsets outside the document")
        .when(start >= end, "empty span")
        .when(text.substr(start + 1, end - start) != quote, "text at the offsets differs from the quote")
    )


def verify(items: DataFrame, documents: DataFrame) -> DataFrame:
    """items (doc_id, char_start, char_end, quote, ...) with reason (null if grounded)."""
    d = documents.select("doc_id", F.col("text").alias("_text"))
    return items.join(d, "doc_id", "left").withColumn("reason", span_reason(F.col("_text"), F.col("char_start"), F.col("char_end"), F.col("quote"))).drop("_text")


def verification(verified: DataFrame, by: str = "contract_id") -> DataFrame:
    """Kept and dropped counts, reasons and the grounding rate (1 if nothing was attempted)."""
    kept = F.count_if(F.col("reason").isNull())
    return verified.groupBy(by).agg(kept.alias("kept"), F.count("reason").alias("dropped"), F.array_sort(F.collect_set("reason")).alias("reasons"), F.coalesce(F.try_divide(kept, F.count(F.lit(1))), F.lit(1.0)).alias("grounding_rate"))


def verify_findings(findings: DataFrame, documents: DataFrame) -> DataFrame:
    """findings (finding_id, kind, evidence array of spans): a finding stands when all its spans hold and it has one;
    a missing clause needs none.  Adds reason: that of the first span that fails."""
    spans = findings.select("finding_id", F.posexplode("evidence").alias("pos", "s")).select("finding_id", "pos", "s.*")
    bad = verify(spans, documents).where("reason is not null").groupBy("finding_id").agg(F.min_by("reason", "pos").alias("reason"))
    none = F.when((F.size("evidence") <= 0) & (F.col("kind") != "missing_clause"), "no evidence")
    return findings.join(bad, "finding_id", "left").withColumn("reason", F.when(F.col("kind") != "missing_clause", F.coalesce(none, "reason")))


def prune(raw: DataFrame) -> DataFrame:
    """Wire fields that say nothing become null: empty text, false, and zero too."""
    numbers, words, flags = ("amount", "percent", "days", "months", "uptime_percent"), ("currency", "note"), ("unilateral", "survives_termination")
    zero = {c: F.nullif(F.col(c), F.lit(0)) for c in numbers if c in raw.columns}
    empty = {c: F.nullif(F.col(c), F.lit("")) for c in words if c in raw.columns}
    true = {c: F.when(F.col(c), True) for c in flags if c in raw.columns}
    return raw.withColumns(zero | empty | true)


def drop_overlaps(claims: DataFrame, by: tuple[str, ...] = ("doc_id", "clause_type")) -> DataFrame:
    """Of overlapping spans of a group the longest stays (first on ties); the rest in order of start."""
    rows = F.array_sort(F.collect_list(F.struct((F.col("char_start") - F.col("char_end")).alias("neg"), F.col("seq"), F.col("char_start").alias("s"), F.col("char_end").alias("e"))))
    empty = F.expr("cast(array() as array<struct<neg:int,seq:int,s:int,e:int>>)")
    typed = claims.withColumns({c: F.col(c).cast("int") for c in ("char_start", "char_end", "seq")})
    keep = F.aggregate("rows", empty, lambda acc, x: F.when(F.exists(acc, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])), acc).otherwise(F.array_append(acc, x)))
    kept = typed.groupBy(*by).agg(rows.alias("rows")).select(*by, F.explode(keep).alias("x")).select(*by, F.col("x.seq").alias("seq"))
    return typed.join(kept, [*by, "seq"], "left_semi")


def merge_parts(clauses: DataFrame, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Clauses of overlapping chunks (part, pos): of equal type and fingerprint the first stays.  With one part nothing
    is filtered; with more, those without type or quote go."""
    parts = F.size(F.collect_set("part").over(Window.partitionBy(*key)))
    first = F.row_number().over(Window.partitionBy(*key, "clause_type", X.fingerprint(F.col("quote"))).orderBy("part", "pos"))
    said = (F.coalesce(F.col("clause_type"), F.lit("")) != "") & (F.coalesce(F.col("quote"), F.lit("")) != "")
    return clauses.withColumns({"_n": parts, "_r": first}).where((F.col("_n") < 2) | (said & (F.col("_r") == 1))).drop("_n", "_r")


def merge_rules(rules: DataFrame, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    first = F.row_number().over(Window.partitionBy(*key, "kind", X.fingerprint(F.col("quote")), F.coalesce("offset_days", F.lit(0))).orderBy("part", "pos"))
    return rules.withColumn("_r", first).where("_r = 1").drop("_r")


#: Quotes of one document, and characters of text, that a task takes together.
QUOTES_TOGETHER, TEXT_TOGETHER = 2000, 4 << 20


def locate(quotes: DataFrame, documents: DataFrame) -> DataFrame:
    """quotes (doc_id, quote, ...) with char_start, char_end, how: exact, else whitespace, else fuzzy, else dropped.

    A document's quotes meet its text in one place, so a text is shuffled once and its seeds are sorted once, however many
    quotes it has; those of a document with very many are dealt out, and the text goes to each part.  Documents are taken
    together up to a few million characters, as a group each would cost more than the search."""
    size = documents.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).head()[0]
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(max(1, -(-size // TEXT_TOGETHER))))
    parts = quotes.where("doc_id is not null").groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / QUOTES_TOGETHER).cast("int").alias("_parts"))
    texts = documents.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
    texts = texts.join(parts, F.col("_doc") == F.col("doc_id")).select("_doc", "_text", bucket("_doc").alias("_bucket"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    dealt = quotes.join(parts, "doc_id", "left").withColumn("_part", F.pmod(F.xxhash64("quote"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    held = dealt.where("doc_id is not null").withColumn("_bucket", bucket("doc_id"))
    schema = f"{', '.join(f'`{n}` {t}' for n, t in quotes.dtypes)}, char_start int, char_end int, how string"

    def of(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        asked, said = mine.column("doc_id").to_pylist(), mine.column("quote").to_pylist()
        place = {doc: k for k, doc in enumerate(theirs.column("_doc").to_pylist())}
        found: list = [None] * len(said)
        now, text = None, None
        for k in sorted(range(len(said)), key=lambda k: place.get(asked[k], -1)):  # a document's quotes one after another
            if text is None or asked[k] != now:
                now, at = asked[k], place.get(asked[k])
                text = S.Text((theirs.column("_text")[at].as_py() if at is not None else None) or "")
            found[k] = S.located(text, said[k] or "")
        out = mine.drop_columns(["_part", "_bucket"])
        for k, (name, kind) in enumerate((("char_start", pa.int32()), ("char_end", pa.int32()), ("how", pa.string()))):
            out = out.append_column(name, pa.array([f[k] for f in found], kind))
        return out

    met = held.groupBy("_bucket", "_part").cogroup(texts.groupBy("_bucket", "_part")).applyInArrow(of, schema)
    nowhere = quotes.where("doc_id is null").select("*", F.lit(None).cast("int").alias("char_start"), F.lit(None).cast("int").alias("char_end"), F.lit("dropped").alias("how"))
    return met.select(*quotes.columns, "char_start", "char_end", "how").unionByName(nowhere)


def stats(located: DataFrame, by: str = "doc_id") -> DataFrame:
    return located.groupBy(by).agg(*(F.count_if(F.col("how") == h).alias(h) for h in ("exact", "whitespace", "fuzzy", "dropped")), F.coalesce(F.try_divide(F.count_if(F.col("how") != "dropped"), F.count(F.lit(1))), F.lit(1.0)).alias("rate"))


def ground_clauses(raw: DataFrame, documents: DataFrame, our_party: str, our_role: Column) -> DataFrame:
    """raw clauses -> located, pruned, party resolved, confidence 0.5 by default, overlaps dropped."""
    found = locate(raw.where("clause_type is not null and quote is not null"), documents).where("how <> 'dropped'")
    return drop_overlaps(prune(found).withColumns({"party_favored": X.party(F.col("party_favored"), F.lit(our_party), our_role), "confidence": F.coalesce("confidence", F.lit(0.5))}))


def ground_rules(raw: DataFrame, documents: DataFrame, our_party: str, our_role: Column) -> DataFrame:
    named = raw.withColumns({"kind": X.kind(F.col("kind")), "anchor": X.anchor(F.col("anchor"))}).where("kind is not null and anchor is not null")
    iso = F.when(F.col("recurrence_months") > 0, F.concat(F.lit("P"), F.col("recurrence_months").cast("string"), F.lit("M")))
    return locate(named, documents).where("how <> 'dropped'").withColumns({"recurrence": iso, "offset_days": F.coalesce("offset_days", F.lit(0)), "owed_by": X.owed_by(F.col("owed_by"), F.lit(our_party), our_role)})


CLOSED = {"severity": dims.SEVERITIES, "kind": dims.KINDS, "anchor": dims.ANCHORS}


def outside_vocabulary(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose value is none of the closed vocabulary's."""
    return rows.where(F.col(column).isNotNull() & ~F.col(column).isin(*CLOSED[column]))
