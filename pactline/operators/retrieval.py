"""Search: records and passages, BM25, boosts, vectors, rank fusion, diversification.

Corpus tables are tokenised once and shuffled by document; the query side is a handful of terms on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import dims
from ..shipping import cut
from .rules import effective

K1, B, RRF_K = 1.5, 0.75, 60


def query_terms(question: str, stopwords=None) -> list[str]:
    stop = set(dims.PASSAGE_STOPWORDS if stopwords is None else stopwords)
    return [w for w in re.findall(dims.WORD, question.lower()) if len(w) > 1 and w not in stop]


def term_table(docs: DataFrame, text: str = "text", id_col: str = "id", stopwords=None) -> DataFrame:
    """id, term, tf, len: one pass over the texts; a text without tokens has no row."""
    toks = docs.select(id_col, X.tokens(F.col(text), stopwords).alias("t"))
    return toks.select(id_col, F.size("t").alias("len"), F.explode("t").alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))


def corpus(docs: DataFrame, text: str = "text", stopwords=None) -> DataFrame:
    """One row: number of documents and mean length."""
    return docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.size(X.tokens(F.coalesce(F.col(text), F.lit("")), stopwords))), F.lit(0.0)).alias("avg_len"))


def frequencies(docs: DataFrame, text: str = "text", stopwords=None) -> DataFrame:
    """term, df: a document's own terms are made distinct in its row, so only one count by term is shuffled."""
    own = docs.select(F.explode(F.array_distinct(X.tokens(F.col(text), stopwords))).alias("term"))
    return own.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def bm25(docs: DataFrame, terms: list[str], text: str = "text", id_col: str = "id", stopwords=None, scope: Column | None = None) -> DataFrame:
    """id, score > 0.  A query term that is given twice counts twice.  Statistics are those of the whole corpus even
    where scope narrows the answer.  Only documents with a query term are counted term by term."""
    times: dict[str, int] = {}
    for w in terms:
        times[w] = times.get(w, 0) + 1
    inside = F.lit(True) if scope is None else scope
    held = [F.col("tf")[i] for i in range(len(times))]
    count = lambda t, w: F.size(F.filter(t, lambda x: x == w))
    tokens = X.tokens(F.coalesce(F.col(text), F.lit("")), stopwords)
    # the array is bound to a variable, so that a text is split once
    read = F.transform(F.array(tokens), lambda t: F.struct(F.size(t).alias("len"), F.array(*(count(t, w) for w in times)).cast("array<int>").alias("tf")))
    rows = docs.select(id_col, inside.alias("_in"), F.get(read, F.lit(0)).alias("r")).select(id_col, "_in", "r.*")
    stats = rows.agg(F.count(F.lit(1)).alias("_n"), F.avg("len").alias("_avg"), F.array(*(F.count_if(f > 0) for f in held)).cast("array<bigint>").alias("_df"))
    length = K1 * (1 - B + B * F.greatest("len", F.lit(1)) / F.when(F.col("_avg") > 0, F.col("_avg")).otherwise(1.0))
    score = F.lit(0.0)
    for i, (f, k) in enumerate(zip(held, times.values(), strict=True)):
        score = score + F.when(f > 0, k * idf(F.col("_n"), F.col("_df")[i]) * f * (K1 + 1) / (f + length)).otherwise(0.0)
    return rows.where("_in").crossJoin(F.broadcast(stats)).select(id_col, score.alias("score")).where("score > 0")  # stats: one row


def boost(question: str) -> Column:
    """What the words of a question add to a record (kind, anchor, clause_type, side, contract).  The question is
    looked at once, here; per record only a sum is left."""
    q = question.lower()
    has = lambda words: any(w in q for w in words)
    kind, out = F.col("kind"), F.lit(0.0)
    add = lambda cond, points: F.when(F.coalesce(cond, F.lit(False)), points).otherwise(0.0)
    if has(dims.TIME_WORDS):
        out = out + add(kind == "obligation", 2.0)
    if has(dims.RENEWAL_WORDS):
        out = out + F.when((kind == "obligation") & F.coalesce(F.col("anchor") == "term_end", F.lit(False)), 6.0).when(kind == "obligation", 0.5).when(F.col("clause_type").isin("auto_renewal", "notice_period", "termination_for_convenience"), 3.0).otherwise(0.0)
    for words, kinds, points in ((dims.ABSENCE_WORDS, ["absence"], 3.0), (dims.RISK_WORDS, ["finding", "gap"], 3.0), (dims.CROSS_WORDS, ["gap"], 5.0), (dims.MONEY_WORDS, ["fact"], 1.5)):
        if has(words):
            out = out + add(kind.isin(*kinds), points)
    sided = "buyer" if has(dims.SUPPLIER_WORDS) else "seller" if has(dims.CUSTOMER_WORDS) else None
    if sided:
        out = out + F.when(F.coalesce(F.col("side"), F.lit("")) == "", 0.0).when(F.col("side") == sided, 6.0).otherwise(-5.0)
    names = F.filter(F.split(F.replace(F.lower(F.coalesce("contract", F.lit(""))), F.lit("/"), F.lit(" ")), r"\s+"), lambda w: F.length(w) > 3)
    return out + add(F.exists(names, lambda w: F.contains(F.lit(q), F.regexp_replace(w, "^[,.]+|[,.]+$", ""))), 3.0)


def cosine(a: Column, b: Column) -> Column:
    """Dot product over norms; a zero norm counts as 1."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.sqrt(dot(x, x))
    one = lambda n: F.when(n == 0, 1.0).otherwise(n)
    return dot(a, b) / (one(norm(a)) * one(norm(b)))


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", scope: Column | None = None) -> DataFrame:
    v = vectors if scope is None else vectors.where(scope)
    q = F.array(*(F.lit(float(x)) for x in query))
    return v.select(id_col, cosine(F.col("embedding"), q).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def ranked(hits: DataFrame, id_col: str = "id", most: int | None = None, buckets: int = 256) -> DataFrame:
    """id, rank from 0 by score; most keeps the window to a bounded list (top-k first, then ranked).  Without it, hits
    are dealt into buckets of scores; a rank is the place in the bucket after those of the buckets above."""
    order = (F.desc("score"), F.col(id_col))
    if most is not None:
        best = hits.orderBy(*order).limit(most)
        return best.select(id_col, (F.row_number().over(Window.orderBy(*order)) - 1).alias("rank"))
    cuts = hits.agg(F.array_distinct(F.percentile_approx("score", F.array(*(F.lit(i / buckets) for i in range(1, buckets))), F.lit(10_000))).alias("_cuts"))
    dealt = hits.crossJoin(F.broadcast(cuts)).select(id_col, "score", F.size(F.filter("_cuts", lambda c: c > F.col("score"))).alias("_b"))  # cuts: one row
    sums = dealt.groupBy("_b").agg(F.count(F.lit(1)).alias("n"))  # a row a bucket
    above = F.coalesce(F.sum("n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(*order)) - 1
    return dealt.withColumn("_p", place).join(F.broadcast(sums.select("_b", above.alias("_above"))), "_b").select(id_col, (F.col("_p") + F.col("_above")).cast("int").alias("rank"))


def fuse(*rankings: DataFrame, id_col: str = "id", k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: 1 / (k + rank + 1) summed."""
    every = rankings[0].select(id_col, "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select(id_col, "rank"))
    return every.groupBy(id_col).agg(F.sum(1.0 / (k + F.col("rank") + 1)).alias("score"))


def diversify(hits: DataFrame, k: int, by: str = "contract_id", per: int = 4, id_col: str = "id") -> DataFrame:
    """At most `per` hits of a contract, then the best k."""
    r = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), id_col))
    return hits.withColumn("_r", r).where(F.col("_r") <= per).drop("_r").orderBy(F.desc("score"), id_col).limit(k)


def hybrid(records: DataFrame, passages: DataFrame, vectors: DataFrame | None, question: str, query: list[float] | None, k: int = 8, contract_id: str | None = None, include: list[str] | None = None) -> DataFrame:
    """Lexical (2k records with boosts, all matching passages at three quarters) and semantic (2k) lists, fused,
    narrowed to kinds and known ids, diversified."""
    inside = lambda c: F.lit(True) if contract_id is None else F.col(c) == contract_id
    searchable = records.withColumn("_t", F.concat_ws(" ", "contract", "kind", "title", "body", "quote"))
    rec = bm25(searchable, query_terms(question, dims.STOPWORDS), "_t", stopwords=dims.STOPWORDS, scope=inside("contract_id"))
    boosted = records.where(inside("contract_id")).join(rec, "id", "left").select("id", "contract_id", "kind", (F.coalesce("score", F.lit(0.0)) + boost(question)).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(2 * k)
    pas = bm25(passages.withColumn("_t", F.concat_ws(" ", "text", "section", "contract")), query_terms(question), "_t", scope=inside("contract_id"))
    known = records.select("id", "contract_id", "kind").unionByName(passages.select("id", "contract_id", F.lit("passage").alias("kind")))
    lexical = boosted.select("id", "score").unionByName(pas.select("id", (F.col("score") * 0.75).alias("score")))
    lists = [ranked(cut(lexical))]  # ids and scores; a rank reads them several times, and the texts behind them would be split as often
    if vectors is not None and query is not None:
        lists.append(ranked(nearest(vectors, query, 2 * k, scope=inside("contract_id")).join(known, "id", "left_semi")))
    hits = fuse(*lists).join(known, "id")
    return diversify(hits.where(F.col("kind").isin(*include)) if include else hits, k)


def records(contracts: DataFrame, claims: DataFrame, obligations: DataFrame, findings: DataFrame, gaps: DataFrame) -> DataFrame:
    """Everything that can be asked about, in one shape: facts, clauses, obligations, findings and absences, gaps."""
    none = F.lit(None).cast("string")
    name = contracts.select("contract_id", F.coalesce("counterparty", "title").alias("contract"), F.col("our_role").alias("side")).hint("merge")  # contracts grow: never a broadcast
    cols = ["id", "contract_id", "contract", "kind", "title", "body", "quote", "anchor", "clause_type", "side"]
    shape = lambda df, **c: df.select(*(c[n].alias(n) if n in c else F.col(n) for n in cols))
    value = F.when(F.col("annual_value") != 0, F.concat(F.lit("Annual value "), F.format_number("annual_value", 0), F.lit(" "), F.col("currency"), F.lit(".")))
    fact = contracts.join(name, "contract_id")
    out = shape(fact, id=F.concat("contract_id", F.lit(":fact")), kind=F.lit("fact"), title=F.concat(F.lit("Key facts: "), "contract"), body=F.concat_ws(" ", "contract", "contract_type", "our_role", F.concat(F.lit("effective "), F.col("effective_date").cast("string")), value), quote=none, anchor=none, clause_type=none)
    stated = F.array_join(F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in (*dims.MEASURED, "unilateral", "survives_termination")))), ", ")
    clause = effective(claims).join(name, "contract_id")
    out = out.unionByName(shape(clause, id=F.col("claim_id"), kind=F.lit("clause"), title=F.concat_ws(" - ", "clause_type", "contract"), body=F.concat_ws(". ", "clause_type", F.concat(F.lit("favours "), "party_favored"), stated), anchor=none))
    due = F.col("due_date").cast("string")
    ob = obligations.join(name, "contract_id")
    out = out.unionByName(shape(ob, id=F.concat_ws(":", "contract_id", F.lit("ob"), "rule_id", due), kind=F.lit("obligation"), title=F.concat_ws(" ", "kind", F.lit("deadline"), due, "contract"), body=F.concat_ws(" ", "description", F.lit("owed by"), "owed_by", F.array_join("derivation", " | ")), quote=none, clause_type=none))
    fi = findings.withColumn("contract_id", F.get("contract_ids", F.lit(0))).join(name, "contract_id")
    ev = F.get("evidence", F.lit(0))["quote"]
    out = out.unionByName(shape(fi, id=F.col("finding_id"), kind=F.when(F.col("kind") == "missing_clause", "absence").otherwise("finding"), body=F.concat_ws(" ", "kind", F.lit("severity"), "severity"), quote=ev, anchor=none, clause_type=none))
    gap = gaps.withColumns({"contract_id": F.col("out_id"), "contract": F.concat_ws(" / ", "out_title", "in_title")})
    return out.unionByName(shape(gap, id=F.concat_ws(":", F.lit("gap"), "key", "out_id", "in_id"), kind=F.lit("gap"), title=F.concat_ws(" ", "key", "out_text", F.lit("against"), "in_text"), body=F.concat_ws(" ", F.lit("flow-down gap"), "key", "severity"), quote=F.get("evidence", F.lit(0))["quote"], anchor=none, clause_type=none, side=none))


def citations(ids: DataFrame, known: DataFrame) -> DataFrame:
    """ids (pos, id) that are known, in order, each record once.  An id that no record has may be that of a contract,
    which stands for its facts."""
    own = known.select(F.col("id").alias("_id"))
    facts = known.where(F.endswith("id", F.lit(":fact"))).select(F.col("id").alias("_fact"))
    named = ids.join(own, ids["id"] == own["_id"], "left").join(facts, F.concat(ids["id"], F.lit(":fact")) == facts["_fact"], "left")
    named = named.select("pos", F.coalesce("_id", "_fact").alias("id")).where("id is not null")
    first = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    return named.withColumn("_r", first).where("_r = 1").drop("_r").join(known, "id").orderBy("pos")


def mentioned(text: str, known: DataFrame) -> DataFrame:
    """Records whose id stands in a text."""
    return known.where(F.contains(F.lit(text), F.col("id")))


def for_model(records: DataFrame) -> DataFrame:
    """What of a record a model is shown: its quote at most 320 characters."""
    return records.select("id", "kind", "contract", "title", "body", F.substring("quote", 1, 320).alias("quote"))


def keyword_answer(hits: DataFrame, k: int = 12, cited: int = 6) -> DataFrame:
    """One row for an answer without a model: the ids of the best hits to cite, and up to three contract names."""
    best = hits.orderBy(F.desc("score"), "id").limit(k)
    rows = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, cited)
    return best.agg(F.transform(rows, lambda x: x["id"]).alias("citations"), F.slice(F.array_sort(F.collect_set("contract")), 1, 3).alias("contracts"))


def infer_contract(question: str, contracts: DataFrame, generic: tuple[str, ...] = ()) -> DataFrame:
    """The one contract that a question names by a distinctive word; no row if none or several are named."""
    q = f" {re.sub(r'[^a-z0-9]+', ' ', question.lower())} "
    words = contracts.select("contract_id", F.explode(F.split(F.lower(F.coalesce("counterparty", "title")), "[^a-z0-9]+")).alias("w")).where((F.length("w") > 3) & (~F.col("w").isin(*generic) if generic else F.lit(True)))
    named = words.where(F.contains(F.lit(q), F.concat(F.lit(" "), "w", F.lit(" ")))).select("contract_id").distinct()
    return named.agg(F.count(F.lit(1)).alias("n"), F.min("contract_id").alias("contract_id")).where("n = 1").select("contract_id")
