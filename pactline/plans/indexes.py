"""Queries that go through stored indexes, and others that need an algorithm of their own, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tolerant
from ..operators import documents as D
from ..operators import evaluate, mentions, portfolio
from ..operators.postings import PostingsIndex
from ..operators.vectors import VectorIndex
from ..shipping import folder
from ..sources.versions import Versions
from .analogues import table
from .registry import GAPS, STOP, TOKENS, _chain, _longs, query

BATCH_BM25 = f"""{TOKENS}, n AS (SELECT count(*) AS n, avg(coalesce(len(t), 0)) AS a FROM toks),
q AS (SELECT item_id AS qid, term, count(*) AS times FROM (SELECT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9$%.]+'), lambda w: length(w) > 1 AND NOT list_contains({STOP}, w))) AS term FROM benchmark) GROUP BY 1, 2),
tf AS (SELECT doc_id, l, term, count(*) AS f FROM (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM toks) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT qid, doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * greatest(l, 1) / a))) AS score FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY 1, 2)"""


@query(f"WITH {BATCH_BM25} SELECT qid, doc_id AS id, round(score, 6) AS score FROM bm QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) <= 10")
def q_search_batch(spark, sf_dir):
    """Every benchmark passage as a question: its ten best documents, from a stored index."""
    index = PostingsIndex.build(table(spark, sf_dir, "documents"), folder(spark, "postings"), id_col="doc_id")
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return index.search(questions, 10).select("qid", "id", F.round("score", 6).alias("score"))


@query("""SELECT a.vec_id AS qid, b.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) <= 20""")
def q_vector_topk(spark, sf_dir):
    """The twenty nearest of all vectors to each of a stated set, through the index by cells with its exact bound."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = VectorIndex.build(v, folder(spark, "cells"))
    return index.search(v.where("id % 50 = 0").withColumnRenamed("id", "qid"), 20, exact=True).select("qid", "id", F.round("score", 6).alias("score"))


@query("""WITH n AS (SELECT item_id, substr(text, 3, 16) AS name FROM benchmark) SELECT doc_id AS id, item_id AS name_id, strpos(text, name) - 1 AS first, NOT contains(substr(text, strpos(text, name) + 1), name) AS once
FROM documents JOIN n ON contains(text, name)""")
def q_mentions(spark, sf_dir):
    """Sixteen letters of each benchmark passage, sought in every document."""
    names = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("name_id"), F.substring("text", 3, 16).alias("name"))
    found = mentions.find(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), names)
    return found.select("id", "name_id", "first", (F.col("n") == 1).alias("once"))


@query("""WITH c AS (SELECT c_custkey, unnest(list_distinct(regexp_split_to_array(lower(c_name), '[^a-z0-9]+'))) AS w FROM customer), o AS (SELECT o_orderkey, unnest(list_distinct(regexp_split_to_array(lower('When does Customer#' || lpad((o_custkey % 2000)::VARCHAR, 9, '0') || ' renew?'), '[^a-z0-9]+'))) AS w FROM orders)
SELECT o_orderkey AS id, min(c_custkey) AS contract_id FROM o JOIN c USING (w) WHERE length(w) > 3 AND w <> 'customer' GROUP BY 1 HAVING min(c_custkey) = max(c_custkey)""")
def q_named_contracts(spark, sf_dir):
    """A question for each order, that names a customer, against all customers."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("contract_id"), F.col("c_name").alias("counterparty"), F.lit("").alias("title"))
    name = F.lpad((F.col("o_custkey") % 2000).cast("string"), 9, "0")
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("When does Customer#"), name, F.lit(" renew?")).alias("text"))
    return mentions.named_contracts(asked, c, ("customer",))


@query("""WITH RECURSIVE marks AS (SELECT l_orderkey AS doc, l_linenumber AS seq, (max(l_partkey) % 50)::INT AS a, (max(l_partkey) % 50 + 1 + max(l_suppkey) % 15)::INT AS b, max(l_returnflag) AS kind FROM lineitem GROUP BY 1, 2),
w AS (SELECT o_orderkey AS doc, 0 AS n, 0 AS a, 0 AS cur, NULL::VARCHAR AS kind FROM orders
  UNION ALL SELECT w.doc, w.n + 1, m.a, least(m.b, 60), m.kind FROM w JOIN marks m ON m.doc = w.doc AND m.a >= w.cur AND m.a < 60 QUALIFY row_number() OVER (PARTITION BY w.doc ORDER BY m.a, m.seq) = 1),
e AS (SELECT *, coalesce(lead(a) OVER (PARTITION BY doc ORDER BY n), 60) AS next FROM w)
SELECT doc AS doc_id, a AS char_start, cur AS char_end, kind FROM e WHERE n > 0 UNION ALL SELECT doc, cur, next, NULL FROM e WHERE next > cur""")
def q_segments(spark, sf_dir):
    """An order's lines as marks that nest and overlap in a text of sixty letters."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq")).agg((F.max("l_partkey") % 50).alias("char_start"), (F.max("l_suppkey") % 15 + 1).alias("n"), F.max("l_returnflag").alias("kind"))
    texts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.repeat(F.lit("x"), F.lit(60)).alias("text"))
    return _longs(D.segments(li.withColumn("char_end", F.col("char_start") + F.col("n")), texts).drop("part"))


@query("""WITH m AS (SELECT lang, quality, toxic FROM labels JOIN documents USING (doc_id)),
r AS (SELECT lang, grouping(lang) = 1 AS total, count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 0 AND toxic = 0) AS fn FROM m GROUP BY GROUPING SETS ((lang), ())),
f AS (SELECT *, tp + fn AS gold, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS rc, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM r)
SELECT lang AS clause_type, total, tp, fp, fn, gold, round(p, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1, CASE WHEN gold = 0 THEN 'extra' WHEN f1 >= 0.95 THEN 'solved' WHEN f1 >= 0.85 THEN 'reliable' WHEN f1 >= 0.6 THEN 'mixed' ELSE 'weak' END AS band FROM f""")
def q_eval_report(spark, sf_dir):
    """Harmless documents taken for good ones, by language and in all."""
    m = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("clause_type")), "doc_id")
    said, true = F.col("quality") == 1, F.col("toxic") == 0
    m = m.select("clause_type", (said & true).cast("long").alias("tp"), (said & ~true).cast("long").alias("fp"), (~said & true).cast("long").alias("fn"))
    return evaluate.report(m).select("clause_type", "total", "tp", "fp", "fn", "gold", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "band")


@query("""SELECT event_id, event_id % 5 <> 4 AS readable, CASE WHEN event_id % 5 < 2 OR event_id % 5 = 3 THEN (props->>'$.k')::BIGINT ELSE -1 END AS k, event_id % 5 < 2 AS same FROM events""")
def q_tolerant_fields(spark, sf_dir):
    """Events' properties as written, reordered, without the field, with it renamed, and cut off."""
    e = table(spark, sf_dir, "events")
    k, way = F.get_json_object("props", "$.k"), F.col("event_id") % 5
    plain = F.concat(F.lit('{"k": '), k, F.lit(', "z": {"a": 1, "b": [1, 2]}}'))
    text = (
        F.when(way == 0, plain).when(way == 1, F.concat(F.lit('{"z":{"b":[1,2],"a":1},"k":'), k, F.lit("}"))).when(way == 2, F.lit('{"z": 1}'))
        .when(way == 3, F.concat(F.lit('{"data": {"kind_no": "'), k, F.lit('"}}'))).otherwise(F.concat(F.lit('{"k": '), k))
    )
    v = tolerant.parsed(text)
    return e.select("event_id", v.isNotNull().alias("readable"), tolerant.field(v, ["$.k", "$.data.kind_no"], "long", -1).alias("k"), F.coalesce(tolerant.key(text) == tolerant.key(plain), F.lit(False)).alias("same"))


@query(f"WITH {GAPS} SELECT key, out_id, in_id, row_number() OVER (PARTITION BY key, out_id ORDER BY CASE key WHEN 'breach_notice' THEN -in_value ELSE in_value END, in_id)::INT AS rank FROM gaps QUALIFY rank <= 5")
def q_worst_gaps(spark, sf_dir):
    k, c = _chain(spark, sf_dir)
    return portfolio.worst_gaps(c, k).select("key", "out_id", "in_id", "rank")


@query("SELECT event_id, user_id, event_type AS kind, CASE WHEN event_id % 2 = 0 THEN round(value * 2, 6) ELSE round(value, 6) END AS amount, CASE WHEN event_id % 2 = 0 THEN 'second' ELSE 'old' END AS origin FROM events WHERE event_type <> 'error' OR event_id % 4 = 0")
def q_versioned_table(spark, sf_dir):
    """Events committed, all errors removed, a column renamed and one added, every second event put again but half of the
    errors among them, compacted in between."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    t = Versions(spark, folder(spark, "versions"), ["event_id"])
    t.commit(e, writer="q", batch=1)
    t.commit(e, writer="q", batch=1)  # a replay
    t.commit(e.where("event_type = 'error'").select("event_id"), deleted=True)
    t.compact()
    t.migrate(rename={"event_type": "kind", "value": "amount"}, add={"origin": "'old'"})
    again = e.where("event_id % 2 = 0 and (event_type <> 'error' or event_id % 4 = 0)")
    t.commit(again.select("event_id", "user_id", F.col("event_type").alias("kind"), (F.col("value") * 2).alias("amount"), F.lit("second").alias("origin")))
    return t.read().select("event_id", "user_id", "kind", F.round("amount", 6).alias("amount"), "origin")
