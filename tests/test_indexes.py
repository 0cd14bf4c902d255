"""Stored indexes against scans."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pactline.operators import retrieval
from pactline.operators.postings import PostingsIndex, build_records
from pactline.operators.vectors import VectorIndex

EMBEDDINGS = "/root/testdata/sf0.1/embeddings.parquet"


def corpus(spark, n=1500):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words[: 20 + i % 280]) for _ in range(rng.randint(0, 40)))) for i in range(n)]
    rows += [(9000, None), (9001, ""), (9002, "rare word here"), (9003, "the rare of it"), (9004, "w1 " * 500)]
    return spark.createDataFrame(rows, "id long, text string")


def test_batched_search_is_bm25(spark, tmp_path):
    docs = corpus(spark)
    index = PostingsIndex.build(docs, str(tmp_path / "index"))
    asked = {1: "w1 w250 w250", 2: "rare", 3: "unheard", 4: None, 5: "the of it", 6: "w299 rare w3 w4"}
    got = index.search(spark.createDataFrame(list(asked.items()), "qid int, text string"), 7).collect()
    for qid, text in asked.items():
        want = retrieval.bm25(docs, retrieval.query_terms(text or "")).orderBy(F.desc("score"), "id").limit(7).collect()
        mine = sorted((r for r in got if r.qid == qid), key=lambda r: r["rank"])
        assert [r.id for r in mine] == [r.id for r in want] and [r.score for r in mine] == pytest.approx([r.score for r in want])


def test_search_opens_few_blocks(spark, tmp_path):
    docs = corpus(spark, 6000)
    index = PostingsIndex.build(docs, str(tmp_path / "index"))
    questions = spark.createDataFrame([(1, "rare w1"), (2, "w2 rare")], "qid int, text string")
    asked = index.asked(questions)
    blocks = index.pruned("blocks", asked)
    assert "In(term" in blocks._jdf.queryExecution().executedPlan().toString()  # the scan knows the asked terms
    assert blocks.select("term").distinct().count() == 3
    weights = index.weights(asked)
    met = weights.join(blocks, "term").select("qid", "segment").distinct().count()
    assert index.candidates(weights, blocks, 2).count() < met / 2  # the other segments can't reach the second best


def test_index_of_records_and_of_nothing(spark, tmp_path):
    rec = spark.createDataFrame([("a", "Acme", "clause", "renewal notice", "sixty days", "q"), ("b", "Initech", "fact", "value", "fees", None)], "id string, contract string, kind string, title string, body string, quote string")
    index = build_records(rec, str(tmp_path / "records"))
    assert [r.id for r in index.search(spark.createDataFrame([(1, "acme renewal")], "qid int, text string")).collect()] == ["a"]
    empty = PostingsIndex.build(rec.limit(0).select("id", F.col("body").alias("text")), str(tmp_path / "empty"))
    assert empty.search(spark.createDataFrame([(1, "acme")], "qid int, text string")).count() == 0


def cosines(v):
    u = v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
    return u @ u.T


@pytest.mark.skipif(not os.path.exists(EMBEDDINGS), reason="no test tables")
def test_vector_recall(spark, tmp_path):
    v = spark.read.parquet(EMBEDDINGS).select(F.col("vec_id").alias("id"), "embedding")
    old, new = v.where("id % 3 <> 0"), v.where("id % 3 = 0")
    index = VectorIndex.build(old, str(tmp_path / "v"))
    index.insert(new)
    q = v.where("id % 50 = 0").withColumnRenamed("id", "qid")
    rows = v.orderBy("id").collect()
    ids, scores = np.array([r.id for r in rows]), cosines(np.array([r.embedding for r in rows], float))
    want = {int(ids[i]): set(ids[np.lexsort((ids, -scores[i]))[:20]].tolist()) for i in range(len(ids)) if ids[i] % 50 == 0}
    for exact, least in ((False, 0.9), (True, 1.0)):
        got = {}
        for r in index.search(q, 20, exact=exact).collect():
            got.setdefault(r.qid, set()).add(r.id)
        assert np.mean([len(got[i] & want[i]) / 20 for i in want]) >= least


def test_vectors_odd_rows(spark, tmp_path):
    rows = [(i, [float(i % 5), 1.0, -float(i % 3)]) for i in range(300)] + [(900, [0.0, 0.0, 0.0]), (901, None), (902, [float("nan"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    index = VectorIndex.build(v, str(tmp_path / "v"), cells=7)
    assert index.read().count() == 301
    got = index.search(spark.createDataFrame([(1, [1.0, 1.0, -1.0]), (2, [0.0, 0.0, 0.0])], "qid long, embedding array<double>"), 25, probes=1, exact=True).collect()
    u = np.array([r[1] for r in rows[:301]])
    u = u / np.where((u * u).sum(1) == 0, 1, np.sqrt((u * u).sum(1)))[:, None]
    s = u @ np.array([1.0, 1.0, -1.0]) / np.sqrt(3)
    assert sorted((r.score for r in got if r.qid == 1), reverse=True) == pytest.approx(np.sort(s)[::-1][:25].tolist()) and sum(r.qid == 2 for r in got) == 25
    with pytest.raises(Exception, match="dimension 3"):
        index.insert(spark.createDataFrame([(5, [1.0])], "id long, embedding array<double>"))
