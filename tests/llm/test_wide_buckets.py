"""Wide buckets of lines: what the second step of link_buckets hands on."""

from collections import Counter

from pyspark.sql import functions as F

from pactline.llm import common


def test_across_gets_open_buckets_with_their_sizes(spark):
    """Three wide buckets, one closed by its star: the others come with all their nodes and how many these are, so that no
    further join has to count them, and links across components are kept."""
    rows = [("a", n, n) for n in range(1, 21)] + [("b", n, n) for n in range(11, 41)] + [("c", n, n) for n in range(41, 61)]
    members = spark.createDataFrame(rows, "key string, node long, rank long").withColumn("size", F.lit(1))
    true = {(a, a + 1) for a in range(1, 40) if a != 20} | {(41, n) for n in range(42, 61)}
    links = spark.createDataFrame(sorted(true), "a long, b long")
    got = []

    def across(rest):
        got.extend((r.key, r.node, r.n) for r in rest.collect())
        x, y = rest.alias("x"), rest.alias("y")
        return x.join(y, F.expr("x.key = y.key and x.node < y.node and x.comp <> y.comp")).selectExpr("x.node as a", "y.node as b").distinct().join(links, ["a", "b"], "left_semi")

    none = spark.createDataFrame([], "a long, b long")
    comps = common.link_buckets(members, lambda p: p.join(links, ["a", "b"], "left_semi"), narrow=none, across=across)
    assert sorted(got) == sorted((k, n, {"a": 20, "b": 30}[k]) for k, n, _ in rows if k != "c")
    assert Counter(r.comp for r in comps.collect()) == {1: 20, 21: 20, 41: 20}
