"""Findings of the third round: tables that grow with the agreements are never a broadcast, nor a group map of a scan's task."""

import re

import pytest
from pyspark.sql import functions as F

from pactline.operators import rules
from pactline.plans import registry, surfaces  # noqa: F401  (registers its queries)
from pactline.shipping import spread

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["q_obligations", "q_deadlines", "q_next_deadline", "q_sentences", "q_records", "q_playbook_coverage"])
def test_no_broadcast_of_agreements(spark, name):
    joins = re.findall(r"(?:Broadcast|Sort)\w*Join.*", plan(registry.QUERIES[name](spark, SF)))
    assert any("SortMergeJoin" in j for j in joins)
    assert not [j for j in joins if j.startswith("Broadcast") and re.search(r"contract_id|_k#", j)]


def test_coverage_of_odd_rows(spark):
    """A contract without claims, one of no known type, one that is there twice, claims twice and superseded."""
    k = spark.createDataFrame([("a", "nda"), ("b", "nda"), ("c", "no such"), ("d", None), ("e", "nda"), ("e", "msa")], "contract_id string, contract_type string")
    types = sorted(r.clause_type for r in rules.playbook(spark).where("contract_type = 'nda'").collect())
    many = {r.clause_type for r in rules.playbook(spark).where("contract_type = 'msa'").collect()}
    cl = spark.createDataFrame([("a", types[0], None), ("a", types[0], None), ("a", types[1], "x"), ("e", types[0], None)], "contract_id string, clause_type string, superseded_by string")
    got = {r.contract_id: r.coverage for r in rules.coverage(cl, k).select("contract_id", F.round("coverage", 9).alias("coverage")).collect()}
    both = (1 + (types[0] in many)) / (len(types) + len(many))
    assert got == {"a": round(1 / len(types), 9), "b": 0.0, "c": 1.0, "d": 1.0, "e": round(both, 9)}


def test_texts_are_not_split_for_every_look_at_a_rank(spark):
    """The ranks of q_hybrid read kept ids and scores, not the documents' texts again."""
    reads = re.findall(r"ReadSchema: struct<[^>]*>", plan(registry.QUERIES["q_hybrid"](spark, SF)))
    assert reads and not [r for r in reads if "text:string" in r]


def test_rows_are_spread_over_all_tasks(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spread(spark.range(1000), "id").rdd.getNumPartitions() == n
