"""Versioned tables, tolerant JSON, segments, evaluation report, range gaps."""

import random

import pytest
from pyspark.sql import functions as F

from pactline.functions import tolerant
from pactline.operators import documents as D
from pactline.operators import evaluate
from pactline.sources.versions import Versions, resync


def table(spark, tmp_path):
    return Versions(spark, str(tmp_path / "t"), ["id"])


def rows(spark, *r, schema="id string, n int"):
    return spark.createDataFrame(list(r), schema)


def held(t, n=None):
    return sorted(tuple(r) for r in t.read(n).select("id", "n").collect())


def test_upsert_delete_compact_and_older_versions(spark, tmp_path):
    t = table(spark, tmp_path)
    with pytest.raises(ValueError):
        t.read()
    v1 = t.commit(rows(spark, ("a", 1), ("b", 1)))
    v2 = t.commit(rows(spark, ("a", 2), ("c", 2)))
    v3 = t.commit(rows(spark, ("b", None)).select("id"), deleted=True)
    assert held(t) == [("a", 2), ("c", 2)] and held(t, v1) == [("a", 1), ("b", 1)] and held(t, v2) == [("a", 2), ("b", 1), ("c", 2)]
    t.compact()
    assert held(t) == [("a", 2), ("c", 2)] and t.history().count() == 2 and held(t, v3) == [("a", 2), ("c", 2)]
    t.commit(rows(spark, ("b", 9)))  # back after its tombstone
    assert held(t) == [("a", 2), ("b", 9), ("c", 2)]
    assert t.vacuum() == 3 and t.vacuum() == 0 and held(t) == [("a", 2), ("b", 9), ("c", 2)]


def test_replays_and_writers_that_meet(spark, tmp_path):
    t, other = table(spark, tmp_path), table(spark, tmp_path)
    t.commit(rows(spark, ("a", 1)), writer="w", batch=1)
    t.commit(rows(spark, ("a", 2)), writer="w", batch=2)
    n = t.commit(rows(spark, ("a", 1)), writer="w", batch=1)  # delivered again
    assert held(t) == [("a", 2)] and n == t.numbers()[-1] and t.history().count() == 2
    taken = t.manifest() | {"version": t.numbers()[-1]}
    assert not t._put(taken)  # its number is in use
    put = other._put
    other._put = lambda m: t.commit(rows(spark, ("b", 1))) and False if not hasattr(other, "late") and not setattr(other, "late", 1) else put(m)
    other.commit(rows(spark, ("c", 1)))
    assert held(t) == [("a", 2), ("b", 1), ("c", 1)]


def test_a_commit_beside_a_compaction_stays(spark, tmp_path):
    t, other = table(spark, tmp_path), table(spark, tmp_path)
    t.commit(rows(spark, ("a", 1), ("b", 1)))
    t.commit(rows(spark, ("a", 2)))
    write = t._write
    t._write = lambda df: (write(df), other.commit(rows(spark, ("b", 5))))[0]
    t.compact()
    assert held(t) == [("a", 2), ("b", 5)] and len(t.manifest()["folders"]) == 2


def test_migrations_are_logged(spark, tmp_path):
    t = table(spark, tmp_path)
    t.commit(rows(spark, ("a", 1)))
    t.migrate(rename={"n": "amount"}, add={"unit": "'days'"})
    t.commit(rows(spark, ("b", 2, "hours", 0), schema="id string, amount int, unit string, spare int"))
    t.migrate(drop=["spare"])
    assert sorted(tuple(r) for r in t.read().select("id", "amount", "unit").collect()) == [("a", 1, "days"), ("b", 2, "hours")]
    assert set(t.read().columns) == {"id", "amount", "unit"} and t.read(1).columns == ["id", "n"]
    t.compact()
    assert sorted(tuple(r) for r in t.read().select("id", "amount", "unit").collect()) == [("a", 1, "days"), ("b", 2, "hours")]


def test_resync(spark, tmp_path):
    t = table(spark, tmp_path)
    make = lambda *r: rows(spark, *r, schema="id string, text string")
    assert resync(t, make(("a", "x"), ("b", "y"))) == (2, 0)
    assert resync(t, make(("a", "x"), ("b", "y"))) == (0, 0)
    assert resync(t, make(("a", "x2"), ("c", None))) == (2, 1)
    assert sorted(tuple(r) for r in t.read().collect()) == [("a", "x2"), ("c", None)]


def test_tolerant_json(spark):
    same = ['{"a": {"y": 1, "x": [1, {"p": 1, "o": 2}]}, "b": null}', ' {"b":null,"a":{"x":[1,{"o":2,"p":1}],"y":1}} ']
    df = spark.createDataFrame([(x,) for x in [*same, '{"a": {"y": 1, "x": [{"p": 1, "o": 2}, 1]}, "b": null}', "{broken", None, "[]"]], "t string")
    keys = [r[0] for r in df.select(tolerant.key(F.col("t"))).collect()]
    assert keys[0] == keys[1] != keys[2] and keys[3:5] == [None, None] and keys[5] is not None
    got = df.select(tolerant.field(tolerant.parsed(F.col("t")), ["$.none", "$.a.y"], "int", -1)).collect()
    assert [r[0] for r in got] == [1, 1, 1, -1, -1, -1]


def greedy(length, marks):
    at, out = 0, []
    for _, a, b, kind in sorted((m for m in marks if m[1] >= 0 and m[2] > m[1]), key=lambda m: (m[1], m[0])):
        if a >= at and a < length:
            out += [(at, a, None)] * (a > at) + [(a, min(b, length), kind)]
            at = min(b, length)
    return out + [(at, length, None)] * (at < length)


def test_segments_cover_the_text(spark):
    rng = random.Random(2)
    texts = {i: "x" * rng.randint(0, 50) for i in range(60)}
    marks = [(i, k, a := rng.randint(-2, 55), a + rng.randint(-1, 20), rng.choice(["found", "reading"])) for i in range(55) for k in range(rng.randint(0, 9))] + [(77, 0, 1, 2, "found")]
    m = spark.createDataFrame(marks, "doc_id long, seq int, char_start int, char_end int, kind string")
    got = {}
    for r in D.segments(m, spark.createDataFrame(list(texts.items()), "doc_id long, text string")).orderBy("doc_id", "part").collect():
        got.setdefault(r.doc_id, []).append((r.char_start, r.char_end, r.kind))
    assert got == {i: g for i, t in texts.items() if (g := greedy(len(t), [x[1:] for x in marks if x[0] == i]))}


def test_report_is_written_and_read(spark, tmp_path):
    span = lambda *r: spark.createDataFrame(list(r), "doc_id string, clause_type string, seq int, char_start int, char_end int")
    gold = span(("d", "sla", 0, 0, 10), ("d", "sla", 1, 20, 30), ("d", "term", 0, 40, 50))
    found = evaluate.evaluate(span(("d", "sla", 0, 1, 10), ("d", "term", 0, 40, 50), ("d", "fee", 0, 60, 70)), gold)
    path = str(tmp_path / "report")
    assert evaluate.read_report(spark, path).count() == 0
    evaluate.write_report(found, path)
    got = {r.clause_type: r for r in evaluate.read_report(spark, path).collect()}
    assert {k: (r.tp, r.fp, r.fn, r.band) for k, r in got.items()} == {"sla": (1, 0, 1, "mixed"), "term": (1, 0, 0, "solved"), "fee": (0, 1, 0, "extra"), None: (2, 1, 1, "mixed")}
    assert got[None].total and got[None].f1 == pytest.approx(2 / 3)
