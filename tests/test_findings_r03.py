"""Findings of the third round: results on odd rows, and steps that no longer grow with the input in one place."""

from pyspark.sql import functions as F

from pactline.functions import spans as S
from pactline.functions import text as X
from pactline.operators import evaluate, obligations, portfolio
from pactline.plans import registry, surfaces  # noqa: F401  (registers its queries)


def test_gap_pairs_are_spread(spark):
    """One value a side: its pairs fall to many keys, and each is there once."""
    no = "cast(null as double) as"
    k = spark.range(80).selectExpr("cast(id as string) as contract_id", "concat('T', id) as title", "if(id < 40, 'seller', 'buyer') as our_role", "1.0D as annual_value")
    c = k.selectExpr("contract_id", "1 as seq", "'sla' as clause_type", "contract_id as doc_id", "0 as char_start", "4 as char_end", "'text' as quote", f"{no} amount", f"{no} days", f"{no} months", f"{no} percent", "if(our_role = 'seller', 99.9D, 99.0D) as uptime_percent", "cast(null as string) as superseded_by")
    out, inn = portfolio.dealt(*portfolio._turned(c, k), 4, 8)
    assert [side.select("key", "_b", "_part").distinct().count() for side in (inn, out)] == [8, 16]
    assert portfolio.gaps(c, k, 4, 8).count() == portfolio.gaps(c, k, 4, 8).select("out_id", "in_id").distinct().count() == 1600


def test_match_by_batches(spark):
    """Many documents in a batch, groups of one side only, equal keys of nothing, and spans without an end."""
    s = "doc_id long, clause_type string, seq int, char_start int, char_end int"
    pred = spark.createDataFrame([(d, "t", k, 30 * k, 30 * k + 25) for d in range(300) for k in (1, 0)] + [(None, "t", 0, 0, 10), (900, "t", 0, 5, None)], s)
    gold = spark.createDataFrame([(d, "t", k, 30 * k + d % 17, 30 * k + 25 + d % 17) for d in range(300) for k in (0, 1)] + [(None, "t", 0, 0, 10), (901, "t", 0, 0, 5)], s)
    got = evaluate.match(pred, gold)
    assert not [r for r in got._jdf.queryExecution().toString().splitlines() if "CoGroup" in r]
    near = sum(d % 17 <= 13 for d in range(300))
    assert {r.doc_id: (r.tp, r.fp, r.fn) for r in got.collect() if r.doc_id is None or r.doc_id >= 900} == {None: (1, 0, 0), 900: (0, 1, 0), 901: (0, 0, 1)}
    assert evaluate.score(got).head()["tp"] == 2 * near + 1


def test_ics_in_pieces(spark, tmp_path):
    """No value holds the whole file, and the pieces written in order are it."""
    e = spark.createDataFrame([("k", "2001-10-02", "notice", "second", True), ("k", "2001-10-01", "notice", "first", True), ("k", "2001-10-01", "uploaded", "no", False)], "contract_id string, date string, kind string, title string, actionable boolean").withColumn("date", F.to_date("date"))
    pieces = obligations.ics(e, registry.TODAY)
    assert sorted(r.part for r in pieces.collect()) == [0, 1, 1, 2] and max(r.ics.count("BEGIN:VEVENT") for r in pieces.collect()) == 1
    obligations.write_ics(pieces, str(tmp_path / "f"))
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "f").glob("part-*")))
    assert text.startswith("BEGIN:VCALENDAR\r\nVERSION:2.0\r\nBEGIN:VEVENT\r\n") and text.endswith("END:VEVENT\r\nEND:VCALENDAR\r\n") and text.index("first") < text.index("second")


def test_renewal_rules_are_not_broadcast(spark):
    k = spark.createDataFrame([("k", None)], "contract_id string, effective_date string").withColumn("effective_date", F.lit("2001-01-31").cast("date"))
    r = spark.createDataFrame([("k", "renewal", "P6M", 1)], "contract_id string, kind string, recurrence string, seq int")
    t = obligations.terms(k, r, registry.TODAY)
    assert "BroadcastHashJoin" not in t._jdf.queryExecution().executedPlan().toString() and str(t.head().term.term_end) == "2002-01-31"


def test_first_of_claims_with_one_number(spark):
    row = lambda place, days: ("k", f"k:{place}", 1, "notice_period", "d", 0, 4, "text", None, days, None, None, None, None, place)
    c = spark.createDataFrame([row(p, float(p)) for p in (9, 3, 7)], "contract_id string, claim_id string, seq int, clause_type string, doc_id string, char_start int, char_end int, quote string, amount double, days double, months double, percent double, uptime_percent double, superseded_by string, place int")
    d = spark.createDataFrame([("notice_days", "notice_period", "days")], "key string, clause_type string, field string")
    assert portfolio._first(c, d).head()["value"] == 3.0


def test_fuzzy_takes_the_longest_of_equal_places():
    """A letter changed in a text that repeats itself: the place is as long as the quote."""
    text = "\u00d6 " * 65
    assert S.fuzzy(text, text[:40] + "§" + text[41:81]) == (0, 81)


def test_fuzzy_tries_every_place():
    """The first place is the most alike, though many later ones have more seeds."""
    base = "The tenant shall give notice in writing of any breach of the lease within sixty days."
    later = base[:50] + base[43:50] + base[50:]
    assert S.fuzzy(base + f" {later}" * 40, base[:40] + "§" + base[41:]) == (0, len(base))


def test_a_balance_of_nothing_is_a_sum(spark, tmp_path):
    spark.createDataFrame([(1, 0.0), (2, -0.3), (3, 5.0), (4, None)], "c_custkey long, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r.c_custkey: r.money for r in registry.QUERIES["q_money"](spark, str(tmp_path)).collect()}
    assert got == {1: "$0", 2: "$-0", 3: "\u2014", 4: None}
    assert spark.range(1).select(X.money(F.lit(0.0))).head()[0] == "\u2014"


def test_figures_count_gaps_without_listing_them(spark):
    """No step of the figures has a row a pair: those of the smallest tables are 10 times the promises."""
    f = registry.QUERIES["q_figures"](spark, "/root/testdata/sf0.001")
    assert "_in" not in {c for x in f._jdf.queryExecution().analyzed().toString().split() for c in x.strip("[],()").split("#")[:1]}
    k, c = registry._chain(spark, "/root/testdata/sf0.001")
    assert portfolio.gap_count(c, k).head().gaps == portfolio.gaps(c, k).count() == f.head().gaps
