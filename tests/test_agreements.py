"""Golden dates, folds and rules on small agreements."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pactline.functions import temporal as T
from pactline.functions import text as X
from pactline.operators import evaluate, family, grounding, obligations, portfolio, retrieval, rules
from pactline.plans import dims

TODAY = dt.date(2026, 8, 27)
CLAIM = "contract_id string, claim_id string, seq int, clause_type string, party_favored string, doc_id string, char_start int, char_end int, quote string, amount double, currency string, percent double, days int, months int, uptime_percent double, unilateral boolean, survives_termination boolean, superseded_by string, supersedes string"
NAMES = [c.split()[0] for c in CLAIM.split(", ")]
CONTRACT = "contract_id string, title string, counterparty string, our_role string, contract_type string, effective_date date, annual_value double, currency string"


def claims(spark, *rows):
    base = {"contract_id": "k", "party_favored": "na", "doc_id": "d", "char_start": 0, "char_end": 4, "quote": "text"}
    return spark.createDataFrame([tuple({**base, "seq": i, "claim_id": f"c{i}", **r}.get(n) for n in NAMES) for i, r in enumerate(rows)], CLAIM)


def contract(spark, *rows):
    rows = rows or [{}]
    base = {"contract_id": "k", "title": "t", "counterparty": "Northwind", "our_role": "buyer", "contract_type": "msa", "effective_date": dt.date(2026, 3, 1), "annual_value": 84000.0, "currency": "USD"}
    names = [c.split()[0] for c in CONTRACT.split(", ")]
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], CONTRACT)


def rule_rows(spark, *rows):
    names = "contract_id rule_id seq kind anchor offset_days recurrence condition consequence owed_by doc_id quote".split()
    base = {"contract_id": "k", "kind": "notice", "anchor": "term_end", "offset_days": 0, "owed_by": "us", "doc_id": "d", "quote": "q"}
    return spark.createDataFrame([tuple({**base, "rule_id": f"r{i}", "seq": i, **r}.get(n) for n in names) for i, r in enumerate(rows)], "contract_id string, rule_id string, seq int, kind string, anchor string, offset_days int, recurrence string, condition string, consequence string, owed_by string, doc_id string, quote string")


def one(spark, col):
    return spark.range(1).select(col.alias("x")).head().x


def test_notice_deadline(spark):
    got, unresolved = obligations.materialise(rule_rows(spark, {"offset_days": -60}, {"anchor": "event", "kind": "cure"}), contract(spark), TODAY)
    row = got.collect()
    assert [(r.due_date, r.days_remaining) for r in row] == [(dt.date(2026, 12, 31), 126)]
    assert row[0].derivation[-1] == "=> deadline 2026-12-31 (126 days from 2026-08-27)"
    assert [r.rule_id for r in unresolved.collect()] == ["r1"]


def test_no_effective_date(spark):
    got, unresolved = obligations.materialise(rule_rows(spark, {}), contract(spark, {"effective_date": None}), TODAY)
    assert got.count() == 0 and unresolved.head().rule_id is None


def test_recurrences(spark):
    r = rule_rows(spark, {"kind": "report", "anchor": "quarter_end", "offset_days": 15}, {"kind": "notice", "anchor": "month_end"}, {"kind": "payment", "anchor": "effective_date", "recurrence": "P1M"}, {"kind": "payment", "anchor": "effective_date", "offset_days": -900})
    got = {}
    for x in obligations.materialise(r, contract(spark), TODAY)[0].orderBy("seq", "occurrence").collect():
        got.setdefault(x.rule_id, []).append(x.due_date)
    assert got["r0"] == [dt.date(2026, 10, 15), dt.date(2027, 1, 15), dt.date(2027, 4, 15), dt.date(2027, 7, 15)]
    assert got["r1"] == [dt.date(2026, 8, 31)]
    assert got["r2"][0] == dt.date(2026, 6, 1) and len(got["r2"]) == 4  # from 90 days back
    assert len(got["r3"]) == 1  # a single date has no lower bound


@pytest.mark.parametrize(
    ("effective", "initial", "renewal", "today", "end", "n"),
    [
        ("2024-02-29", 12, 12, "2027-12-31", "2028-02-28", 3), ("2026-01-31", 1, 1, "2026-03-01", "2026-03-28", 1), ("2020-08-27", 12, 12, "2026-08-27", "2027-08-27", 6),
        ("2026-03-01", 12, None, "2030-01-01", "2027-03-01", 0),
    ],
)
def test_term_roll(spark, effective, initial, renewal, today, end, n):
    d = lambda x: F.lit(x).cast("date")
    got = one(spark, T.roll_term(d(effective), initial, F.lit(renewal).cast("int"), d(today)))
    assert (str(got.term_end), got.renewals, len(got.ends)) == (end, n, n + 1)


def test_dates(spark):
    p = lambda t: one(spark, T.parse_date(F.lit(t)))
    assert p("on 1 March 2026 and 2020-01-01") == dt.date(2026, 3, 1)
    assert p("July 4, 2025") == dt.date(2025, 7, 4) and p("31 February 2024 or 2024-03-05") == dt.date(2024, 3, 5) and p("3/4/2024") is None
    assert one(spark, T.recurrence_months(F.lit(" p1y6m "))) == 18 and one(spark, T.recurrence_months(F.lit("P0M"))) is None and one(spark, T.recurrence_months(F.lit("P"))) is None
    m = lambda a, b: one(spark, T.months_between_up(F.lit(a).cast("date"), F.lit(b).cast("date")))
    assert (m("2026-01-15", "2026-02-15"), m("2026-01-15", "2026-02-16"), m("2026-02-01", "2026-01-01")) == (1, 2, 0)


def test_exit_cost(spark):
    c = claims(spark, {"clause_type": "early_termination_fee", "percent": 50.0, "quote": "half"}, {"clause_type": "data_retention_deletion", "days": 90})
    row = obligations.exit_cost(contract(spark), c, obligations.materialise(rule_rows(spark, {"offset_days": -60}), contract(spark), TODAY)[0], F.lit("2026-10-01").cast("date"), TODAY).head()
    assert row.total == 52500.0 and [i.amount for i in row.line_items] == [35000.0, 17500.0] and row.months_left == 5
    assert "Delete or return data within 90 days" in row.notes


def test_supersession(spark):
    docs = spark.createDataFrame([("k", "a2", 2, "amendment_2.txt", "amendment", "Amendment No. 2 dated 1 June 2026"), ("k", "of", 1, "of.txt", "order_form", ""), ("k", "m", 0, "msa.txt", "msa", ""), ("k", "a1", 3, "x.txt", "amendment", "Amendment No. 1")], "contract_id string, doc_id string, seq int, filename string, contract_type string, text string")
    order = family.order_documents(docs)
    assert [r.doc_id for r in order.orderBy("doc_rank").collect()] == ["m", "of", "a1", "a2"]
    c = claims(spark, {"doc_id": "m", "clause_type": "liability_cap", "amount": 50000.0}, {"doc_id": "m", "clause_type": "payment_terms", "days": 45}, {"doc_id": "of", "clause_type": "payment_terms", "amount": 84000.0}, {"doc_id": "a2", "clause_type": "liability_cap", "amount": 250000.0}, {"doc_id": "a2", "clause_type": "payment_terms", "days": 30}, {"doc_id": "a1", "clause_type": "liability_cap", "amount": 99.0}, {"doc_id": "a2", "clause_type": "confidentiality"}, {"doc_id": "m", "clause_type": "confidentiality"})
    got = family.supersede(c, order)
    assert {r.claim_id: r.superseded_by for r in got.collect() if r.superseded_by} == {"c0": "c5", "c5": "c3", "c1": "c4"}
    text = {r.claim_id: r.lineage for r in family.lineage(got, docs).collect()}
    assert text["c3"] == "set by amendment_2.txt; supersedes x.txt; supersedes msa.txt" and text["c2"] == "set by of.txt"


def test_facts_and_value(spark):
    docs = spark.createDataFrame([("k", "m", 0, "m", "msa", "no date"), ("k", "o", 1, "o", "order_form", "from 1 March 2026"), ("k", "a", 2, "a", "amendment", "1 June 2026")], "contract_id string, doc_id string, seq int, filename string, contract_type string, text string")
    f = family.facts(docs).head()
    assert (f.effective_date, f.contract_type, f.doc_ids) == (dt.date(2026, 3, 1), "msa", ["m", "o", "a"])
    v = lambda *r: [x.annual_value for x in family.annual_value(claims(spark, *r)).collect()]
    assert v({"clause_type": "payment_terms", "amount": 5.0, "quote": "annual fee"}, {"clause_type": "payment_terms", "amount": 9.0, "quote": "Per Year"}) == [9.0]
    assert v({"clause_type": "minimum_commitment", "amount": 3.0}, {"clause_type": "minimum_commitment", "amount": 8.0}, {"clause_type": "x", "amount": 9.0, "quote": "annual"}) == [3.0]


def test_risk(spark):
    k = contract(spark)
    c = claims(spark, {"clause_type": "liability_cap", "amount": 41999.0}, {"clause_type": "uncapped_liability_carveout", "party_favored": "counterparty"}, {"clause_type": "indemnification", "party_favored": "counterparty", "survives_termination": True}, {"clause_type": "notice_period", "days": 91}, {"clause_type": "payment_terms", "days": 0}, {"clause_type": "price_increase"})
    found = rules.contributions(c, k)
    got = {r.axis: r.score for r in rules.axes(found, k).collect()}
    assert got == {"liability": 100, "lockin": 45, "financial": 25, "compliance": 0, "operational": 0}
    top = rules.overall(rules.axes(found, k)).head()
    assert (top.overall, top.band) == (100, "critical")
    assert [one(spark, X.band(F.lit(v))) for v in (80, 50, 25, 5)] == ["critical", "high", "medium", "low"]
    assert set(dims.RUBRIC) >= {r.rule for r in found.collect()}


def test_patterns_asymmetry_silence(spark):
    c = claims(spark, {"clause_type": "unilateral_amendment", "party_favored": "counterparty", "quote": "in its sole discretion"}, {"clause_type": "auto_renewal", "days": 180}, {"clause_type": "notice_period", "days": 180, "quote": "Sole  Discretion"}, {"clause_type": "liability_cap", "amount": 35000.0}, {"clause_type": "venue"}, {"clause_type": "early_termination_fee", "quote": "is Immediately Due"})
    keys = sorted(r.key for r in rules.patterns(c).collect())
    assert keys == ["acceleration", "blank_cheque", "discretion_creep", "long_notice_180", "long_notice_180", "uneconomic_remedy"]
    a = rules.asymmetry(claims(spark, *({"clause_type": t, "party_favored": "counterparty"} for t in ("audit_rights", "assignment", "non_compete")), {"clause_type": "price_increase", "party_favored": "mutual"})).head()
    assert (a.our_rights, a.their_rights, a["index"], a.severity, len(a.asks)) == (1, 4, 0.8, "medium", 3)
    k = contract(spark, {}, {"contract_id": "s", "our_role": "seller"}, {"contract_id": "m", "our_role": "mutual", "contract_type": "amendment"})
    gone = rules.silence(c, k).collect()
    assert "sla" in {r.clause_type for r in gone if r.contract_id == "k"} and "sla" not in {r.clause_type for r in gone if r.contract_id == "s"}
    assert {r.contract_id: round(r.coverage, 6) for r in rules.coverage(c, k).collect()} == {"k": round(1 / 13, 6), "s": 0.0, "m": 1.0}


def test_gaps_and_compare(spark):
    k = contract(spark, {}, {"contract_id": "s", "our_role": "seller", "title": "Acme", "annual_value": 640000.0}, {"contract_id": "q", "title": "Quiet"})
    c = claims(spark, {"clause_type": "sla", "uptime_percent": 99.9}, {"contract_id": "s", "clause_type": "sla", "uptime_percent": 99.99}, {"clause_type": "breach_notification", "days": 3}, {"contract_id": "s", "clause_type": "breach_notification", "days": 1}, {"contract_id": "s", "clause_type": "breach_notification", "days": 9})
    g = portfolio.gaps(c, k)
    got = {r.key: (r.out_text, r.in_text) for r in g.collect()}
    assert got == {"uptime": ("99.99%", "99.9%"), "breach_notice": ("24 hours", "72 hours")}
    e = portfolio.exposure(g).head()
    assert (e.gaps, e.customers, e.revenue, e.dimensions) == (2, 1, 640000.0, ["breach_notice", "uptime"])
    r = rule_rows(spark, {"offset_days": -60}, {"contract_id": "q", "offset_days": -180})
    rows = {x.contract_id: (x.value, x.text, x.rank, x.stated_by) for x in portfolio.compare(claims(spark, {"clause_type": "notice_period", "days": 10}), r, k, "notice_days").collect()}
    assert rows == {"k": (60.0, "60 days", 1, "rule"), "q": (180.0, "180 days", 2, "rule"), "s": (None, None, None, None)}


def test_grounding(spark):
    docs = spark.createDataFrame([("d", "The  fee is\n45 days net. We may audit you once a year at our own cost 😀 end")], "doc_id string, text string")
    q = spark.createDataFrame([("d", "fee is"), ("d", "The fee is 45 days"), ("d", "We may audit you twice a year at our own cost"), ("d", "nothing of the kind is written here"), ("x", "fee"), ("d", "")], "doc_id string, quote string")
    got = {(r.doc_id, r.quote): (r.char_start, r.char_end, r.how) for r in grounding.locate(q, docs).collect()}
    assert got["d", "fee is"] == (5, 11, "exact") and got["d", "The fee is 45 days"][2] == "whitespace" and got["d", "We may audit you twice a year at our own cost"][2] == "fuzzy"
    assert {got["d", "nothing of the kind is written here"][2], got["x", "fee"][2], got["d", ""][2]} == {"dropped"}
    s = spark.createDataFrame([("d", 5, 11, "fee is"), ("d", 5, 11, "fee at"), ("d", -1, 3, "x"), ("d", 4, 4, ""), ("y", 0, 1, "x"), ("d", 71, 72, "😀")], "doc_id string, char_start int, char_end int, quote string")
    bad = [r.reason for r in grounding.verify(s, docs).collect()]
    assert sum(b is None for b in bad) >= 1 and sum(b is not None for b in bad) >= 4
    o = spark.createDataFrame([("d", "t", 0, 0, 10), ("d", "t", 1, 5, 30), ("d", "t", 2, 30, 40), ("d", "u", 3, 5, 6)], "doc_id string, clause_type string, seq int, char_start int, char_end int")
    assert sorted(r.seq for r in grounding.drop_overlaps(o).collect()) == [1, 2, 3]
    p = grounding.prune(spark.createDataFrame([(0.0, 0, False, "")], "percent double, days int, unilateral boolean, note string")).head()
    assert list(p) == [None, None, None, None]


def test_party_kind_anchor(spark):
    f = lambda v, role: one(spark, X.party(F.lit(v), F.lit("Contoso Systems Ltd."), F.lit(role)))
    assert [f("Provider", "buyer"), f("Provider", "seller"), f("Customer", "mutual"), f("Contoso", "buyer"), f(None, "buyer"), f("Both parties", "buyer"), f("Globex", "seller")] == ["counterparty", "us", "mutual", "us", "na", "mutual", "counterparty"]
    assert [one(spark, X.kind(F.lit(v))) for v in ("Auto-Renewal", "cure", "what")] == ["renewal", "cure", None]
    assert [one(spark, X.anchor(F.lit(v))) for v in ("End of Term", "", "moonrise")] == ["term_end", None, "event"]
    assert [one(spark, X.dimension(F.lit(v))) for v in ("Uptime", "cap", "the renewal window", "zzz")] == ["uptime", "liability_cap", "notice_days", None]
    assert one(spark, X.counterparty(F.lit("in/2024_acme-cloud services.v2.pdf"))) == "Acme Cloud Services.v2"


def test_search(spark):
    docs = spark.createDataFrame([("a", "renewal notice renewal"), ("b", "payment of fees"), ("c", "")], "id string, text string")
    got = {r.id: r.score for r in retrieval.bm25(docs, retrieval.query_terms("When is the renewal notice?")).collect()}
    assert set(got) == {"a"} and got["a"] > 0
    r = lambda *ids: spark.createDataFrame(list(enumerate(ids)), "rank int, id string")
    fused = {x.id: x.score for x in retrieval.fuse(r("a", "b"), r("b", "a")).collect()}
    assert fused["a"] == pytest.approx(fused["b"]) == pytest.approx(1 / 61 + 1 / 62)
    hits = spark.createDataFrame([(f"h{i}", "k1" if i < 6 else "k2", 10.0 - i) for i in range(9)], "id string, contract_id string, score double")
    assert [x.id for x in retrieval.diversify(hits, 6).collect()] == ["h0", "h1", "h2", "h3", "h6", "h7"]
    assert one(spark, retrieval.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0.0
    rec = spark.createDataFrame([("o", "obligation", "term_end", None, "buyer", "Northwind Ltd"), ("f", "fact", None, None, "buyer", "x")], "id string, kind string, anchor string, clause_type string, side string, contract string")
    assert {x.id: x.b for x in rec.select("id", retrieval.boost("when does northwind renew").alias("b")).collect()} == {"o": 11.0, "f": 0.0}


def test_hybrid(spark):
    c = claims(spark, {"clause_type": "notice_period", "days": 60, "quote": "sixty days notice"}, {"clause_type": "sla", "uptime_percent": 99.9, "quote": "uptime"})
    k = contract(spark)
    ob = obligations.materialise(rule_rows(spark, {"offset_days": -60}), k, TODAY)[0]
    none = spark.createDataFrame([], "finding_id string, kind string, severity string, title string, evidence array<struct<doc_id:string,char_start:int,char_end:int,quote:string>>, contract_ids array<string>")
    rec = retrieval.records(k, c, ob, none, portfolio.gaps(c, k))
    assert {r.kind for r in rec.collect()} == {"fact", "clause", "obligation"}
    pas = spark.createDataFrame([("p1:d", "k", "Notice must be given sixty days before", "1. NOTICE", "Northwind")], "id string, contract_id string, text string, section string, contract string")
    vec = spark.createDataFrame([("c0", "k", [1.0, 0.0]), ("gone", "k", [1.0, 0.0])], "id string, contract_id string, embedding array<double>")
    top = retrieval.hybrid(rec, pas, vec, "When is the renewal notice due?", [1.0, 0.1], 8).collect()
    assert top[0].kind in ("obligation", "clause") and "gone" not in {t.id for t in top} and len(top) >= 3
    assert [t.kind for t in retrieval.hybrid(rec, pas, None, "notice", None, 8, include=["passage"]).collect()] == ["passage"]


def test_evaluate(spark):
    s = "doc_id string, clause_type string, seq int, char_start int, char_end int"
    pred = spark.createDataFrame([("d", "t", 0, 0, 10), ("d", "t", 1, 2, 12), ("d", "u", 0, 0, 5)], s)
    gold = spark.createDataFrame([("d", "t", 0, 1, 11), ("d", "v", 0, 0, 5)], s)
    got = evaluate.score(evaluate.match(pred, gold), None).head()
    assert (got.tp, got.fp, got.fn) == (1, 2, 1) and got.f1 == pytest.approx(0.4)


def test_exposed_equals_the_listed_gaps(spark):
    """Figures without the list of pairs against those of the list, with ties, negative and missing values."""
    import random

    from pactline.operators import portfolio

    rng = random.Random(4)
    roles = ["seller", "buyer", "mutual"]
    k = spark.createDataFrame([(i, f"T{i % 40}", rng.choice(roles), float(rng.randint(1, 9)), "USD") for i in range(90)], "contract_id int, title string, our_role string, annual_value double, currency string")
    rows = []
    for i in range(90):
        for kind, field in (("sla", 4), ("breach_notification", 1), ("liability_cap", 0)):
            m = [None] * 5
            m[field] = rng.choice([None, float(rng.randint(-3, 6))])
            rows.append((i, f"{i}{kind}", 1, kind, "us", "d", 0, 4, "text", *m, None))
    c = spark.createDataFrame(rows, "contract_id int, claim_id string, seq int, clause_type string, party_favored string, doc_id string, char_start int, char_end int, quote string, amount double, days double, months double, percent double, uptime_percent double, superseded_by string")
    want = portfolio.exposure(portfolio.gaps(c, k)).drop("revenue").head().asDict()
    got = portfolio.exposed(c, k, buckets=4).drop("revenue").head().asDict()
    assert want == got and want["gaps"] > 100
    assert portfolio.exposed(c.limit(0), k).head().gaps == 0


def test_ranked_without_a_bound(spark):
    from pyspark.sql import functions as F

    from pactline.operators import retrieval

    hits = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id") / 7).alias("score"))
    got = {r.id: r.rank for r in retrieval.ranked(hits, buckets=8).collect()}
    want = sorted(hits.collect(), key=lambda r: (-r.score, r.id))
    assert got == {r.id: i for i, r in enumerate(want)} and retrieval.ranked(hits.limit(0)).count() == 0


def test_unknown_severity_comes_last(spark):
    from pyspark.sql import functions as F

    from pactline.functions import text as X

    df = spark.createDataFrame([(s,) for s in ("low", "who knows", "critical", None)], "s string").orderBy(X.severity_rank(F.col("s")), "s")
    assert [r.s for r in df.collect()][:2] == ["critical", "low"]


def test_term_rolls_as_often_as_it_takes(spark):
    import datetime

    from pyspark.sql import functions as F

    from pactline.functions import temporal as T

    term = T.roll_term(F.lit(datetime.date(1900, 1, 31)), 1, 1, datetime.date(2001, 9, 1))
    assert spark.range(1).select(term.alias("t")).head().t.renewals > 1200


def test_lineage_of_long_chains_and_circles(spark):
    """A chain is told to its end; a circle once round, from wherever it is entered; an unknown clause ends it."""
    olds = {f"c{i}": f"c{i - 1}" if i else None for i in range(40)} | {"x": "y", "y": "z", "z": "x", "tail": "x", "self": "self", "lost": "nowhere"}
    c = spark.createDataFrame([(k, k, v) for k, v in olds.items()], "claim_id string, doc_id string, supersedes string")
    got = {r.claim_id: r.lineage for r in family.lineage(c, spark.createDataFrame([(k, k) for k in olds], "doc_id string, filename string")).collect()}

    def told(k):
        seen = []
        while k in olds and k not in seen:
            seen.append(k)
            k = olds[k]
        return "; ".join(["set by " + seen[0], *("supersedes " + s for s in seen[1:])])

    assert got == {k: told(k) for k in olds}
