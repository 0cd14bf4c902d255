"""Many names in many texts, against plain search."""

import random

from pactline.operators import mentions, portfolio


def overlapping(text, name):
    return [i for i in range(len(text)) if text.startswith(name, i)]


def test_all_names_in_all_texts(spark):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abAB é") for _ in range(n))
    texts = [(i, make(rng.randint(0, 60))) for i in range(120)] + [(500, None), (501, ""), (502, "ab" * 50_000), (7, "repeated id ab")]
    names = [(i, make(rng.randint(1, 4))) for i in range(80)] + [(900, None), (901, ""), (902, "ab"), (903, "ab")]
    t, n = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(names, "name_id int, name string")
    fold = lambda s: s.translate(mentions.FOLD)
    for ignore, limit in ((False, 1 << 20), (True, 1 << 20), (False, 40), (True, 25)):
        got = sorted(tuple(r) for r in mentions.find(t, n, ignore_case=ignore, limit=limit).collect())
        same = fold if ignore else (lambda s: s)
        want = [(i, k, len(at), at[0]) for i, text in texts for k, name in names if text and name and (at := overlapping(same(text), same(name)))]
        assert got == sorted(want)


def test_whole_words(spark):
    t = spark.createDataFrame([(1, "Acme and Acmes; acme"), (2, "macme"), (3, "(Acme)")], "id int, text string")
    n = spark.createDataFrame([("a", "Acme")], "name_id string, name string")
    assert sorted((r.id, r.n) for r in mentions.find(t, n, ignore_case=True, words=True).collect()) == [(1, 2), (3, 1)]
    assert mentions.find(t, n.limit(0)).count() == 0 and mentions.find(t.limit(0), n).count() == 0


def test_contracts_named_and_resolved(spark):
    c = spark.createDataFrame([("k1", "Acme Cloud", "Master agreement"), ("k2", "Globex", "Cloud order"), ("k3", "Initech Ltd", "Nda")], "contract_id string, counterparty string, title string")
    asked = {1: "when does globex renew", 2: "acme cloud and globex", 3: "cloud things", 4: "nothing", 5: ""}
    q = spark.createDataFrame(list(asked.items()), "id int, text string")
    assert {r.id: r.contract_id for r in mentions.named_contracts(q, c).collect()} == {1: "k1"} | {1: "k2", 3: "k1"}
    values = ["K2", "acme", "Globex Corporation of Springfield", "the order", "cloud", "none at all", " ", "initech services"]
    v = spark.createDataFrame(list(enumerate(values)), "id int, text string")
    got = {r.id: r.contract_id for r in mentions.resolved(v, c).collect()}
    want = {i: r.contract_id for i, x in enumerate(values) if x.strip() and (r := portfolio.resolve_contract(c, x).head())}
    assert got == want and len(want) >= 6


def test_ids_in_answers(spark):
    a = spark.createDataFrame([(1, "see k1:fact and gap:7, then k1:fact"), (2, "no ids")], "id int, text string")
    known = spark.createDataFrame([("k1:fact",), ("gap:7",), ("k9",)], "id string")
    assert sorted((r.id, r.name_id) for r in mentions.mentioned(a, known).collect()) == [(1, "gap:7"), (1, "k1:fact")]
