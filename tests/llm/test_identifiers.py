"""Personal data: exact kinds against plain Python, and what the bootstrapping discovers."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from pactline.llm import identifiers

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def ok(kind, x):
    d = [int(c) for c in re.sub("[^0-9]", "", x)]
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(v * 2 - 9 * (v > 4) if i % 2 else v for i, v in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def brute(text):
    t, out = text or "", []
    for kind, pattern in BASE.items():
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, t) if ok(kind, m.group())]
    return out


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def texts():
    rng = random.Random(9)
    out = [None, "", "a@b.c_d@e.f", "\U0001f600 x@y.z. é 1.2.3.4.5.6.7.8 0001.2.3.4 256.1.1.1 99999999999999999999.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111, 4111111111111112", "+1 (974) 555-3436 +123 +1234567 +1234567890123456", "a@b", "@.@", "4111  1111", "+1-", "x@y.z"]
    out += ["".join(rng.choice(["1", "23", "@", ".", "a", "b-", " ", "+", "(", ")", "4111111111111111", "é", "é.", "\n", "_", "255", "-"]) for _ in range(rng.randint(1, 50))) for _ in range(500)]
    return [*out, "same a@b.cd", "same a@b.cd", "x" * 5_000, "a." * 2_000 + "@ ", "1" * 5_000, "1-" * 2_500, "(" * 100_000 + "7", "word 12 " * 60_000 + "a@b.cd"]


def test_exact_kinds(spark):
    rows = [(i if i % 30 else None, t, "clash", [1]) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string, spans array<int>").repartition(4)
    got = identifiers.scan(df).select("doc_id", *identifiers.counted(F.col("base")), identifiers.listed(F.col("base")).alias("b"), identifiers.listed(F.col("spans")).alias("s")).collect()
    want = [(i, *(sum(k == kind for k, *_ in spans) for kind in BASE), joined(spans)) for i, spans in ((i, brute(t)) for i, t, _, _ in rows)]
    assert sorted((tuple(r)[:-1] for r in got), key=repr) == sorted(want, key=repr)
    assert all(set(filter(None, r.b.split(","))) <= set(r.s.split(",")) for r in got)
    assert hashlib.sha256(b"").hexdigest() == df.select(F.sha2(F.lit(""), 256)).head()[0]


def test_long_runs_take_linear_time(spark):
    """Texts on which the patterns as they are written would take hours."""
    runs = ["x" * 300_000 + "@y.", "a." * 200_000 + "@ b@c.", "1" * 400_000 + ".1.1.", "1-" * 200_000, "(" * 300_000 + "@", "1" + "-" * 300_000 + "1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(runs)], "doc_id long, text string")
    assert [r.doc_id for r in identifiers.scan(df).where("size(base) > 0").collect()] == []


def word(rng):
    return "".join(rng.choice(["er", "on", "th", "at", "ing", "sa"]) for _ in range(rng.randint(1, 4)))


def prose(rng, *inside):
    w = [word(rng) for _ in range(30)]
    for x in inside:
        w.insert(rng.randrange(len(w)), x)
    return " ".join(w)


def test_discovers_unseen_and_leaves_the_rest(spark):
    rng = random.Random(4)
    phone = lambda: f"({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
    docs, want = [], {}
    for i in range(60):  # seeds that share their contexts with identifiers the patterns miss
        docs.append((i, prose(rng, f"please call me at +1 {phone()} today", f"write to user{i}@mail.example.com now")))
    for i in range(100, 112):
        x, y = phone(), f"user{i}@localhost"
        docs.append((i, prose(rng, f"please call me at {x} today", f"write to {y} now")))
        want[i] = {("phone", x), ("email", y)}
    docs.append((150, prose(rng, "room " + docs[60][1].split("call me at ")[1][:14] + " is free")))  # found by its value, wherever it stands
    want[150] = {("phone", docs[60][1].split("call me at ")[1][:14])}
    for i in range(200, 260):  # clean: figures in contexts of their own
        docs.append((i, prose(rng, f"in the year {1900 + i}", f"{rng.randint(1, 99)} apples", f"call me at {rng.randint(1, 12)}")))
    docs += [(300 + i, docs[-1][1]) for i in range(50)]
    got = identifiers.scan(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    text = dict(docs)
    for r in got:
        more = {(identifiers.KINDS[x.k], text[r.doc_id][x.s : x.e]) for x in r.spans} - {(identifiers.KINDS[x.k], text[r.doc_id][x.s : x.e]) for x in r.base}
        assert more == want.get(r.doc_id, set()), text[r.doc_id]


def test_hundreds_of_copies_are_one_piece_of_evidence(spark):
    rng = random.Random(5)
    copy = prose(rng, "reach +1 (974) 555-3436 soon", "reach 555 3436 soon")
    docs = [(i, copy) for i in range(300)]
    out = identifiers.scan(spark.createDataFrame(docs, "doc_id long, text string"))
    assert out.where("size(spans) <> size(base)").count() == 0
    assert identifiers.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_redact(spark):
    df = spark.createDataFrame([(1, "é x@y.zz and 1.2.3.4."), (2, "none"), (3, "")], "doc_id long, text string")
    spans = identifiers.exact(F.col("text"))
    assert [r[0] for r in df.select(identifiers.redact(F.col("text"), spans)).collect()] == ["é [email] and [ip].", "none", ""]
