"""Fill-in-the-middle against plain Python, unit by unit."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pactline.llm import infill

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def brute(doc_id, text, unit="token"):
    t = text or ""
    units = TOKEN.findall(t) if unit == "token" else list(t)
    d = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in infill.MARKERS) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, t
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(8)
    out = [None, "", " ", "\n\t \x0b", "one", " one ", "a<P>b", "<S>", "x <M> y", "   é", "<", "<S", "S> <P", "\U0001f600 \U0001f600é", "\x1c x\x85"]
    out += ["".join(rng.choice(["a", "é", " ", "\n", "<", "P>", "中", "\U0001f600", "  "]) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    return [*out, "same", "same", "long " * 200_000 + "end ", "x" * 500_000, " " * 300_000]


@pytest.mark.parametrize("unit", ["token", "char"])
def test_every_cut(spark, unit):
    rows = [(i if i % 40 else None, t, "clash", i) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, n long")
    got = infill.transform(df, unit=unit).withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    want = sorted((brute(i, t, unit) + (t or "",) for i, t, _, _ in rows), key=repr)
    assert sorted((tuple(r)[1:] for r in got), key=repr) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_table_and_markers(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert infill.transform(df).count() == 0
    for bad in (("<<", "<S>", "<M>"), ("<P>", "P><", "<M>"), ("<P>", "<P>", ""), ("aba", "c", "d")):
        with pytest.raises(ValueError):
            infill.transform(df, markers=bad)
    assert infill.transform(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), rate=100, spm=0, markers=("|p", "(s)", ".*m")).head().form == "psm"
