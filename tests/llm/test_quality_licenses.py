"""Counts of the native text operators against plain Python."""

import collections
import random
import re

from pactline.llm import licenses, quality

WS = re.compile("[^\x20\x09-\x0d]+")


def counts(t):
    w = WS.findall(t or "")
    n = len(w)
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    cover = [False] * n
    for i in range(n - 4):
        if c[tuple(w[i : i + 5])] > 1:
            cover[i : i + 5] = [True] * 5
    seen, dup = set(), 0
    for x in (t or "").split("\n"):
        if WS.search(x):
            dup += x in seen
            seen.add(x)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, sum(cover)


def texts():
    rng = random.Random(4)
    out = [None, "", "   \n\t", "one", "#*#", "a b c d e a b c d e", "é\u00a0ü x" * 9, "\x1cq\x0bz", "line\nline\n line\nline"]
    for _ in range(60):
        out.append(" ".join(rng.choice(["a", "bb", "c#", "d\n", "é", "\n"]) for _ in range(rng.randint(1, 60))))
    return [*out, "same row", "same row", "long " * 30000 + "end"]


def test_quality_counts(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()}
    for i, t, _ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(t), (i, t)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept) and 0 <= r.p_good <= 1


def test_quality_empty(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clean_prose_stays_and_junk_goes(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["er", "on", "th", "at", "ing"]) for _ in range(rng.randint(1, 4)))
    prose = [(i, " ".join(word() for _ in range(120)) + ".") for i in range(40)]
    junk = [(100 + i, " ".join(word() + "###" for _ in range(120))) for i in range(10)]
    kept = {r.doc_id for r in quality.judge(spark.createDataFrame(prose + junk, "doc_id long, text string")).where("kept").collect()}
    assert kept == set(range(40))


def test_fit_keeps_orientation():
    acc = quality.fit([((-1, 0), 10), ((0, 1), 80), ((-1, 1), 1)])
    assert quality.posterior((-1, 0), acc) < 0.5 < quality.posterior((0, 1), acc)
    assert quality.fit([]) == []


def test_a_lone_weak_rejection_is_overturned():
    """Rule 0 rejects documents that three others reject too; rule 3 rejects at random, now and then."""
    rng = random.Random(3)
    seen = collections.Counter()
    for _ in range(4000):
        bad = rng.random() < 0.2
        seen[tuple(-1 if rng.random() < (0.7 if bad else 0.02) else 1 for _ in range(3)) + (rng.choice([-1, 1, 1, 1]),)] += 1
    found = quality.fit(sorted(seen.items()), weak=(3,))
    assert abs(found.share - 0.8) < 0.1
    assert quality.posterior((1, 1, 1, -1), found) > 0.9 and quality.posterior((-1, -1, 1, 1), found) < 0.5
    assert found[3][-1] > -0.5 and found[0][-1] < -2


def brute(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER)))
    at, base = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                at.append(i)
                base.add(label)
    found, score = set(base), 0.0
    for i in range(0, max(len(w), 1), licenses.STRIDE):
        block = set(w[i : i + 2 * licenses.STRIDE])
        for label, text in licenses.TEMPLATES:
            need = set(licenses.template_words(text))
            if 10 * len(block & need) >= 8 * len(need):
                found.add(label)
                score = max(score, len(block & need) / len(need))
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(found)), round(score, 9)


def test_license_scan(spark):
    mit = licenses.TEMPLATES[0][1]
    rows = [None, "", "MIT License", "mit license mit license", "Apache-License; GENERAL public_license x general public license", "filler " * 300 + mit + " tail" * 90, mit.replace("charge", "cost").replace("copy", "part"), "Licensed under CC BY-NC 4.0.", "İ MİT LICENSE Kelvin \u212a license", "x" * 100000, "MIT License", "l\u00edcense apache\u00a0license"]
    df = spark.createDataFrame([(i, t, "y") for i, t in enumerate(rows)], "doc_id long, text string, labels string")
    out, blocks = licenses.scan(df)
    for r in out.collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) == brute(rows[r.doc_id]), rows[r.doc_id][:80]
    assert blocks.where("containment < 0.8").count() == 0
    assert licenses.scan(df.limit(0))[0].count() == 0


def test_license_filters_prune_and_lose_nothing(spark):
    """Against all pairs of blocks and templates: every match passes the positional filter, many others don't."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    vocab = sorted({w for _, t in licenses.TEMPLATES for w in licenses.template_words(t)})
    order = {w: (rng.randint(0, 9), w) for w in vocab}
    index = licenses.template_index(licenses.TEMPLATES, {w: n for w, (n, _) in order.items()}, 0.8)
    blocks = []
    for i in range(120):
        words = set(rng.sample(vocab, rng.randint(3, 60))) | (set(rng.choice(index)[6]) if i % 2 else set())
        blocks.append((i, sorted(words - set(rng.sample(sorted(words), len(words) // 12)), key=order.get)))
    df = spark.createDataFrame(blocks, "i int, b array<string>").select("i", "b", F.posexplode("b").alias("at", "word"))
    met = df.join(spark.createDataFrame(index, "word string, template int, label string, pos int, size int, need int, t array<string>, stride int"), "word")
    pairs = {(r.i, r.template) for r in met.collect()}
    passed = {(r.i, r.template) for r in met.where(licenses.may_match()).collect()}
    true = {(i, k) for i, b in blocks for k, (_, t) in enumerate(licenses.TEMPLATES) if 10 * len(set(b) & set(licenses.template_words(t))) >= 8 * len(licenses.template_words(t))}
    assert len(true) > 40 and true <= passed < pairs and len(passed) < 0.95 * len(pairs)


def test_long_templates_are_found_wherever_they_stand(spark):
    words = [f"word{i}" for i in range(300)]
    long, mid = " ".join(words), " ".join(f"mid{i}" for i in range(125))
    rows = [(i, "filler " * i + (long if i % 2 else mid) + " tail" * (i % 7)) for i in range(0, 400, 17)]
    out, blocks = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=[("long", long), ("mid", mid), ("short", "licensed under cc by four")])
    assert {r.doc_id: r.labels for r in out.collect()} == {i: "long" if i % 2 else "mid" for i, _ in rows}
