"""Hard negatives against a scan of all pairs, and the bound on scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pactline.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def brute(rows, every=100, positives=5, depth=10):
    good = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((vec_id, [math.floor(256 * x) for x in v], label))
    clip = lambda s: max(-(1 << 53), min(1 << 53, s))
    dot = lambda a, b: clip(sum(x * y for x, y in zip(a, b)))  # noqa: E731  padded with zeros
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, (a, v, label) in enumerate(good):
        if a is None or a % every:
            continue
        scored = [(dot(v, w), b, other, j) for j, (b, w, other) in enumerate(good)]
        for ps, p, *_ in sorted((x for x in scored if x[2] == label and x[3] != i), key=key)[:positives]:
            fits = sorted((x for x in scored if x[2] != label and 30 * ps <= 100 * x[0] <= 90 * ps), key=key)[:depth]
            out += [(a, p, k, n, ps, ns) for k, (ns, n, *_) in enumerate(fits, 1)]
    return out


def compare(spark, rows, **how):
    df = spark.createDataFrame([(i, None if v is None else [float(x) if x is not None else None for x in v], label, "clash") for i, v, label in rows], SCHEMA)
    floats = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = [tuple(r) for r in negatives.mine(df, **how).collect()]
    assert sorted(got, key=repr) == sorted(brute(floats, **how), key=repr)
    return got


def vectors(rng, n, dim):
    centres = [[rng.gauss(0, 0.12) for _ in range(dim)] for _ in range(6)]
    return [(i, [c + rng.gauss(0, 0.06) for c in rng.choice(centres)], rng.randrange(4)) for i in range(n)]


def test_against_all_pairs(spark):
    rng = random.Random(1)
    rows = vectors(rng, 700, 16)
    rows += [(1000, rows[3][1], 1)] * 3 + [(i, rows[5][1], 2) for i in range(2000, 2150)]  # repeated rows; one very common vector
    rows += [(300, None, 1), (400, [None] * 16, 1), (500, [float("nan")] * 16, 1), (600, [float("inf")] * 16, 2), (700, [0.1] * 16, None), (None, rows[8][1], 3), (None, rows[8][1], 1)]
    rows += [(800, [], 1), (900, [0.5], 2), (-100, [0.2] * 9, 0)]
    assert len(compare(spark, rows)) > 300


def test_small_and_huge(spark, monkeypatch):
    assert negatives.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert compare(spark, [(100, [0.5, 0.5], 1)]) == []
    assert compare(spark, [(100, [], 1), (101, [], 1), (102, [], 2)]) == [(100, 101, 1, 102, 0, 0)]
    rng = random.Random(2)
    rows = [(i, [rng.choice([1, -1, 3]) * 10.0 ** rng.choice([0, 2, 9, 20, 38]) for _ in range(3)], i % 3) for i in range(120)]
    compare(spark, rows, every=10)
    monkeypatch.setattr(negatives, "ANCHORS_A_BLOCK", 7)
    compare(spark, vectors(rng, 400, 5), every=10, positives=3, depth=4)


def test_intervals_hold_every_score_and_prune(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(*r, "x") for r in vectors(rng, 900, 64)], SCHEMA)
    coded, book = negatives.index(df)
    block = negatives.Block(coded.toArrow(), book)
    wide = []
    for j, low, high in block.intervals(block.q[:40]):
        score = block.q @ block.q[j]
        assert (low <= score).all() and (score <= high).all()
        wide.append(np.mean(high - low) / score.std())
    assert np.mean(wide) < 1  # an interval is narrower than scores are spread


@pytest.mark.parametrize(("vec_id", "label", "want"), [(7, 9, 0), (14, 3, 4), (8, 9, 9), (0, 1, 2), (None, 5, 5), (7, None, None)])
def test_relabelled(spark, vec_id, label, want):
    df = spark.createDataFrame([(vec_id, label)], "vec_id long, label int")
    assert negatives.relabelled(df).select(F.col("label").cast("int")).head()[0] == want
