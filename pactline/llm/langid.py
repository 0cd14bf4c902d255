"""Language identification: multinomial logistic regression on TF-IDF weights of hashed character n-grams (one to
three letters), trained by follow-the-regularised-leader with L1 and L2 penalties, then calibrated by one temperature.

Document frequencies count every learning document.  Weights are fitted on a sample of at most `per_language` distinct
labelled rows a language (those of the lowest hashes of doc_id and text), the bound that keeps the driver's work fixed;
one row in five of it is held back for the temperature.  Rows are sparse throughout: training and prediction touch only
the n-grams that a text has.  Prediction reads whole texts, a batch at a time, and shuffles nothing.

Defined results: null text, or text without a letter (Unicode category L), is 'und' with score 0; without any learnt
language every text is 'und'; a null doc_id is never learnt from and not held out; repeated rows count once in the
sample, other rows of the same doc_id for themselves, and get the same answer; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import lean, slices

LOG2_DIM = 14
DIM = 1 << LOG2_DIM
LETTER = r"\p{L}"
#: Rows drawn by their hash for each one of the sample, so that copies among them leave enough.
DRAWN = 4
UNKNOWN = "und"
_SPACED = np.arange(1 << 16, dtype=np.uint32)
_SPACED[:128] = 32
_SPACED[97:123] = np.arange(97, 123)


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """Per text the counts of its hashed n-grams (DIM numbers)."""
    lowered = pc.utf8_lower(pc.fill_null(texts, ""))
    size = np.concatenate([[0], np.cumsum(np.asarray(pc.utf8_length(lowered)).astype(np.int64))])
    c = np.frombuffer("".join(lowered.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(c < 1 << 16, _SPACED[np.minimum(c, (1 << 16) - 1)], c)
    shift = np.uint32(32 - LOG2_DIM)
    one = (c * np.uint32(2654435761)) >> shift
    two = ((c[:-1] * np.uint32(0x85EBCA6B) + c[1:]) * np.uint32(0x9E3779B1)) >> shift
    three = (((c[:-2] * np.uint32(0xC2B2AE35) + c[1:-1]) * np.uint32(0x27D4EB2F) + c[2:]) * np.uint32(0x9E3779B1)) >> shift
    for a, b in zip(size[:-1].tolist(), size[1:].tolist(), strict=True):
        out = np.bincount(one[a:b], minlength=DIM)
        if b - a > 1:
            out += np.bincount(two[a : b - 1], minlength=DIM)
        if b - a > 2:
            out += np.bincount(three[a : b - 2], minlength=DIM)
        yield out


def weights(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's n-grams and their weights, of length 1 together."""
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at]) * idf[at]
    norm = np.sqrt((x * x).sum())
    return at, (x / norm if norm else x).astype(np.float32)


@lean
def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIM, np.int64), 0
    for batch in batches:
        for part in slices(batch, "text"):
            for counts in features(part.column("text")):
                df += counts > 0
                n += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["at", "n"])


@lean
def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            rows = [np.flatnonzero(x).astype(np.uint16).tobytes() + x[x > 0].astype(np.float32).tobytes() for x in features(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(rows, pa.binary())], ["lang", "x"])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


Row = tuple[np.ndarray, np.ndarray]


def logits(rows: list[Row], w: np.ndarray) -> np.ndarray:
    return np.array([w[:, at] @ x for at, x in rows]).reshape(len(rows), len(w))


def ftrl(rows: list[Row], y: np.ndarray, classes: int, epochs: int = 6, batch: int = 32, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.1, seed: int = 7) -> np.ndarray:
    """FTRL-proximal on sparse rows with classes y; returns weights (classes, dimensions), sparse through l1.  A step
    works out and moves the weights of the batch's own n-grams only: the others have no gradient."""
    z, n = np.zeros((classes, DIM)), np.zeros((classes, DIM))

    def w_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        shuffled = order.permutation(len(rows))
        for a in range(0, len(shuffled), batch):
            part = shuffled[a : a + batch]
            here, own = np.unique(np.concatenate([rows[i][0] for i in part]), return_inverse=True)
            x, of = np.concatenate([rows[i][1] for i in part]), np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            w = w_of(z[:, here], n[:, here])
            scores = np.stack([np.bincount(of, w[c][own] * x, len(part)) for c in range(classes)], 1)
            p = softmax(scores)
            p[np.arange(len(part)), y[part]] -= 1
            g = np.stack([np.bincount(own, p[of, c] * x, len(here)) for c in range(classes)])
            sigma = (np.sqrt(n[:, here] + g * g) - np.sqrt(n[:, here])) / alpha
            z[:, here] += g - sigma * w
            n[:, here] += g * g
    return w_of(z, n)


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden section over 1/20 .. 20."""

    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(scores / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()

    a, b, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Model:
    def __init__(self, langs: list[str], w: np.ndarray, idf: np.ndarray, t: float) -> None:
        self.langs, self.w, self.idf, self.t = langs, w.astype(np.float32), idf, t

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        names, scores = [], []
        lettered = pc.fill_null(pc.match_substring_regex(texts, LETTER), False).to_pylist()
        for has, counts in zip(lettered, features(texts), strict=True):
            if not self.langs or not has:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            at, x = weights(counts, self.idf)
            p = softmax((self.w[:, at] @ x)[None, :].astype(np.float64) / self.t)[0]
            k = int(p.argmax())
            names.append(self.langs[k])
            scores.append(float(p[k]))
        return names, scores


def train(docs: DataFrame, per_language: int = 400) -> Model:
    """docs (doc_id, text, lang): labelled rows to learn from; rows with null lang are left out."""
    known = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    df = np.zeros(DIM)
    n = 0
    for r in known.select("text").mapInArrow(_frequencies, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # DIM + 1 rows at most
        if r["at"] < 0:
            n = r["n"]
        else:
            df[r["at"]] = r["n"]
    idf = np.log((1 + n) / (1 + df)) + 1
    rows = _sample(known, per_language).mapInArrow(_sparse, "lang string, x binary").collect()  # per_language rows a language
    rows = sorted(rows, key=lambda r: (r["lang"], bytes(r["x"])))
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return Model([], np.zeros((0, DIM)), idf, 1.0)
    x: list[Row] = []
    for r in rows:
        k = len(r["x"]) // 6
        counts = np.zeros(DIM)
        counts[np.frombuffer(bytes(r["x"])[: 2 * k], np.uint16)] = np.frombuffer(bytes(r["x"])[2 * k :], np.float32)
        x.append(weights(counts, idf))
    y, held = np.array([langs.index(r["lang"]) for r in rows]), np.arange(len(rows)) % 5 == 4
    w = ftrl([r for r, h in zip(x, held, strict=True) if not h], y[~held], len(langs))
    t = temperature(logits([r for r, h in zip(x, held, strict=True) if h], w), y[held]) if held.any() else 1.0
    return Model(langs, w, idf, t)


def _sample(known: DataFrame, per_language: int) -> DataFrame:
    """At most per_language distinct rows (doc_id, text) of each language.  A threshold on the row's hash, from the
    language's count, draws a few times as many where the rows are read; only those meet to be ranked."""
    span = 1 << 31
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a language
    limits = {r["lang"]: min(span, -(-span * DRAWN * per_language // r["n"])) for r in counts}
    if not limits:
        return known.limit(0)
    limit = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))
    drawn = known.withColumn("h", F.xxhash64("doc_id", "text")).where(F.pmod("h", F.lit(span)) < F.element_at(limit, F.col("lang")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(span)), "h"))
    return drawn.dropDuplicates(["lang", "h"]).withColumn("rank", rank).where(F.col("rank") <= per_language).select("text", "lang")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of docs (doc_id, text, held_out) with lang_pred and score."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                names, scores = model.predict(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, per_language: int = 400) -> DataFrame:
    """Learns from docs whose crc32(doc_id) mod 3 is not 1 and predicts all of them."""
    third = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    model = train(docs.where(third != 1), per_language)
    return predict(docs.withColumn("held_out", F.coalesce(third == 1, F.lit(False))), model)
