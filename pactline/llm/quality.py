"""Quality rules as weak supervision.  Each rule votes accept, reject or abstain on a document; expectation
maximisation over the histogram of vote patterns (at most 3^rules rows, whatever the corpus) estimates the share of good
documents and, for each rule, how often it accepts and rejects good and bad documents; a document is kept when
its posterior probability of being good reaches one half and no base limit fails.  So one rule's rejection counts for
as much as the corpus shows it to be worth: many accepting votes outweigh a rule that also rejects good documents.

Native: DataFrame functions only.  Text statistics are array expressions inside one row, so nothing is shuffled but
the vote histogram.

Defined results: null or empty text has no words, fails the base limit and is not kept; repeated rows are judged
alike; an empty table gives no rows; a null doc_id stays null; further columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_stutter", "n_upper", "n_marks", "n_lines"]


def let(expr: Column, fn) -> Column:
    """fn(value of expr), with expr evaluated once however often fn names it."""
    return F.element_at(F.transform(F.array(expr), fn), 1)


def _repeated(h: Column) -> Column:
    """h: hashes of all 5-word windows.  Number of words that lie in a window whose hash occurs twice or more."""

    def covered(pos: Column) -> Column:
        return F.aggregate(F.transform(pos, lambda x, k: F.least(F.coalesce(F.get(pos, k + 1) - x, F.lit(5)), F.lit(5)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)

    def twice(p: Column) -> Column:
        same = lambda k, x: F.coalesce(F.get(p, k)["h"] == x["h"], F.lit(False))
        hit = F.filter(p, lambda x, k: same(k - 1, x) | same(k + 1, x))
        return let(F.array_sort(F.transform(hit, lambda x: x["i"])), covered)

    pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, twice))


def statistics(docs: DataFrame, text: str = "text", carry: bool = False) -> DataFrame:
    """doc_id and the counts of STATS (all long) for every row; with carry also the row itself, as a struct."""
    row = [F.struct(*docs.columns).alias("row")] if carry else []
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, SPACE), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    lost = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))

    def of_hashes(hw: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(hw) - 5), lambda i: F.xxhash64(*(F.get(hw, i + j) for j in range(5))))
        return F.struct(
            F.when(F.size(hw) < 5, F.lit(0).cast("long")).otherwise(let(windows, _repeated)).alias("n_repeat_words"),
            F.size(F.array_distinct(hw)).alias("n_distinct"),
            F.size(F.filter(hw, lambda x, i: F.coalesce(F.get(hw, i + 1) == x, F.lit(False)))).alias("n_stutter"),
        )

    of_words = let(words, lambda w: F.struct(F.size(w).alias("n_words"), F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"), let(F.transform(w, lambda x: F.xxhash64(x)), of_hashes).alias("h")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    wide = docs.select("doc_id", *row, of_words.alias("w"), of_lines.alias("l"), lost(r"[#*$%&|<>]+").alias("n_symbols"), lost(r"\p{Lu}+").alias("n_upper"), lost("!+").alias("n_marks"))
    kept = ["doc_id"] + ["row"] * carry
    flat = wide.select(*kept, "w.n_words", "w.word_chars", "w.h.*", "l.*", "n_symbols", "n_upper", "n_marks")
    return flat.select(*kept, *(F.col(c).cast("long").alias(c) for c in STATS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _votes(accept: Column | None, reject: Column | None) -> Column:
    out = F.when(F.coalesce(reject, F.lit(False)), -1) if reject is not None else F.when(F.lit(False), 0)
    return (out if accept is None else out.when(F.coalesce(accept, F.lit(False)), 1)).otherwise(0)


def rules() -> dict[str, Column]:
    """name -> vote: 1 accept, -1 reject, 0 abstain."""
    n, chars = F.col("n_words"), F.col("word_chars")
    per_word = lambda c: F.try_divide(F.col(c), n)
    mean, upper = F.try_divide(chars, n), F.try_divide(F.col("n_upper"), chars)
    dup = F.try_divide(F.col("n_dup_lines"), F.col("n_lines"))
    sym, rep, kinds, stutter, marks = map(per_word, ("n_symbols", "n_repeat_words", "n_distinct", "n_stutter", "n_marks"))
    return {
        "length": _votes(n >= 50, n < MIN_WORDS),
        "prose": _votes(
            (n >= 20) & (sym <= 0.05) & (stutter <= 0.05) & (upper <= 0.15) & (marks <= 0.1),
            (n >= 20) & ((sym > 0.15) | (stutter > 0.15) | (upper > 0.35) | (marks > 0.3)),
        ),
        "word_length": _votes((mean >= 3) & (mean <= 9), (mean > 15) | (mean < 2)),
        "symbols": _votes(sym <= 0.02, sym > 0.3),
        "repeats": _votes((n >= 20) & (rep <= 0.05), rep > 0.2),
        "lines": _votes(dup <= 0.1, dup > 0.5),
        "variety": _votes((kinds > 0.5) & (sym <= 0.05) & (stutter <= 0.05), (kinds < 0.25) & (n < 400)),
        "stutter": _votes(stutter <= 0.02, stutter > 0.2),
        "capitals": _votes(upper <= 0.1, upper > 0.4),
        "marks": _votes(marks <= 0.1, marks > 0.5),
    }


#: Chance that a rule rejects and that it accepts a good and a bad document, as estimation starts.  This counts as WORTH of
#: the documents besides, so that a rule which few documents tell anything of keeps it.  WEAK rules reject what good
#: documents often are, such as all in capitals, of few words or of few lines.
REJECTS, REJECTS_WEAK, ACCEPTS, START_SHARE, WORTH = (0.005, 0.3), (0.1, 0.3), (0.9, 0.8), 0.8, 0.05
WEAK = {"word_length", "variety", "capitals", "lines"}


class Fit(list):
    """For each rule {vote: log of how much likelier it is on a good document than on a bad one}, and the share of good
    documents."""

    share = START_SHARE


def fit(patterns: list[tuple[tuple[int, ...], int]], weak: tuple[int, ...] = (), rounds: int = 500) -> Fit:
    """Expectation maximisation over (votes, count); weak: numbers of the rules that start as weak ones.  An abstention
    says nothing; a vote is never taken to speak against its own direction."""
    out = Fit()
    if not patterns:
        return out
    votes = np.array([p for p, _ in patterns], np.int64).reshape(len(patterns), -1)
    count = np.array([c for _, c in patterns], float)
    cast = {-1: (votes < 0).astype(float), 1: (votes > 0).astype(float)}
    rejects = np.array([REJECTS_WEAK if r in weak else REJECTS for r in range(votes.shape[1])]).T  # (good or bad, rules)
    start = {-1: rejects, 1: np.tile(np.array(ACCEPTS)[:, None], votes.shape[1])}
    chance, share, before, worth = start, START_SHARE, None, max(1.0, WORTH * count.sum())
    for _ in range(rounds):
        odds = math.log(share / (1 - share)) + sum(cast[v] @ _gain(chance, v) for v in cast)
        good = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        weight = np.stack([good * count, (1 - good) * count])
        chance = {v: (weight @ cast[v] + worth * start[v]) / (weight.sum(1, keepdims=True) + worth) for v in cast}
        share = float((weight[0].sum() + worth * START_SHARE) / (count.sum() + worth))
        if before is not None and abs(good - before).max() < 1e-9:
            break
        before = good
    out.extend({-1: float(r), 1: float(a)} for r, a in zip(_gain(chance, -1), _gain(chance, 1), strict=True))
    out.share = share
    return out


def _gain(chance: dict[int, np.ndarray], vote: int) -> np.ndarray:
    """Of each rule the log odds that this vote speaks for a good document."""
    odds = np.log(chance[vote][0] / chance[vote][1])
    return np.maximum(0, odds) if vote > 0 else np.minimum(0, odds)


def posterior(votes: tuple[int, ...], found: Fit) -> float:
    odds = math.log(found.share / (1 - found.share)) + sum(g[v] for v, g in zip(votes, found, strict=True) if v)
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps.  Rows travel with their counts, so no join brings them together."""
    return judge(docs, carry=True).where("kept").select("row.*")


def judge(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, all STATS, base_failed, p_good (posterior) and kept for every row of docs (doc_id, text); with carry
    also the row."""
    stats = common.scratch(statistics(docs, carry=carry))
    votes = rules()
    cast = stats.select("*", *(v.cast("int").alias(f"vote_{k}") for k, v in votes.items()))
    names = [f"vote_{k}" for k in votes]
    patterns = [(tuple(r[c] for c in names), r["n"]) for r in cast.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()]  # at most 3^rules rows
    found = fit(sorted(patterns), tuple(i for i, k in enumerate(votes) if k in WEAK))
    odds = F.lit(math.log(found.share / (1 - found.share)))
    for c, gain in zip(names, found or [{-1: 0.0, 1: 0.0}] * len(names), strict=True):
        odds = odds + F.when(F.col(c) == 1, gain[1]).when(F.col(c) == -1, gain[-1]).otherwise(0.0)
    p = 1 / (1 + F.exp(-odds))
    return cast.select("doc_id", *["row"] * carry, *STATS, *names, base_failed().alias("base_failed"), p.alias("p_good")).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))
