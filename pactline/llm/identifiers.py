"""Personal data: four exact kinds, and bootstrapped contextual extraction of identifiers that they miss.

The exact kinds are patterns with a check each.  Their matches are the seeds.  A candidate is anything that looks like an
identifier: a token with digits, @ or a written-out at, together with groups of digits that follow it.  Its lexical
patterns are the words around it: the two before, the one before and the one after, the one before alone.  Candidates, by
their text, and patterns form a graph.  Each round scores a pattern for a kind by how much of what stands in it is held
to be of that kind, and then each candidate by the patterns it stands in, a noisy or over those of high confidence; what
scores high counts as of that kind in the next round.  In the end, candidates of high score that meet no exact match are
spans too, wherever they stand.

Copies of a document add no edge to the graph: it has one for each pattern and text.  A pattern that holds a third of
all candidates is only ever aggregated, with partial sums first, or joined by sort-merge, which adaptive execution splits.

Native: DataFrame functions only.  Texts are not shuffled; places come from the lengths of what lies between matches.

Defined results: null text counts as empty; repeated rows are scanned alike, and count once as evidence; ties between kinds
go to the first in the order listed; an empty table gives no rows; a null doc_id stays null; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .quality import let

KINDS = ["email", "ip", "card", "phone"]
#: Each is the kind's pattern, anchored where it can first begin and without ways back, so that long runs take linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the kind to be sought.
HINTS = {"email": r"@[A-Za-z0-9-]++\.", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"(?:[0-9][\x20-]?){15}[0-9]", "phone": r"\+[0-9]"}
OUTER = r"\s\x22'<>,;"
CANDIDATE = rf"(?<![^{OUTER}])(?:[^{OUTER}0-9@(\[]|[(\[](?!at[)\]]))*+(?:[0-9@]|[(\[]at[)\]])[^{OUTER}]*+(?:[\x20-][0-9(][0-9().-]*+)*+"
HAS_CANDIDATE = r"[0-9@]|[(\[]at[)\]]"
LEADING, TRAILING = r"^[^A-Za-z0-9+(]*+", r"(?<![^A-Za-z0-9)])[^A-Za-z0-9)]++$"
NEAR = 48
PRIOR, UNKNOWN, LEAST_SEEDS, LEAST_PATTERN, LEAST_SCORE = 1.0, 0.25, 3, 0.6, 0.8


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    from_end = F.reverse(F.split(digits, ""))

    def step(x: Column, i: Column) -> Column:
        d = x.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(from_end, step), F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(x, r"\."), lambda p: F.substring(F.concat(F.lit("00"), p), -3, 3).cast("int") <= 255)
    if kind == "card":
        return (n >= 16) & (n <= 19) & luhn(F.when((n >= 16) & (n <= 19), _digits(x)).otherwise("0"))
    return (n >= 8) & (n <= 15)


def _running(a: Column) -> Column:
    """Running sums of an array of integers.  An accumulated array is copied at each step, so it is done in blocks of 64 and
    for the blocks' sums."""

    def plain(x: Column) -> Column:
        return F.aggregate(x, F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n)))

    def blocks(x: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(0), F.size(x) - 1, F.lit(64)), lambda k: plain(F.slice(x, k + 1, 64)))
        return let(inner, lambda i: let(plain(F.transform(i, lambda b: F.element_at(b, -1))), lambda t: F.flatten(F.transform(i, lambda b, k: F.transform(b, lambda v: v + F.coalesce(F.get(t, k - 1), F.lit(0)))))))

    return let(a, lambda x: F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(blocks(x)))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, x, before, after>> of all matches in order: code points from and to, the match, and what lies on
    either side up to the next match, at most NEAR characters of it."""

    def of(between: Column, found: Column) -> Column:
        ends = _running(F.transform(found, lambda x, i: F.length(F.get(between, i)) + F.length(x)))
        one = lambda e, x, i: F.struct((F.get(e, i) - F.length(x)).alias("s"), F.get(e, i).alias("e"), x.alias("x"), F.substring(F.get(between, i), -NEAR, NEAR).alias("before"), F.substring(F.get(between, i + 1), 1, NEAR).alias("after"))
        return let(ends, lambda e: F.transform(found, lambda x, i: one(e, x, i)))

    cut = F.struct(F.split(text, pattern, -1).alias("b"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("f"))
    return let(cut, lambda p: of(p["b"], p["f"]))


def exact(text: Column) -> Column:
    """array<struct<k, s, e>>: matches of the four kinds that pass their checks, by kind and start; k counts from 0."""
    none = F.array().cast("array<struct<k:int,s:int,e:int>>")

    def of(k: int, kind: str) -> Column:
        good = F.filter(matches(text, PATTERNS[kind]), lambda m: passes(kind, m["x"]))
        return F.when(F.regexp_like(text, F.lit(HINTS[kind])), F.transform(good, lambda m: F.struct(F.lit(k).alias("k"), m["s"].alias("s"), m["e"].alias("e")))).otherwise(none)

    return F.when(F.regexp_like(text, F.lit("[0-9@]")), F.concat(*(of(k, kind) for k, kind in enumerate(KINDS)))).otherwise(none)


def _possible(x: Column) -> list[Column]:
    """For each kind, whether a text has the make of one."""
    n = F.length(_digits(x))
    dots, colons = F.size(F.split(x, r"\.")) - 1, F.size(F.split(x, ":")) - 1
    return [
        F.regexp_like(x, F.lit(r"[^@\s]@[^@\s]|[(\[]at[)\]]")),
        F.regexp_like(x, F.lit(r"^[0-9a-f.:/]+$")) & (n >= 4) & ((dots >= 3) | (colons >= 2)),
        F.regexp_like(x, F.lit(r"^[0-9][0-9 .-]*$")) & (n >= 12) & (n <= 19),
        F.regexp_like(x, F.lit(r"^[+(0-9][0-9 ().+/x-]*$")) & (n >= 7) & (n <= 15),
    ]


def _seed(x: Column) -> Column:
    """The first kind of which a text holds an exact match, else null."""

    def holds(kind: str) -> Column:
        return F.regexp_like(x, F.lit(HINTS[kind])) & F.exists(F.regexp_extract_all(x, F.lit(PATTERNS[kind]), F.lit(0)), lambda m: passes(kind, m))

    return F.coalesce(*(F.when(holds(kind), k) for k, kind in enumerate(KINDS)))


def _lexical(before: Column, after: Column) -> Column:
    """Hashes of the patterns made of the words before and after; figures in them count as 9."""
    tidy = lambda x: F.array_remove(F.split(F.regexp_replace(F.lower(x), "[0-9]+", "9"), r"\s+"), "")

    def of(b: Column, a: Column) -> Column:
        one, two, next_ = F.try_element_at(b, F.lit(-1)), F.try_element_at(b, F.lit(-2)), F.get(a, 0)
        made = [F.when(x, F.xxhash64(F.lit(i), *w)) for i, (x, w) in enumerate([(one.isNotNull(), [one]), (two.isNotNull(), [two, one]), (one.isNotNull() & next_.isNotNull(), [one, next_])])]
        return F.array_compact(F.array(*made))

    return let(F.struct(tidy(before).alias("b"), tidy(after).alias("a")), lambda w: of(w["b"], w["a"]))


def candidates(text: Column) -> Column:
    """array<struct<s, e, x, patterns>> of what looks like an identifier: x in lower case without marks around it."""

    def of(m: Column) -> Column:
        lead = F.length(m["x"]) - F.length(F.regexp_replace(m["x"], LEADING, ""))
        core = F.regexp_replace(F.regexp_replace(m["x"], LEADING, ""), TRAILING, "")
        return F.struct((m["s"] + lead).alias("s"), (m["s"] + lead + F.length(core)).alias("e"), F.lower(core).alias("x"), _lexical(m["before"], m["after"]).alias("patterns"))

    none = F.array().cast("array<struct<s:int,e:int,x:string,patterns:array<bigint>>>")
    return F.when(F.regexp_like(text, F.lit(HAS_CANDIDATE)), F.filter(F.transform(matches(text, CANDIDATE), of), lambda c: c["x"] != "")).otherwise(none)


def score_patterns(edges: DataFrame, known: DataFrame | None) -> DataFrame:
    """edges (p, v, seed, can) and known (v, k, score) -> (p, k, conf) of the patterns of high confidence."""
    e = edges.withColumns({"k": F.col("seed"), "score": F.when(F.col("seed").isNotNull(), 1.0)})
    if known is not None:
        e = edges.join(known, "v", "left").withColumns({"k": F.coalesce("seed", "k"), "score": F.when(F.col("seed").isNotNull(), 1.0).otherwise(F.col("score"))})
    sums = []
    for k in range(len(KINDS)):
        mine, can = F.coalesce(F.col("k") == k, F.lit(False)), F.get("can", k)
        sums += [F.sum(F.when(mine, F.col("score")).otherwise(0.0)).alias(f"pos{k}"), F.sum(F.when(mine, 0.0).when(F.col("k").isNull() & can, UNKNOWN).otherwise(1.0)).alias(f"neg{k}")]
    each = [F.struct(F.lit(k).alias("k"), F.col(f"pos{k}").alias("pos"), (F.col(f"pos{k}") / (F.col(f"pos{k}") + F.col(f"neg{k}") + PRIOR)).alias("conf")) for k in range(len(KINDS))]
    kept = e.groupBy("p").agg(*sums).select("p", F.explode(F.array(*each)).alias("c")).select("p", "c.*")
    return kept.where((F.col("pos") >= LEAST_SEEDS) & (F.col("conf") >= LEAST_PATTERN)).select("p", "k", "conf")


def score_candidates(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """(v, k, score) of the candidates without an exact match that high-confidence patterns hold to be of a kind."""
    open_ = edges.where(F.col("seed").isNull()).select("p", "v", "can")
    met = open_.join(patterns, "p").where(F.get("can", F.col("k")))
    per = met.groupBy("v", "k").agg((1 - F.exp(F.sum(F.log(1 - F.least("conf", F.lit(0.95)))))).alias("score")).where(F.col("score") >= LEAST_SCORE)
    best = F.max(F.struct("score", (-F.col("k")).alias("k")))
    return per.groupBy("v").agg(best.alias("b")).select("v", (-F.col("b.k")).alias("k"), F.col("b.score").alias("score"))


def bootstrap(edges: DataFrame, rounds: int = 3) -> DataFrame | None:
    """(v, k, score): texts that stand in patterns of high confidence; None if there are none."""
    known = None
    for _ in range(rounds):
        found = common.scratch(score_candidates(edges, score_patterns(edges, known)))
        if known is not None:
            common.drop(known)
        if found.isEmpty():
            return None
        known = found
    return known


def scan(docs: DataFrame, rounds: int = 3) -> DataFrame:
    """docs (doc_id, text) -> doc_id, base and spans, a row per row: arrays of (k, s, e), k the number of the kind."""
    t = F.coalesce(F.col("text"), F.lit(""))
    held = common.scratch(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", exact(t).alias("base"), candidates(t).alias("found")))
    c = held.select("rid", F.explode("found").alias("c")).select("rid", F.xxhash64("c.x").alias("v"), "c.s", "c.e", "c.x", "c.patterns")
    each = c.dropDuplicates(["v"]).select("v", _seed(F.col("x")).alias("seed"), F.array(*_possible(F.col("x"))).alias("can"))
    pairs = c.select("v", F.explode("patterns").alias("p")).distinct()
    edges = common.scratch(pairs.join(each, "v"))
    known = bootstrap(edges, rounds)
    rows = held.select("rid", "doc_id", "base")
    if known is None:
        return rows.select("doc_id", "base", F.col("base").alias("spans"))
    more = c.select("rid", "v", "s", "e").join(known, "v").groupBy("rid").agg(F.collect_list(F.struct(F.col("k").cast("int").alias("k"), "s", "e")).alias("more"))  # one row's spans
    clear = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["s"] < m["e"]) & (b["e"] > m["s"])))
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", clear)))
    return rows.join(more, "rid", "left").select("doc_id", "base", spans.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def counted(spans: Column) -> list[Column]:
    kinds = F.transform(spans, lambda x: x["k"])
    return [F.size(F.filter(kinds, lambda x: x == F.lit(KINDS.index(kind)))).cast("long").alias(f"n_{kind}") for kind in KINDS]


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; spans that meet count as the first of them."""
    name = F.array(*(F.lit(f"[{k}]") for k in KINDS))
    inner = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        put = F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0))), F.get(name, x["k"]))
        return F.when(x["s"] >= acc["at"], F.struct(put.alias("out"), x["e"].alias("at"))).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], x["e"]).alias("at")))

    return F.aggregate(inner, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
