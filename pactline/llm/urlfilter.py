"""URL filters: host and path rules first, then exact membership in a listed key set through a Bloom filter cascade.

Level 1 is a Bloom filter of the listed keys.  Level 2 holds the keys of the universe that level 1 passes wrongly,
level 3 the listed keys that level 2 passes, and so on until a level passes nothing wrongly.  Over the universe it was
built for (all distinct keys of the corpus and the list) the cascade then answers exactly, and a page is judged by a
few bit tests inside its row: no join, no shuffle of pages.

Native: DataFrame functions only.  Levels are bit words summed up by bit_or; only the words reach the driver.  Keys are
dealt out by hash into as many parts as keep a part's cascade within about max_bits (2^24: 2 MB); each part has a
cascade of its own, and the pages are judged part by part, so no plan holds more than one part's bits.

Defined results: a null url, or one without ://, has empty host and path and fits no rule; its key is empty and is
listed only if the list has the empty key; ties and repeated rows are judged alike; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def host(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(h: Column, p: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule (host and path together) that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rh, rp, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((h == rh) | F.endswith(h, F.lit("." + rh))) & F.startswith(p, F.lit(rp))
        out = F.when(fits, F.struct(F.lit(rh + rp).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


@dataclass
class Level:
    bits: int
    hashes: int
    words: list[int]
    seed: int

    def passes(self, key: Column) -> Column:
        """Whether all bits of the key are set.  The words are one literal array, folded when the plan is made."""
        if not any(self.words):
            return F.lit(False)
        held = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        out = F.lit(True)
        for at in positions(key, self):
            word = F.get(held, F.shiftright(at, 6).cast("int"))
            out = out & (F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return out


def positions(key: Column, level: Level) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level.seed * 64 + j)), F.lit(level.bits)) for j in range(level.hashes)]


def _first_share(n: int, other: int) -> float:
    """Rate of wrong answers of level 1: it may pass about as many others as it holds."""
    return min(0.5, max(1e-3, n / max(1, 2 * other)))


def build(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Cascade over the distinct keys (column `key`) of both frames."""
    return _levels(_marked(listed, universe))


def _marked(listed: DataFrame, universe: DataFrame) -> DataFrame:
    """Scratch table of all distinct keys, with whether they are listed."""
    both = universe.select("key", F.lit(False).alias("listed")).unionByName(listed.select("key", F.lit(True).alias("listed")))
    return common.scratch(both.groupBy("key").agg(F.max("listed").alias("listed")))


def _levels(keys: DataFrame) -> list[Level]:
    levels: list[Level] = []
    inside, outside = keys.where("listed").select("key"), keys.where("not listed").select("key")
    n, other = inside.count(), outside.count()
    while n:
        share = 0.5 if levels else _first_share(n, other)  # later levels halve what is left
        bits = max(64, 64 * math.ceil(n * math.log(1 / share) / math.log(2) ** 2 / 64))
        level = Level(bits, max(1, round(math.log(1 / share) / math.log(2))), [], len(levels))
        spots = inside.select(F.explode(F.array(*positions(F.col("key"), level))).alias("at"))
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))
        words = spots.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(bit).alias("bits")).collect()  # bits / 64 rows at most
        level.words = [0] * (bits // 64)
        for row in words:
            level.words[row["w"]] = row["bits"]
        levels.append(level)
        # the next level holds those of the other side that this one passes wrongly; they have passed all before it
        wrong = common.scratch(outside.where(level.passes(F.col("key"))))
        common.drop(outside)
        inside, outside, n = wrong, inside, wrong.count()
    common.drop(inside, outside)
    return levels


def contains(levels: list[Level], key: Column) -> Column:
    """Exact membership for keys of the universe: listed if the first level that fails has an even number."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels), 0, -1):
        out = F.when(~levels[i - 1].passes(key), F.lit(i % 2 == 0)).otherwise(out)
    return out


def _parts(keys: DataFrame, max_bits: int) -> int:
    """Parts that keep each one's cascade at about max_bits."""
    n, other = (keys.where(c).count() for c in ("listed", "not listed"))
    if not n:
        return 1
    first = n * math.log(1 / _first_share(n, other)) / math.log(2) ** 2
    return max(1, math.ceil((first + 4 * n) / max_bits))  # the levels after the first take some 1.44 bits a key, halved each


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] | None = None, max_bits: int = 1 << 24) -> DataFrame:
    """pages (page_id, url) and listed keys (`key`: host and path) -> page_id, host, path, rule, verdict, listed."""
    rules = RULES if rules is None else rules
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).withColumn("key", F.concat("host", "path"))
    keys = _marked(listed, parts)
    k = _parts(keys, max_bits)
    if k == 1:
        out = parts.withColumn("listed", contains(_levels(keys), F.col("key")))
    else:
        part = lambda: F.pmod(F.xxhash64("key", F.lit("part")), F.lit(k))
        dealt = common.scratch(parts.withColumn("part", part()), by="part")
        each = [dealt.where(F.col("part") == i).withColumn("listed", contains(_levels(keys.where(part() == i)), F.col("key"))) for i in range(k)]
        out = functools.reduce(DataFrame.unionByName, each).drop("part")
    common.drop(keys)
    r = rule_of(F.col("host"), F.col("path"), rules)
    out = out.withColumn("r", r)
    verdict = F.coalesce("r.verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "listed")
