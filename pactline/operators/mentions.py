"""Which of many names stand in which of many texts.

Names are put into an automaton that reads a text once, however many names there are.  Where all names together stay under
LIMIT characters they go to the workers with the job, and texts aren't shuffled.  More are cut into parts of that size, and
each part meets the texts in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, BLOCK = 4 << 20, 8 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOLD = str.maketrans(UPPER, UPPER.lower())
FOUND = "id string, name string, n long, first long"


def _automaton(names: list[str]):
    a = ahocorasick.Automaton()
    for name in names:
        a.add_word(name, len(name))
    a.make_automaton()
    return a


def _inside_word(text: str, start: int, end: int) -> bool:
    return (start > 0 and text[start - 1].isalnum() and text[start].isalnum()) or (end < len(text) and text[end].isalnum() and text[end - 1].isalnum())


def _search(automaton, ids: list, texts: list, folded: bool, words: bool) -> pa.RecordBatch:
    out: list[tuple] = []
    for i, text in zip(ids, texts, strict=True):
        seen: dict[str, list[int]] = {}
        text = (text or "").translate(FOLD) if folded else text or ""
        for last, size in automaton.iter(text) if len(automaton) else ():
            start = last + 1 - size
            if not (words and _inside_word(text, start, last + 1)):
                seen.setdefault(text[start : last + 1], [0, start])[0] += 1
        out += [(i, name, n, first) for name, (n, first) in seen.items()]
    cols = list(zip(*out, strict=True)) if out else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["id", "name", "n", "first"])


def find(texts: DataFrame, names: DataFrame, ignore_case: bool = False, words: bool = False, limit: int = LIMIT) -> DataFrame:
    """texts (id, text), names (name_id, name) -> (id, name_id, n, first): every name that stands in a text, how often
    (places may overlap) and where first.  ignore_case: A-Z and a-z are one; words: not inside a longer word.  Empty and
    null names stand nowhere."""
    key = F.translate("name", UPPER, UPPER.lower()) if ignore_case else F.col("name")
    listed = names.where("name <> ''").select("name_id", key.alias("name"))
    distinct = listed.select("name").distinct()
    size = distinct.agg(F.coalesce(F.sum(F.length("name")), F.lit(0))).head()[0]
    asked = texts.select(F.col("id").cast("string").alias("id"), "text")
    if size <= limit:
        held = [r["name"] for r in distinct.collect()]  # at most `limit` characters

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(held)
            for batch in batches:
                yield _search(automaton, batch.column("id").to_pylist(), batch.column("text").to_pylist(), ignore_case, words)

        found = asked.mapInArrow(run, FOUND)
    else:
        parts = -(-size // limit)
        chars = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).head()[0]
        blocks = max(1, -(-chars // BLOCK))
        left = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        right = distinct.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

        def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
            return pa.Table.from_batches([_search(_automaton(theirs.column("name").to_pylist()), mine.column("id").to_pylist(), mine.column("text").to_pylist(), ignore_case, words)])

        found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(meet, FOUND)
    kind = dict(texts.dtypes)["id"]
    return found.join(listed, "name").select(F.col("id").cast(kind).alias("id"), "name_id", "n", "first")


def mentioned(answers: DataFrame, known: DataFrame) -> DataFrame:
    """(id, name_id): the records (id) whose id stands in an answer (id, text), in order of their first places."""
    found = find(answers, known.select(F.col("id").alias("name_id"), F.col("id").cast("string").alias("name")))
    return found.select("id", "name_id", "first")


def named_contracts(questions: DataFrame, contracts: DataFrame, generic: tuple[str, ...] = ()) -> DataFrame:
    """questions (id, text), contracts (contract_id, counterparty, title) -> (id, contract_id) of the questions that name
    exactly one contract by a distinctive word, longer than three letters and not generic."""
    tidy = lambda c: F.array_distinct(F.split(F.lower(c), "[^a-z0-9]+"))
    own = contracts.select("contract_id", F.explode(tidy(F.coalesce("counterparty", "title"))).alias("w")).where(F.length("w") > 3)
    own = own.where(~F.col("w").isin(*generic)) if generic else own
    named = questions.select("id", F.explode(tidy(F.col("text"))).alias("w")).join(own, "w")
    one = named.groupBy("id").agg(F.min("contract_id").alias("contract_id"), F.max("contract_id").alias("_last"))
    return one.where(F.col("contract_id") == F.col("_last")).drop("_last")


def resolved(names: DataFrame, contracts: DataFrame) -> DataFrame:
    """names (id, text), contracts (contract_id, counterparty, title) -> (id, contract_id): the contract of that id, else
    one whose name holds the text or whose counterparty begins it, else one whose name holds a longer word of it; of
    several the smallest contract_id.  Case doesn't count."""
    kind = dict(contracts.dtypes)["contract_id"]
    asked = names.select("id", F.lower(F.trim("text")).alias("text")).where("text <> ''")
    name = contracts.select(F.col("contract_id").cast("string").alias("id"), F.lower(F.concat_ws(" ", "title", "counterparty")).alias("text"))
    by_id = asked.join(contracts.select("contract_id"), F.col("text") == F.lower(F.col("contract_id").cast("string"))).select("id", F.lit(1).alias("tier"), "contract_id")
    words = F.filter(F.split("text", r"\s+"), lambda w: F.length(w) > 3)
    wanted = asked.select("id", F.explode(F.concat(F.array(F.struct(F.lit(2).alias("tier"), F.col("text").alias("name"))), F.transform(words, lambda w: F.struct(F.lit(3).alias("tier"), w.alias("name"))))).alias("x")).select(F.struct("id", "x.tier").alias("name_id"), "x.name")
    held = find(name, wanted).select("name_id.*", F.col("id").cast(kind).alias("contract_id"))
    begun = find(asked.withColumn("id", F.col("id").cast("string")), contracts.select(F.col("contract_id").alias("name_id"), F.lower("counterparty").alias("name"))).where("first = 0")
    begun = begun.select(F.col("id").cast(dict(asked.dtypes)["id"]).alias("id"), F.lit(2).alias("tier"), F.col("name_id").alias("contract_id"))
    every = by_id.unionByName(held).unionByName(begun)
    return every.groupBy("id").agg(F.min(F.struct("tier", "contract_id")).alias("m")).select("id", "m.contract_id")
