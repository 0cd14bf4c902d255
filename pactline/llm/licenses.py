"""License scans: phrases counted exactly, and an exact set-similarity join of text blocks with license templates.

A template is the set of its words; a block is 128 consecutive words of a text, every 64 words, so any passage of up
to 64 words lies whole in one.  A block matches a template when it holds at least `threshold` of its words.  Words are
ordered globally by the number of documents that have them, rarest first.  Of a block, the words that any template has
are put into this order.  A matching block must hold one of the template's first |T| - need + 1 words (prefix filter),
have at least `need` such words (length filter), and at least `need` of them from that word on in the block's own order
(positional filter; on the template's side the prefix says the same); what passes is verified on the whole sets.

Native: DataFrame functions only.  The template index is a few hundred rows fixed by the parameter, so it is
broadcast; no row of the corpus is shuffled except the matches.

Defined results: null or empty text has no words, no label and score 0; ties and repeated rows are scanned alike;
an empty table gives no rows; a null doc_id stays null; further columns are not read.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .quality import let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
STRIDE = 64
MAX_BROADCAST_ROWS = 20_000

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Public notices that licenses ask to be put into files.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc", "Licensed under CC BY 4.0"),
]


def template_words(text: str) -> list[str]:
    lowered = text.translate(str.maketrans(UPPER, LOWER))
    return sorted(set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)))


def _words(t: Column) -> Column:
    return F.array_remove(F.split(t, NOT_WORD), "")


def _places(w: Column, phrase: list[str]) -> Column:
    """Starts of the phrase in the word array w."""

    def here(x: Column, i: Column) -> Column:
        same = x == phrase[0]
        for j, word in enumerate(phrase[1:], 1):
            same = same & (F.get(w, i + j) == word)
        return F.when(same, i)

    return F.array_compact(F.transform(w, here))


def _starts(words: Column, phrase: list[str]) -> Column:
    return let(words, lambda w: _places(w, phrase))


def word_order(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """Documents that have each word of the vocabulary; the vocabulary is that of the templates, so this is bounded."""
    vocab = F.array(*map(F.lit, vocabulary))
    found = docs.select(F.explode(F.array_intersect(_words(F.lower(F.coalesce(F.col(text), F.lit("")))), vocab)).alias("w"))
    return {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


def template_index(templates: list[tuple[str, str]], frequency: dict[str, int], threshold: float) -> list[tuple]:
    """Rows (word, template, label, position in the template, size, need, words in global order, stride)."""
    out = []
    for k, (label, text) in enumerate(templates):
        ws = sorted(template_words(text), key=lambda w: (frequency.get(w, 0), w))
        need = -(-round(threshold * 1000) * len(ws) // 1000)
        out += [(w, k, label, p, len(ws), need, ws, stride_of(text)) for p, w in enumerate(ws[: len(ws) - need + 1])]
    return out


def stride_of(text: str) -> int:
    """How far apart blocks begin, so that a passage as long as the template lies whole in one of twice that length."""
    n, stride = len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)), STRIDE
    while stride < n:
        stride *= 2
    return stride


def may_match() -> Column:
    """Length and positional filter of a word that stands at `at` in the block's words b: were it the first common word
    in the order, could `need` words be common?  A match passes at its first common word."""
    return F.size("b") - F.col("at") >= F.col("need")


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) -> (documents, blocks).  documents: a row per row with n_words, n_base, first_word, last_word,
    base_labels, labels, score (highest containment of a matching template, 0 without one).  blocks: every match with
    its first word and its containment."""
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    vocabulary = sorted({w for _, t in templates for w in template_words(t)})
    frequency = dict.fromkeys(vocabulary, 0) | (word_order(docs, vocabulary) if vocabulary else {})
    index = template_index(templates, frequency, threshold)
    heads = sorted({row[0] for row in index})

    t = F.coalesce(F.col("text"), F.lit(""))
    exact = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    lowered, no_places, no_words = F.lower(t), F.array().cast("array<int>"), F.array().cast("array<string>")

    def row(w: Column) -> Column:
        """w: words of the lower-cased text; where other scripts' letters changed too it may only say too much."""
        cand = F.arrays_overlap(w, F.array(*map(F.lit, heads))) if heads else F.lit(False)
        return F.struct(F.size(w).cast("long").alias("n_words"), cand.alias("cand"))

    starts = {}
    for phrase in phrases:
        near = F.lit(True)
        for w in phrase.split():
            near = near & F.contains(lowered, F.lit(w))
        starts[phrase] = F.when(near, _starts(_words(exact), phrase.split())).otherwise(no_places)
    wide = docs.select("doc_id", t.alias("text")).select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", let(_words(lowered), row).alias("r"), F.size(_words(t)).cast("long").alias("n_words"), F.when(F.lit(True), _words(exact)).alias("words"), *(s.alias(f"p{i}") for i, s in enumerate(starts.values()))
    )
    places = F.concat(*(F.col(f"p{i}") for i in range(len(phrases)))) if phrases else no_places
    labels = F.array_compact(F.array(*(F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values())))) if phrases else F.array().cast("array<string>")
    flat = wide.select(
        "rid", "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(labels)).alias("base"), F.when(F.col("r.cand"), F.col("words")).alias("words"),
    )
    held = common.scratch(flat)

    frequency = dict(sorted(frequency.items(), key=lambda x: (x[1], x[0])))
    ordered = F.array(*map(F.lit, frequency)) if frequency else no_words
    idx = spark.createDataFrame(index, "word string, template int, label string, pos int, size int, need int, t array<string>, stride int")
    idx = F.broadcast(idx) if len(index) <= MAX_BROADCAST_ROWS else idx

    def met(stride: int) -> DataFrame:
        starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(stride)))
        blocks = held.where("words is not null").select("rid", "doc_id", "words", starts.alias("first_word"))
        blocks = blocks.select("rid", "doc_id", "first_word", F.array_intersect(ordered, F.slice("words", F.col("first_word") + 1, 2 * stride)).alias("b"))
        return blocks.select("rid", "doc_id", "first_word", "b", F.posexplode("b").alias("at", "word")).join(idx.where(F.col("stride") == stride), "word")

    hits = reduce(DataFrame.unionByName, map(met, sorted({row[7] for row in index} or {STRIDE})))
    hits = hits.where(may_match()).dropDuplicates(["rid", "first_word", "template"])
    shared = F.size(F.array_intersect("b", "t"))
    matches = hits.where(shared >= F.col("need")).select("rid", "doc_id", F.col("first_word").cast("long"), "template", "label", (shared / F.col("size")).alias("containment"))

    per = matches.groupBy("rid").agg(F.collect_set("label").alias("found"), F.max("containment").alias("score"))  # labels of the templates only: bounded
    out = held.join(per, "rid", "left")
    join = lambda a: F.array_join(a, ",")
    out = out.select("doc_id", "n_words", "n_base", "first_word", "last_word", join("base").alias("base_labels"), join(F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return out, matches.drop("rid")
