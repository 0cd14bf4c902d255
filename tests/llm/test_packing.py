"""Exact round trip of tokens, sequence laws, the plan against brute force."""

import random
import zlib

import numpy as np
import pytest

from pactline.llm import packing
from pactline.llm.queries import tokenizer_path


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars string")


def test_round_trip_and_edges(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    texts = [None, "", "Don't STOP, don't.", "élan ÉLAN ... .!? a1b22", "<|endoftext|> x <|ENDOFTEXT|>", "word " * 5000, "word " * 5000, "tab\tnew\nline x", "Σίσυφος ΟΔΟΣ"]
    rows = [(i % 8, t, "clash") for i, t in enumerate(texts)] + [(None, "null id", "")]
    out = packing.pack(docs_of(spark, rows), tokenizer_path(), with_ids=True).toPandas()
    want = sorted(tuple(np.append(np.array(tok.encode(t or "", add_special_tokens=False).ids, "<u4"), np.uint32(1)).tolist()) for _, t, _ in rows)
    got = []
    for doc, g in out.groupby("doc_id", dropna=False):
        per = {}
        for _, p in g.sort_values("start").iterrows():
            assert zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 and len(p.ids) == p.length
            per.setdefault(p.doc_tokens, []).append(p)
        for total, ps in per.items():
            starts = [p.start for p in ps]
            for copy in range(starts.count(0)):
                ids = [i for s in sorted(set(starts)) for i in [p for p in ps if p.start == s][copy].ids]
                assert len(ids) == total
                got.append(tuple(ids))
    assert sorted(got) == want
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 2048 and list(g.offset) == [0, *np.cumsum(g.length)[:-1]]


def test_empty_table(spark):
    assert packing.pack(docs_of(spark, []), tokenizer_path()).count() == 0


def test_fill_is_closest():
    rng = random.Random(1)
    for _ in range(60):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(4)}
        first, cap = max(counts), 40
        pattern = packing.fill(counts, first, cap)
        reach = {first}
        for n, c in counts.items():
            for _ in range(c - (n == first)):
                reach |= {r + n for r in reach if r + n <= cap}
        assert sum(n * k for n, k in pattern.items()) == max(reach)
        assert all(k <= counts[n] for n, k in pattern.items())


def test_plan_uses_all():
    counts = {7: 13, 11: 4, 40: 2, 3: 50}
    used = {}
    for pattern, times in packing.plan(counts, 40):
        for n, k in pattern.items():
            used[n] = used.get(n, 0) + k * times
    assert used == counts


def test_sequences(spark):
    p = packing.pack(docs_of(spark, [(1, "a b c d e", ""), (2, "f " * 3000, "")]), tokenizer_path(), with_ids=True)
    rows = packing.sequences(p).collect()
    assert all(len(r.ids) == 2048 or len(r.ids) & (len(r.ids) - 1) == 0 for r in rows)


def test_other_tokenizers():
    """A tokenizer whose ids aren't those of its words one by one encodes whole texts."""
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    enc, texts = packing.WordEncoder(path), ["Two  words\n", None, "caf\u00e9 x"]
    ids, off = enc.encode(pa.array(texts))
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert not enc.by_word and [ids[a:b].tolist() for a, b in zip(off, off[1:])] == want
    assert packing.WordEncoder(tokenizer_path()).by_word


@pytest.mark.parametrize("text", ["plain words here", "a<|startoftext|>b"])
def test_encoder(text):
    import pyarrow as pa
    from tokenizers import Tokenizer

    ids, off = packing.WordEncoder(tokenizer_path()).encode(pa.array([text, None, text.upper()]))
    tok = Tokenizer.from_file(tokenizer_path())
    assert ids[: off[1]].tolist() == tok.encode(text, add_special_tokens=False).ids
    assert off[1] == off[2] and ids[off[2] :].tolist() == tok.encode(text.upper(), add_special_tokens=False).ids
