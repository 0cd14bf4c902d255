"""Fill-in-the-middle transformation.

A text is kept as its maximal runs of one character class, each with the number of units up to its end.  A cut is a
number of units: binary search finds the run in which it falls, and its place is the run's start plus the units left times
the length of one, so no list of units is ever made.  For unit "token" the classes are white space and other characters: a
token is a run of others with the white space before it, or the white space at a text's end.  For unit "char" the
classes are the lengths of characters in UTF-8, and each character is a unit.

Two numbers hashed from the seed and the document's id are the cuts; a third decides whether the document is transformed,
a fourth between the forms psm (prefix, suffix, middle) and spm (suffix, prefix, middle).  Nothing is shuffled.

Defined results: null text counts as empty; an empty text, and one that contains a marker, stays plain; a null doc_id hashes
as the seed alone; repeated rows come out alike; an empty table gives no rows; texts of any length are cut whole; further
columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words

MARKERS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

#: Bytes of the UTF-8 character that begins with each byte; 0 for those that begin none.
WIDTH = np.zeros(256, np.uint8)
WIDTH[:128], WIDTH[192:224], WIDTH[224:240], WIDTH[240:] = 1, 2, 3, 4


class Runs:
    """Maximal class runs of a batch of texts: first byte, bytes of one unit, and units up to the end, counted through the batch."""

    def __init__(self, data: np.ndarray, off: np.ndarray, unit: str = "token") -> None:
        self.off = off
        heads = WIDTH[data] > 0
        self.chars = np.zeros(len(data) + 1, np.int64)  # characters before each byte
        np.cumsum(heads, out=self.chars[1:])
        if unit == "char":
            at = np.flatnonzero(heads)
            kind = WIDTH[data[at]]
        else:
            at = np.arange(len(data))
            kind = words.SPACE[data].astype(np.uint8)
        new = np.ones(len(at), bool)
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        inner = off[(off > 0) & (off < len(data))]
        new[np.searchsorted(at, inner)] = True
        self.start = at[new]
        length = np.diff(np.append(self.start, len(data)))
        kind = kind[new]
        if unit == "char":
            self.stride, units = kind.astype(np.int64), length // np.maximum(kind, 1)
        else:
            last = np.zeros(len(kind), bool)
            last[np.searchsorted(self.start, off[1:][off[1:] > off[:-1]]) - 1] = True
            self.stride, units = length, ((kind == 0) | last).astype(np.int64)
        self.upto = np.cumsum(units)
        before = np.append(0, self.upto)[np.searchsorted(self.start, off)]
        self.base, self.n = before[:-1], np.diff(before)

    def cut(self, text: np.ndarray, k: np.ndarray) -> np.ndarray:
        """First byte after k units of each text."""
        out = self.off[text].copy()
        some = k > 0
        goal = (self.base[text] + k)[some]
        run = np.searchsorted(self.upto, goal)
        done = np.where(run > 0, self.upto[run - 1], 0)
        out[some] = self.start[run] + (goal - done) * self.stride[run]
        return out


def draws(seed: str, ids: list) -> np.ndarray:
    """Four numbers a document: the first 8-digit groups of a SHA-256, read as unsigned integers."""
    text = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(text, ">u4").reshape(-1, 4).astype(np.int64)


def _batch(batch: pa.RecordBatch, seed: str, rate: int, spm: int, unit: str, markers: tuple[bytes, bytes, bytes]) -> pa.RecordBatch:
    data, off = words.buffers(batch.column("text"))
    ids = batch.column("doc_id").to_pylist()
    runs, h = Runs(data, off, unit), draws(seed, ids)
    some = np.arange(len(ids))
    a, b = h[:, 0] % (runs.n + 1), h[:, 1] % (runs.n + 1)
    one, two = runs.cut(some, np.minimum(a, b)), runs.cut(some, np.maximum(a, b))
    raw, (p, s, m) = data.tobytes(), markers
    forms, outs = [], []
    for i in range(len(ids)):
        lo, x, y, hi = int(off[i]), int(one[i]), int(two[i]), int(off[i + 1])
        text = raw[lo:hi]
        if not text or h[i, 2] % 100 >= rate or any(mark in text for mark in markers):
            forms.append(PLAIN)
            outs.append(text)
        elif h[i, 3] % 100 < spm:
            forms.append(SPM)
            outs.append(b"".join((s, raw[y:hi], p, raw[lo:x], m, raw[x:y])))
        else:
            forms.append(PSM)
            outs.append(b"".join((p, raw[lo:x], s, raw[y:hi], m, raw[x:y])))
    plain = np.array([f == PLAIN for f in forms], bool)
    count = lambda x, y: pa.array(runs.chars[y] - runs.chars[x], pa.int64(), mask=plain)
    cols = [batch.column("doc_id"), pa.array(runs.n, pa.int64()), pa.array(forms, pa.string()), count(off[:-1], one), count(one, two), pa.array(outs, pa.binary()).view(pa.string())]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def check_markers(markers: tuple[str, ...]) -> None:
    """Where the end of one marker may begin another, an output could be read in two ways."""
    for x in markers:
        for y in markers:
            if any(x.endswith(y[:k]) for k in range(1, len(y) + (x != y))) or not x:
                raise ValueError(f"markers {x!r} and {y!r} may overlap")


def transform(docs: DataFrame, seed: str = "42", rate: int = 50, spm: int = 80, unit: str = "token", markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """docs (doc_id, text) -> SCHEMA, a row per row.  rate: documents in a hundred that are transformed; spm: of these, in a
    hundred, those of form spm; unit: token or char.  prefix_chars and middle_chars are null where the form is plain."""
    check_markers(markers)
    if unit not in ("token", "char"):
        raise ValueError(f"no unit {unit!r}")
    raw = tuple(x.encode() for x in markers)

    @words.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text"):
                yield _batch(part, seed, rate, spm, unit, raw)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output of transform() was made from."""
    parts = F.split(output, "|".join(rf"\Q{x}\E" for x in markers), -1)
    piece = functools.partial(F.get, parts)
    return F.when(form == PSM, F.concat(piece(1), piece(3), piece(2))).when(form == SPM, F.concat(piece(2), piece(3), piece(1))).otherwise(output)
