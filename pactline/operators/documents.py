"""Row-producing operators on texts: chunks, passages, literal dates, injection indicators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import temporal as T
from ..plans import dims


def _spans(documents: DataFrame, find, names: list[str], schema: str) -> DataFrame:
    """A row per span that find(text) gives; texts without any cost no row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, i, *hit) for d, t in zip(f["doc_id"], f["text"], strict=True) for i, hit in enumerate(find(t or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "seq", *names])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, seq int, {schema}")


def chunk(documents: DataFrame, size: int = 1800, overlap: int = 320) -> DataFrame:
    return _spans(documents, lambda t: S.chunks(t, size, overlap), ["char_start", "char_end"], "char_start int, char_end int")


def passages(documents: DataFrame, size: int = 700, overlap: int = 120) -> DataFrame:
    def find(t: str) -> list[tuple]:
        return [(a, b, t[a:b], S.label(t, a)) for a, b in S.passages(t, size, overlap)]

    out = _spans(documents, find, ["char_start", "char_end", "passage", "section"], "char_start int, char_end int, passage string, section string")
    return out.withColumn("passage_id", F.concat(F.lit("p"), "seq", F.lit(":"), F.col("doc_id").cast("string")))


def literal_dates(documents: DataFrame) -> DataFrame:
    """Dates written in texts, with the line around them; quote and line leave the pass that finds the span."""

    def find(t: str) -> Iterator[tuple]:
        for a, b in S.dates(t):
            line = t[t.rfind("\n", 0, a) + 1 : b] + t[b:].partition("\n")[0]
            yield a, b, t[a:b], line.strip(" ")[:220]

    s = _spans(documents, find, ["char_start", "char_end", "quote", "line"], "char_start int, char_end int, quote string, line string")
    return s.select("doc_id", "char_start", "char_end", "quote", T.parse_date(F.col("quote")).alias("date"), "line").where("date is not null")


def indicators(documents: DataFrame) -> DataFrame:
    """Injection indicators: doc_id, why, span and excerpt.  Texts that no pattern can match stay in the JVM."""
    maybe = documents.where(F.col("text").rlike(r"(?i)(instruct|disregard|system|assistant|user|you\s+are|act\s+as|report|extract|mention|summari|flag|analyz|only|approved|automated|mark|classify|score|treat|\[|<!--|\{\{)"))
    find = lambda t: [(a, b, why, S.shown(t, a, b)) for a, b, why in S.injections(t)]
    s = _spans(maybe, find, ["char_start", "char_end", "why", "excerpt"], "char_start int, char_end int, why string, excerpt string")
    return s.select("doc_id", "seq", "why", "char_start", "char_end", "excerpt")


def metadata_indicators(metadata: DataFrame) -> DataFrame:
    """metadata (doc_id, fields map<string, string>): fields of a file whose values, read together, match a pattern of
    injected language; one row per document and reason."""
    text = F.concat_ws(" ", F.map_values("fields"))
    why = F.array_compact(F.array(*(F.when(text.rlike(f"(?is){p}"), F.lit(reason)) for p, reason in dims.INJECTION)))
    return metadata.select("doc_id", F.explode(why).alias("why"), F.substring(text, 1, 300).alias("excerpt"))


def quarantine(documents: DataFrame, found: DataFrame) -> DataFrame:
    return documents.select("doc_id").join(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_indicators"), F.col("n").isNotNull().alias("quarantined"))


def injection_findings(found: DataFrame) -> DataFrame:
    return found.select(F.concat_ws("_", F.lit("inj"), F.col("doc_id").cast("string"), "seq").alias("finding_id"), "doc_id", F.lit("injection").alias("kind"), F.lit("critical").alias("severity"), F.col("why").alias("title"), F.array(F.struct("doc_id", "char_start", "char_end", F.col("excerpt").alias("quote"))).alias("evidence"))


def hidden_text(chars: DataFrame, least: int = 20) -> DataFrame:
    """chars (doc_id, page, seq, text, size, color array, x0, top, page_width, page_height): text too small, white or
    off the page, twenty characters or more of a kind on a page."""
    white = (F.size("color") > 0) & F.forall("color", lambda c: c >= 0.99)
    off = (F.col("x0") < -1) | (F.col("top") < -1) | (F.col("x0") > F.col("page_width") + 1) | (F.col("top") > F.col("page_height") + 1)
    kind = F.array_compact(F.array(F.when(F.col("size") < 4.0, "tiny_font"), F.when(white, "white_text"), F.when(off, "off_page")))
    hits = chars.where(F.trim("text") != "").select("doc_id", "page", "seq", "text", F.explode(kind).alias("kind"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    return hits.groupBy("doc_id", "page", "kind").agg(F.count(F.lit(1)).alias("n"), F.substring(joined, 1, 300).alias("excerpt")).where(F.col("n") >= least)


def assemble_pages(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, text): one text joined by blank lines, with the marks of each page."""
    before = F.coalesce(F.sum(F.length("text") + 2).over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    p = pages.withColumn("char_start", before.cast("int")).withColumn("char_end", (F.col("char_start") + F.length("text")).cast("int"))
    rows = F.array_sort(F.collect_list(F.struct("page", "char_start", "char_end", "text")))
    g = p.groupBy("doc_id").agg(rows.alias("r"))
    return g.select("doc_id", F.array_join(F.transform("r", lambda x: x["text"]), "\n\n").alias("text"), F.transform("r", lambda x: F.struct(x["page"].alias("page"), x["char_start"].alias("char_start"), x["char_end"].alias("char_end"))).alias("pages"))


def needs_ocr(page_texts):
    """No pages, or fewer than 120 characters a page on average."""
    total = F.aggregate(page_texts, F.lit(0), lambda a, x: a + F.length(F.trim(x)))
    return (F.size(page_texts) <= 0) | (F.try_divide(total, F.size(page_texts)) < 120)


def page_of(pages, offset):
    """The page whose marks hold an offset."""
    return F.get(F.filter(pages, lambda p: (offset >= p["char_start"]) & (offset < p["char_end"])), 0)["page"]


def segments(marks: DataFrame, documents: DataFrame) -> DataFrame:
    """marks (doc_id, seq, char_start, char_end, kind) -> (doc_id, part, char_start, char_end, kind): a text cut into marked
    stretches and those between (kind null).  Marks are taken by start, then seq; one that begins inside a mark taken before
    is left out, so nested and overlapping marks give disjoint stretches that cover the text.  Marks end at the text's
    end; those without length or with a null in them are left out.

    Which marks are taken depends on those taken before, so a sweep over sorted partitions carries the end of the last one
    along; it holds no document's marks at once."""
    inside = documents.where("doc_id is not null").select(F.col("doc_id").alias("_doc"), F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    fit = marks.where("char_start >= 0 and char_end > char_start and seq is not null").select("doc_id", F.col("seq").cast("long").alias("seq"), F.col("char_start").cast("int").alias("a"), F.col("char_end").cast("int").alias("b"), F.col("kind").cast("string").alias("kind"))
    taken = inside.join(fit, F.col("_doc") == F.col("doc_id"), "left").select(F.col("_doc").alias("doc_id"), "size", "seq", "a", "b", "kind")
    dealt = taken.repartition("doc_id").sortWithinPartitions("doc_id", "a", "seq")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size, at, part = None, 0, 0, 0
        for batch in batches:
            out: list[tuple] = []
            for doc, length, a, b, kind in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "size", "a", "b", "kind")), strict=True):
                if doc != now:
                    if at < size:
                        out.append((now, part, at, size, None))
                    now, size, at, part = doc, length, 0, 0
                if a is not None and at <= a < size:
                    if a > at:
                        out.append((doc, part, at, a, None))
                        part += 1
                    at = min(b, size)
                    out.append((doc, part, a, at, kind))
                    part += 1
            yield table(out, batch.schema.field("doc_id").type)
            doc_type = batch.schema.field("doc_id").type
        if at < size:
            yield table([(now, part, at, size, None)], doc_type)

    def table(rows: list[tuple], doc_type: pa.DataType) -> pa.RecordBatch:
        kinds = (doc_type, pa.int32(), pa.int32(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "part", "char_start", "char_end", "kind"])

    return dealt.mapInArrow(sweep, f"doc_id {dict(documents.dtypes)['doc_id']}, part int, char_start int, char_end int, kind string")
