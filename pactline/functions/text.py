"""Text scalars: normalisation, type and party guesses, tokens, formats.  All but NFKC are built-in expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..plans import dims

# Characters that normalisation replaces.
FROM = "‘’“”–— "
TO = "''\"\"-- "
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def clean(text: Column) -> Column:
    """Normalisation after NFKC: quotes, dashes, line ends, broken words, spaces, blank lines."""
    for a, b in LIGATURES.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.translate(text, FROM, TO)
    for pattern, by in ((r"\r\n?", "\n"), (r"(?U)(\w)-\n(\w)", "$1$2"), (r"[ \t]+(?=\n)", ""), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, by)
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalise(text: Column) -> Column:
    """NFKC (plain ASCII is NFKC already and skips Python), then clean()."""
    return clean(F.when(F.octet_length(text) == F.length(text), text).otherwise(nfkc(text)))


# Needles that tell a contract's type, in order.
TYPE_NEEDLES = [
    ("amendment", ("amendment", "addendum")), ("dpa", ("data processing agreement", "data protection addendum")),
    ("nda", ("non-disclosure", "nondisclosure", "confidentiality agreement")), ("sow", ("statement of work", "scope of work")),
    ("order_form", ("order form", "order schedule")),
    ("msa", ("master services agreement", "master service agreement", "master subscription agreement", "terms of service")),
]


def contract_type(filename: Column, text: Column) -> Column:
    """Type by the title, then the file name, then the body; first needle that is found."""
    out = F.lit("unknown")
    for where in (F.lower(F.substring(text, 1, 4000)), F.lower(filename), F.lower(F.substring(text, 1, 200))):
        for kind, needles in reversed(TYPE_NEEDLES):
            hit = F.lit(False)
            for n in needles:
                hit = hit | F.contains(where, F.lit(n))
            out = F.when(hit, kind).otherwise(out)
    return out


def counterparty(filename: Column) -> Column:
    """Name from a file name: no folder or ending, separators to spaces, no numbers, four words capitalised."""
    base = F.regexp_replace(F.regexp_replace(filename, r"^.*[/\\]", ""), r"\.[^.]*$", "")
    words = F.filter(F.split(F.regexp_replace(base, "[_-]", " "), r"\s+"), lambda w: (w != "") & ~w.rlike(r"^\d+$"))
    return F.array_join(F.transform(F.slice(words, 1, 4), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))), " ")


def fingerprint(quote: Column) -> Column:
    return F.substring(F.lower(F.trim(F.regexp_replace(quote, r"\s+", " "))), 1, 70)


def tokens(text: Column, stopwords: list[str] | None = None) -> Column:
    """Lower-case words of letters, digits, $, % and dots; more than one character, no stop word."""
    stop = F.array(*map(F.lit, dims.PASSAGE_STOPWORDS if stopwords is None else stopwords))
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(f"({dims.WORD})"), 1), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 3.4) + 1


def line_around(text: Column, start: Column, end: Column) -> Column:
    """The line that holds a span, trimmed, at most 220 characters."""
    before, after = F.substring_index(text.substr(F.lit(1), start), "\n", -1), F.substring_index(text.substr(end + 1, F.length(text)), "\n", 1)
    return F.substring(F.trim(F.concat(before, text.substr(start + 1, end - start), after)), 1, 220)


def excerpt(text: Column, start: Column, end: Column, around: int = 90) -> Column:
    lo = F.greatest(start - around, F.lit(0))
    return F.trim(F.replace(text.substr(lo + 1, end + around - lo), F.lit("\n"), F.lit(" ")))


def fence(text: Column, nonce: str) -> Column:
    """Untrusted text between marks; forged marks inside are redacted."""
    body = F.regexp_replace(text, r"(?i)<\/?untrusted[^>]*>", "[removed]")
    return F.concat(F.lit(f"<untrusted-{nonce}>\n"), body, F.lit(f"\n</untrusted-{nonce}>"))


def strip_meta(text: Column) -> Column:
    """Without **bold** marks."""
    return F.regexp_replace(text, r"\*\*([^*]+)\*\*", "$1")


def _any(text: Column, words) -> Column:
    return text.isin(*words)


def party(value: Column, our_party: Column, our_role: Column) -> Column:
    """us, counterparty, mutual or na."""
    t = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    parts = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) > 2)
    mine, buyer, seller = parts(t), F.array(*map(F.lit, dims.BUYER_WORDS)), F.array(*map(F.lit, dims.SELLER_WORDS))
    is_buyer, is_seller = F.arrays_overlap(mine, buyer) | _any(t, dims.BUYER_WORDS), F.arrays_overlap(mine, seller) | _any(t, dims.SELLER_WORDS)
    rest = F.when(F.size(mine) > 0, "counterparty").otherwise("na")
    return (
        F.when(_any(t, dims.NO_WORDS), "na")
        .when(_any(t, dims.MUTUAL_WORDS) | F.contains(t, F.lit("mutual")) | F.contains(t, F.lit("both")), "mutual")
        .when(_any(t, dims.US_WORDS), "us")
        .when(_any(t, dims.THEM_WORDS), "counterparty")
        .when(F.arrays_overlap(mine, parts(our_party)), "us")
        .when((our_role == "buyer") & is_buyer, "us")
        .when((our_role == "buyer") & is_seller, "counterparty")
        .when((our_role == "seller") & is_seller, "us")
        .when((our_role == "seller") & is_buyer, "counterparty")
        .when(~our_role.isin("buyer", "seller") & (F.arrays_overlap(mine, buyer) | F.arrays_overlap(mine, seller)), "mutual")
        .otherwise(rest)
    )


def owed_by(value: Column, our_party: Column, our_role: Column) -> Column:
    p = party(value, our_party, our_role)
    return F.when(p.isin("mutual", "na"), "either").otherwise(p)


def _alias(value: Column, known, aliases: dict[str, str]) -> tuple[Column, Column]:
    t = F.replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), F.lit(" "), F.lit("_"))
    table = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    return t, F.when(t.isin(*known), t).otherwise(F.try_element_at(table, t))


def kind(value: Column) -> Column:
    return _alias(value, dims.KINDS, dims.KIND_ALIASES)[1]


def anchor(value: Column) -> Column:
    t, known = _alias(value, dims.ANCHORS, dims.ANCHOR_ALIASES)
    return F.coalesce(known, F.when(t != "", "event"))


def role(value: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(t.isin("seller", "provider", "vendor", "supplier", "licensor"), "seller").when(t.isin("mutual", "both"), "mutual").otherwise("buyer")


def plain(value: Column) -> Column:
    """A number as text without a needless .0."""
    return F.when(value.isNotNull(), F.regexp_replace(F.format_string("%.6f", value.cast("double")), r"\.?0+$", ""))


def amount(value: Column, unit: Column, currency: Column) -> Column:
    """A compared value as text."""
    plural = F.when(value == 1, "").otherwise("s")
    return F.when(unit == "currency", F.concat_ws(" ", F.format_number(value, 0), currency)).when(unit == "percent", F.concat(plain(value), F.lit("%"))).when(unit == "days", F.concat(plain(value), F.lit(" day"), plural)).when(unit == "months", F.concat(plain(value), F.lit(" month"), plural)).otherwise(plain(value))


def gap_amount(value: Column, unit: Column) -> Column:
    return F.when(unit == "%", F.concat(plain(value), F.lit("%"))).when(unit == "days", F.concat(plain(value), F.lit(" days"))).when(unit == "hours", F.concat(plain(value * 24), F.lit(" hours"))).when(unit == "currency", F.format_number(value, 0)).otherwise(plain(value))


def dollars(value: Column) -> Column:
    """A sum in dollars without cents."""
    return F.concat(F.lit("$"), F.format_number(value, 0))


def money(value: Column) -> Column:
    """A sum in dollars without cents; a dash where there is none."""
    return F.when(F.coalesce(value, F.lit(0)) == 0, "\u2014").otherwise(dollars(value))


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, one).otherwise(many))


def dimension(name: Column) -> Column:
    """Key of a compare dimension by its name, an alias, or the first alias inside the text."""
    key = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), "[ -]", "_")
    out = F.lit(None).cast("string")
    for a, target in reversed(list(dims.COMPARE_ALIASES.items())):
        out = F.when(F.contains(key, F.lit(a)), target).otherwise(out)
    table = F.create_map(*(F.lit(x) for kv in dims.COMPARE_ALIASES.items() for x in kv))
    return F.when(key.isin(*(d[0] for d in dims.COMPARE)), key).otherwise(F.coalesce(F.try_element_at(table, key), out))


def band(score: Column) -> Column:
    out = F.lit("low")
    for least, name in reversed(dims.BANDS[:-1]):
        out = F.when(score >= least, name).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, dims.SEVERITIES)), severity), F.lit(0)), F.lit(99))
