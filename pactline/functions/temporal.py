"""Date arithmetic as Column expressions.  Months are added one step after the other (31 Jan, 28 Feb, 28 Mar), as
contracts roll, so recurrences are folds and not sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def recurrence_months(text: Column) -> Column:
    """Months of an ISO-8601 duration PnYnM; null for none, zero or anything else."""
    t = F.upper(F.trim(text))
    part = lambda unit: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(t, rf"^P(?:\d+Y)?(\d+){unit}" if unit == "M" else r"^P(\d+)Y", 1), F.lit("")), F.lit("99999")).cast("int"), F.lit(0))
    return F.when(t.rlike(r"^P(?=\d)(\d+Y)?(\d+M)?$"), F.nullif(part("Y") * 12 + part("M"), F.lit(0)))


def roll_term(effective: Column, initial_months, renewal_months, today) -> Column:
    """struct(term_end, renewals, ends): the term end rolled on while it is not after today; ends lists every end."""
    initial, renewal, today = as_col(initial_months), as_col(renewal_months), as_col(today)
    first = F.add_months(effective, initial)
    # enough steps to pass today, one more for clamped month ends
    steps = F.greatest(F.ceil(F.months_between(today, first) / renewal).cast("int") + 2, F.lit(0))
    start = F.struct(first.alias("term_end"), F.lit(0).alias("renewals"), F.array(first).alias("ends"))

    def step(acc: Column, _: Column) -> Column:
        nxt = F.add_months(acc["term_end"], renewal)
        return F.when(acc["term_end"] <= today, F.struct(nxt.alias("term_end"), (acc["renewals"] + 1).alias("renewals"), F.array_append(acc["ends"], nxt).alias("ends"))).otherwise(acc)

    rolled = F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, step)
    return F.when(effective.isNull(), None).otherwise(F.when(renewal.isNull() | (renewal <= 0), start).otherwise(rolled))


def month_end(today) -> Column:
    return F.last_day(as_col(today))


def quarter_end(today) -> Column:
    return F.last_day(F.add_months(F.trunc(as_col(today), "quarter").cast("date"), 2))


def anchor_date(anchor: Column, effective: Column, term_end: Column, today) -> Column:
    """The date an anchor stands for; null for events that have not happened."""
    return (
        F.when(anchor.isin("effective_date", "signature_date", "anniversary"), effective)
        .when(anchor.isin("term_end", "expiry"), term_end)
        .when(anchor == "month_end", month_end(today))
        .when(anchor == "quarter_end", quarter_end(today))
    )


def anchor_label(anchor: Column) -> Column:
    named = {"effective_date": "Effective Date", "signature_date": "Signature Date (using Effective Date)", "anniversary": "anniversary of the Effective Date", "term_end": "end of the then-current Term", "expiry": "end of the then-current Term", "month_end": "end of the calendar month", "quarter_end": "end of the calendar quarter"}
    out = anchor
    for k, v in named.items():
        out = F.when(anchor == k, v).otherwise(out)
    return out


def occurrences(anchor: Column, offset_days: Column, recurrence: Column, today, horizon_days: int = 730, past_days: int = 90, guard: int = 200) -> Column:
    """Due dates up to the horizon.  A single date has no lower bound; recurring ones are kept from today - past_days."""
    today = as_col(today)
    first, horizon = F.date_add(anchor, offset_days.cast("int")), F.date_add(today, horizon_days)
    start = F.struct(first.alias("at"), F.array().cast("array<date>").alias("out"))
    steps = F.least(F.greatest(F.ceil(F.months_between(horizon, first) / recurrence).cast("int") + 2, F.lit(1)), F.lit(guard))

    def step(acc: Column, _: Column) -> Column:
        hit = (acc["at"] <= horizon) & (acc["at"] >= F.date_add(today, -past_days))
        return F.struct(F.add_months(acc["at"], recurrence).alias("at"), F.when(hit, F.array_append(acc["out"], acc["at"])).otherwise(acc["out"]).alias("out"))

    many = F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda a: a["out"])
    once = F.when(first <= horizon, F.array(first)).otherwise(F.array().cast("array<date>"))
    return F.when(first.isNull(), None).when(recurrence.isNull(), once).otherwise(many)


def months_between_up(start: Column, end: Column) -> Column:
    """Whole months from start to end, a begun month counted; 0 if end is not after start."""
    m = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    return F.when(end <= start, 0).otherwise(m + (F.add_months(start, m) < end).cast("int"))


DMY = r"(?i)\b(\d{1,2})\s+(January|February|March|April|May|June|July|August|September|October|November|December)\s+(\d{4})\b"
MDY = r"(?i)\b(January|February|March|April|May|June|July|August|September|October|November|December)\s+(\d{1,2}),?\s+(\d{4})\b"
ISO = r"\b(\d{4})-(\d{2})-(\d{2})\b"


def parse_date(text: Column) -> Column:
    """First plausible date: day month year, then month day year, then ISO; only the first match of each is tried."""
    g = lambda p, i: F.regexp_extract(text, p, i)
    name = lambda c: F.initcap(F.lower(c))
    dmy = F.try_to_date(F.concat_ws(" ", g(DMY, 1), name(g(DMY, 2)), g(DMY, 3)), "d MMMM yyyy")
    mdy = F.try_to_date(F.concat_ws(" ", g(MDY, 2), name(g(MDY, 1)), g(MDY, 3)), "d MMMM yyyy")
    iso = F.try_to_date(F.concat_ws("-", g(ISO, 1), g(ISO, 2), g(ISO, 3)), "yyyy-MM-dd")
    return F.coalesce(F.when(text.rlike(DMY), dmy), F.when(text.rlike(MDY), mdy), F.when(text.rlike(ISO), iso))
