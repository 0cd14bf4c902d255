"""Access to JSON whose shape drifts, and keys of JSON that don't depend on how it was written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """A VARIANT; null where the text is no JSON."""
    return F.try_parse_json(text)


def field(value: Column, paths: list[str], kind: str = "string", default=None) -> Column:
    """The first of several paths that a VARIANT has, as `kind`; a path that is missing, null or of a kind that can't be
    cast counts as not there."""
    found = [F.try_variant_get(value, path, kind) for path in paths]
    return F.coalesce(*found, F.lit(default).cast(kind))


def canonical(text: Column) -> Column:
    """The same JSON with the members of every object in the order of their names and no blanks between; null if the text is
    no JSON.  A VARIANT keeps members in that order, whatever order they came in."""
    return F.to_json(F.try_parse_json(text))


def key(text: Column) -> Column:
    """One key for all ways to write the same JSON."""
    return F.sha2(canonical(text), 256)
