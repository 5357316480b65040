"""Text expressions shared by the registry, curation and rule operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col


def squeeze(c: Column | str) -> Column:
    """Collapse runs of whitespace and trim."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def normal(c: Column | str) -> Column:
    return F.lower(squeeze(c))


def blank_to_null(c: Column | str) -> Column:
    t = F.trim(col(c))
    return F.when(F.length(t) > 0, t)


def lookup(key: Column | str, table: dict[str, str | float]) -> Column:
    """A fixed table as one literal map; a missing key gives NULL."""
    entries: list[Column] = []
    for k, v in table.items():
        entries += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*entries), col(key))


def word_any(c: Column | str, terms: Iterable[str]) -> Column:
    """Whether any of the terms occurs as whole words, ignoring case."""
    body = "|".join(t.replace("-", r"\-") for t in terms)
    return F.lower(col(c)).rlike(rf"\b(?:{body})\b")


def percent(c: Column | str, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", col(c) * 100)


def sorted_array(*items: Column) -> Column:
    """The non-null items, in the order given."""
    return F.array_compact(F.array(*items))
