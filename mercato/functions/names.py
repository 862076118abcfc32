"""Name helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mercato.functions.cols import as_col


def full_name(first, last) -> Column:
    """trim(concat(first, ' ', last)) with NULL parts read as '' (PostgreSQL concat skips NULL)."""
    return F.trim(F.concat(F.coalesce(as_col(first), F.lit("")), F.lit(" "), F.coalesce(as_col(last), F.lit(""))))


def _words(name) -> Column:
    t = F.trim(F.regexp_replace(as_col(name), r"\s+", " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def first_name(name) -> Column:
    """First whitespace-separated word ('' when the name is blank)."""
    return F.coalesce(F.try_element_at(_words(name), F.lit(1)), F.lit(""))


def last_name(name) -> Column:
    """Remaining words joined by one space ('' when there is only one word)."""
    w = _words(name)
    return F.when(F.size(w) > 1, F.array_join(F.slice(w, 2, F.size(w)), " ")).otherwise(F.lit(""))
