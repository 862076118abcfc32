"""Money arithmetic with the reference's rounding.

Amounts are computed per line in double precision, rounded half away from zero
on ``x * 100`` (``round2``), stored as ``decimal(12,2)`` and summed as decimals.
Spark's ``round(x, 2)`` is not the same rule (it rounds the shortest decimal
representation of ``x``), so every helper goes through ``round(x * 100) / 100``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mercato.functions.cols import as_col

MONEY = "decimal(12,2)"


def round2(x) -> Column:
    """Half away from zero to cents on a double: ``round(x * 100) / 100``."""
    return F.round(as_col(x).cast("double") * F.lit(100.0), 0) / F.lit(100.0)


def to_money(x) -> Column:
    """round2 then store as decimal(12,2)."""
    return round2(x).cast(MONEY)


def as_double(x) -> Column:
    """Decimal (or integer) to double, e.g. for the reported value of a decimal sum."""
    return as_col(x).cast("double")


def money_out(x) -> Column:
    """Reported money value: a double rounded to cents (used for every output column)."""
    return round2(as_col(x).cast("double"))
