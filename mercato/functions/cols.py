"""Small column helpers shared by the function modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(x) -> Column:
    """Column name or Column -> Column (literals must be wrapped by the caller)."""
    return F.col(x) if isinstance(x, str) else x


def ts_text(x) -> Column:
    """Timestamp as 'yyyy-MM-dd HH:mm:ss' text (stable across engines for output)."""
    return F.date_format(as_col(x), "yyyy-MM-dd HH:mm:ss")


def first_reason(*checks: tuple[Column, str]) -> Column:
    """First failing check wins: ``checks`` are (failed_condition, reason) in precedence order.

    Returns NULL when no check fails.  A NULL condition counts as "not failed".
    """
    expr = None
    for cond, reason in checks:
        expr = F.when(cond, F.lit(reason)) if expr is None else expr.when(cond, F.lit(reason))
    return expr if expr is not None else F.lit(None).cast("string")


def unmet(cond: Column) -> Column:
    """True unless ``cond`` holds: a NULL operand fails a required rule."""
    return ~F.coalesce(cond, F.lit(False))


def all_reasons(*checks: tuple[Column, str]) -> Column:
    """Every failing check, in order, as array<string> (empty when the row passes)."""
    return F.filter(
        F.array(*[F.when(cond, F.lit(reason)) for cond, reason in checks]),
        lambda r: r.isNotNull(),
    )


def reason_code(reason: Column, names) -> Column:
    """Reason text -> 1-based integer code (NULL stays NULL); keeps aggregation buffers fixed-width."""
    expr = None
    for i, n in enumerate(names, start=1):
        expr = F.when(reason == n, F.lit(i)) if expr is None else expr.when(reason == n, F.lit(i))
    return expr


def reason_name(code: Column, names) -> Column:
    """Inverse of ``reason_code`` (NULL stays NULL)."""
    expr = None
    for i, n in enumerate(names, start=1):
        expr = F.when(code == i, F.lit(n)) if expr is None else expr.when(code == i, F.lit(n))
    return expr


def first_by(code: Column, order: Column) -> Column:
    """Aggregate: the ``code`` of the row with the smallest ``order`` among rows where ``code`` is set.

    ``min_by`` over two primitive columns keeps a hash aggregate (a min over a
    struct with strings would force a sort aggregate).
    """
    return F.min_by(code, F.when(code.isNotNull(), order))


# Offsets that keep both parts of the composite key non-negative and within decimal(38,0):
# micros of years 1..9999 are within +-2.6e17; ids are 64-bit.
_MICROS_SPAN = 260_000_000_000_000_000
_ID_OFFSET = 2 ** 63


def newest_then_lowest_id_key(ts, ident) -> Column:
    """One orderable number for "created_at descending, then id ascending" (smaller = preferred).

    Lets a ``min_by(field, key)`` per field replace a min over a struct, so the
    aggregation buffer is fixed-width and Spark keeps a hash aggregate.
    """
    def big(n: int) -> Column:
        return F.lit(str(n)).cast("decimal(38,0)")

    age = big(_MICROS_SPAN) - F.unix_micros(as_col(ts)).cast("decimal(38,0)")
    rank = as_col(ident).cast("decimal(38,0)") + big(_ID_OFFSET)
    return (age * big(10 ** 20) + rank).cast("decimal(38,0)")
