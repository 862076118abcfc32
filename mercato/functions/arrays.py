"""Array helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mercato.functions.cols import as_col

# Fixed value: the all-zero id means "unset" in the reference's id space.
ZERO_ID = 0


def normalize_addon_ids(arr) -> Column:
    """Drop NULL / zero ids, de-duplicate, sort by text.

    Text order matches the reference, which compares the canonical string form
    of each id.  An absent array becomes an empty array.
    """
    a = F.coalesce(as_col(arr), F.array())
    kept = F.filter(a, lambda x: x.isNotNull() & (x != F.lit(ZERO_ID)))
    return F.array_sort(F.array_distinct(kept), lambda l, r: F.when(l.cast("string") < r.cast("string"), -1)
                        .when(l.cast("string") > r.cast("string"), 1).otherwise(0))


def ids_text(arr) -> Column:
    """Array of ids -> comma separated text (stable key for outputs and comparisons)."""
    return F.array_join(F.transform(as_col(arr), lambda x: x.cast("string")), ",")
