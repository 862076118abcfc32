"""Branch clock helpers (H1-H3): minutes of day, 'HH:MM' text, open/closed.

All are native column expressions (no UDF): they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mercato.functions.cols import as_col

# Branch local time zone and its fixed fallback offset.
BRANCH_TIME_ZONE = "Asia/Karachi"
BRANCH_FALLBACK_OFFSET_HOURS = 5
MINUTES_PER_DAY = 24 * 60

_CLOCK = r"^([0-9]{1,2}):([0-9]{2})$"


def parse_clock(text) -> Column:
    """'HH:MM' (hour 0-23, minute 0-59; the hour may have one digit) -> minutes of day, else NULL."""
    t = as_col(text)
    hour = F.regexp_extract(t, _CLOCK, 1)
    minute = F.regexp_extract(t, _CLOCK, 2)
    h = F.when(hour != "", hour.cast("int"))
    m = F.when(minute != "", minute.cast("int"))
    ok = t.rlike(_CLOCK) & (h <= 23) & (m <= 59)
    return F.when(ok, (h * 60 + m).cast("short"))


def format_clock(minutes) -> Column:
    """Minutes of day -> zero-padded 'HH:MM'; negatives clamp to 0, values wrap at 24 h."""
    m = F.greatest(as_col(minutes).cast("int"), F.lit(0)) % MINUTES_PER_DAY
    return F.concat(F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))


def local_minutes(ts) -> Column:
    """Minutes of day of a UTC instant in the branch time zone."""
    local = F.from_utc_timestamp(as_col(ts), BRANCH_TIME_ZONE)
    return F.hour(local) * 60 + F.minute(local)


def is_open(opening, closing, ts) -> Column:
    """Open at ``ts``: equal bounds = always; same day [o, c); overnight >= o or < c."""
    o, c = as_col(opening).cast("int"), as_col(closing).cast("int")
    now = local_minutes(ts)
    return (
        F.when(o == c, F.lit(True))
        .when(o < c, (now >= o) & (now < c))
        .otherwise((now >= o) | (now < c))
    )
