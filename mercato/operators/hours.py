"""Branch opening hours (H1-H5) as column operators over the branches table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.clock import BRANCH_TIME_ZONE, format_clock, is_open, parse_clock
from mercato.functions.cols import first_reason

# Cities a branch or area may be in.
CITIES = ("Karachi", "Lahore")


def clock_parse(df: DataFrame, text_col: str) -> DataFrame:
    """H1: add ``minutes`` (NULL when the text is not a valid HH:MM) and ``valid``."""
    m = parse_clock(text_col)
    return df.withColumn("minutes", m.cast("int")).withColumn("valid", m.isNotNull())


def branch_availability(branches: DataFrame, as_of) -> DataFrame:
    """H4: open/closed at ``as_of`` with formatted clocks, local time and zone name."""
    now = F.lit(as_of).cast("timestamp")
    local = F.from_utc_timestamp(now, BRANCH_TIME_ZONE)
    return branches.select(
        "id", "merchant_id", "name",
        is_open("opening_time_minutes", "closing_time_minutes", now).alias("is_open"),
        format_clock("opening_time_minutes").alias("opening_time"),
        format_clock("closing_time_minutes").alias("closing_time"),
        F.date_format(local, "HH:mm").alias("current_time"),
        F.lit(BRANCH_TIME_ZONE).alias("timezone_name"),
    )


def validate_branch_batch(batch: DataFrame) -> DataFrame:
    """H5: required fields, city in the fixed set, valid opening/closing clocks.

    Adds ``opening_time_minutes`` / ``closing_time_minutes`` and ``reason``.
    """
    def blank(c):
        return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""

    o, c = parse_clock("opening_time"), parse_clock("closing_time")
    reason = first_reason(
        (blank("name") | blank("address") | blank("contact_number") | blank("city")
         | blank("opening_time") | blank("closing_time"), "required"),
        (~F.col("city").isin(*CITIES), "invalid_city"),
        (o.isNull(), "invalid opening time"),
        (c.isNull(), "invalid closing time"),
    )
    return batch.withColumn("opening_time_minutes", o.cast("int")).withColumn("closing_time_minutes", c.cast("int")) \
        .withColumn("reason", reason)
