"""Data-quality rules (Q1-Q4): the database's constraints as batch checks.

Each check returns violating rows with the constraint name, so a batch can be
split into accepted and rejected rows before it is written.  Uniqueness is a
``groupBy(keys).count()`` (partial aggregation keeps the shuffle small even if
one key is hot); foreign keys are ``left_anti`` joins; CHECK and enum rules are
one array-of-reasons column evaluated row by row inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions.cols import all_reasons

# Enum domains of the data model.
ENUMS = {
    "merchant_category": ("restaurant", "pharma", "bakery"),
    "payment_type": ("card", "cash"),
    "discount_type": ("flat", "percentage"),
    "order_status_type": ("pending", "accepted", "out_for_delivery", "delivered", "refunded", "cancelled"),
    "role_type": ("admin", "merchant", "employee", "customer"),
    "city_type": ("Karachi", "Lahore"),
}

# Request validator patterns.
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def key_text(cols: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def check_unique(df: DataFrame, keys: Sequence[str], constraint: str) -> DataFrame:
    """Q1: key values held by more than one row (NULL keys never clash, as in PostgreSQL)."""
    not_null = F.lit(True)
    for k in keys:
        not_null = not_null & F.col(k).isNotNull()
    dup = df.filter(not_null).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)
    return dup.select(F.lit(constraint).alias("constraint"), key_text(keys).alias("key"),
                      F.col("n_rows").cast("bigint").alias("n_rows"))


def check_unique_against(batch: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q1 (batch vs target): batch rows whose key already exists in the target."""
    return batch.join(target.select(*keys), list(keys), "left_semi")  # a semi join needs no distinct


def check_fk(child: DataFrame, parent: DataFrame, child_cols: Sequence[str], parent_cols: Sequence[str],
             constraint: str) -> DataFrame:
    """Q2: child rows whose (non-NULL) reference has no parent row."""
    not_null = F.lit(True)
    for c in child_cols:
        not_null = not_null & F.col(c).isNotNull()
    p = parent.select(*[F.col(pc).alias(cc) for cc, pc in zip(child_cols, parent_cols)])  # anti join: no distinct
    orphans = child.filter(not_null).join(p, list(child_cols), "left_anti")
    return orphans.select(F.lit(constraint).alias("constraint"), key_text(child_cols).alias("key"))


def check_rules(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Q3: add ``violations`` = names of every rule whose condition is false (NULL counts as passing, like CHECK)."""
    return df.withColumn("violations", all_reasons(*[(~F.coalesce(ok, F.lit(True)), name) for name, ok in rules]))


def in_enum(col: str, enum: str) -> Column:
    return F.col(col).isin(*ENUMS[enum])


def is_email(col: str) -> Column:
    return F.col(col).rlike(EMAIL_PATTERN)


def is_uuid(col: str) -> Column:
    return F.col(col).rlike(UUID_PATTERN)


def required(col: str) -> Column:
    return F.coalesce(F.trim(F.col(col).cast("string")), F.lit("")) != ""


def split_accepted_rejected(checked: DataFrame, reasons_col: str = "violations") -> tuple[DataFrame, DataFrame]:
    """Every input row lands in exactly one of (accepted, rejected)."""
    bad = F.size(F.col(reasons_col)) > 0
    return checked.filter(~bad).drop(reasons_col), checked.filter(bad)
