"""Generic set operators shared by the domain modules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group under ``order`` (include a unique tie-break column).

    ``row_number() = 1`` lets Catalyst insert a partial WindowGroupLimit before
    the shuffle, so a hot group ships one row per task, not all of its rows.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """First ``k`` rows per group, numbered 1..k in ``rank_col`` (partial group limit applies as above)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
