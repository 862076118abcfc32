"""Snapshot sink: batch changes write a new version directory, then move a pointer.

The reference wraps each change in a database transaction.  Here a job writes
all of its outputs (e.g. bills, order lines, addon rows and the new stock
table) under ``<base>/v<version>/<name>``; only when every write has finished
is the small ``_CURRENT`` pointer replaced, so readers see either the old or
the new snapshot, never half of one.  Re-running a failed job rewrites its
version directory from scratch (``overwrite``), which makes the job idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mercato.sources import files

POINTER = "_CURRENT"


def current_version(spark: SparkSession, base: str) -> int | None:
    text = files.read_text(spark, f"{base}/{POINTER}")
    return int(text) if text else None


def write_snapshot(frames: dict[str, DataFrame], base: str, version: int | None = None) -> int:
    """Write every frame of one job as the next version, then publish it."""
    spark = next(iter(frames.values())).sparkSession
    v = (current_version(spark, base) or 0) + 1 if version is None else version
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{base}/v{v}/{name}")
    files.replace_text(spark, f"{base}/{POINTER}", str(v))
    return v


def read_snapshot(spark: SparkSession, base: str, name: str, version: int | None = None) -> DataFrame:
    v = current_version(spark, base) if version is None else version
    if v is None:
        raise FileNotFoundError(f"no published snapshot under {base}")
    return spark.read.parquet(f"{base}/v{v}/{name}")
