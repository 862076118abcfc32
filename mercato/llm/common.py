"""Helpers shared by the operators: typed inputs, bounded Arrow slices, written intermediates."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.session import checkpoint_dir, materialize, prepare, released, settle

#: Words are maximal runs of anything but these six ASCII white-space characters.
SPACE = " \t\n\x0b\x0c\r"
WORD_SPLIT = r"[\x20\x09-\x0D]+"
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

__all__ = ["SPACE", "WORD_SPLIT", "checkpoint_dir", "materialize", "prepare", "ready", "released", "settle", "slices", "table", "words"]


def ready(spark: SparkSession) -> SparkSession:
    """Pin the session settings and let Python workers of a local run find this package."""
    prepare(spark)
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, env.get("PYTHONPATH", "")]))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table, whole; the path may be any Hadoop URI."""
    return ready(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(text):
    """Column: the words of a text, in order; null text gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), "")


def slices(batches: Iterable[pa.RecordBatch], column: str, max_chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds about ``max_chars`` of ``column``, one row at least.

    Bounds the memory a Python worker needs, whatever the batch size of the
    session; every row comes out once, whole.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if i > start and held + size > max_chars:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        yield batch.slice(start)


import pyarrow.compute  # noqa: E402,F401  (pa.compute)
