"""Tables laid out in hash buckets of some columns, one partition folder per bucket.

A batch reads and rewrites only the buckets that its rows fall into: the filter on
``bucket`` prunes the scan, and the dynamic partition overwrite leaves the files of all other
buckets as they are.  Buckets are even as long as the bucket columns have many values;
``n_buckets`` is chosen so that one fits a task.  The driver sees bucket numbers only,
``n_buckets`` at most.  Spark swaps the folders of one write one after the other, so a job that dies
in between is run again: the callers' changes give the same table when applied twice.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.session import materialize
from mercato.sources import files

BUCKET = "bucket"
_LAYOUT = "_LAYOUT"


def _bucket(by: Sequence[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(n).cast("long")).cast("int")


def _write(rows: DataFrame, path: str) -> None:
    rows.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def create(rows: DataFrame, path: str, by: Sequence[str], n_buckets: int = 4096) -> None:
    """Lay out ``rows`` at ``path`` by the columns ``by``."""
    _write(rows.withColumn(BUCKET, _bucket(by, n_buckets)), path)
    layout = {"by": list(by), "n_buckets": n_buckets, "schema": rows.schema.jsonValue()}
    files.replace_text(rows.sparkSession, f"{path}/{_LAYOUT}", json.dumps(layout))


def _layout(spark: SparkSession, path: str) -> dict:
    text = files.read_text(spark, f"{path}/{_LAYOUT}")
    if text is None:
        raise FileNotFoundError(f"no bucketed table at {path}")
    return json.loads(text)


def with_bucket(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """``rows`` with the bucket that the table at ``path`` keeps them in."""
    layout = _layout(spark, path)
    return rows.withColumn(BUCKET, _bucket(layout["by"], layout["n_buckets"]))


def touched(rows: DataFrame) -> list[int]:
    """The buckets of ``rows`` (which have the column)."""
    return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())


def read(spark: SparkSession, path: str, buckets: Sequence[int] | None = None) -> DataFrame:
    """The table, or some buckets of it (no other folder is read); ``bucket`` is the last column."""
    schema = T.StructType.fromJson(_layout(spark, path)["schema"])
    table = spark.read.schema(schema.add(BUCKET, T.IntegerType())).parquet(path)
    return table if buckets is None else table.where(F.col(BUCKET).isin(list(buckets)))


def replace(spark: SparkSession, path: str, rows: DataFrame, aside: bool = False) -> None:
    """Replace the buckets that ``rows`` (all rows of those buckets, with ``bucket``) fall into.

    They are written aside first, as the buckets may be what ``rows`` reads; ``aside``: it reads written tables only.
    """
    _write(rows if aside else materialize(rows), path)


def put(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str]) -> None:
    """Rows of the table with the ``keys`` of ``rows`` are replaced by those, other rows of ``rows`` are added."""
    rows = materialize(with_bucket(spark, path, rows))
    old = read(spark, path, touched(rows)).join(rows.select(*keys), list(keys), "left_anti")
    replace(spark, path, old.select(*rows.columns).unionByName(rows))
