"""Session settings the engine relies on.

The engine never builds its own cluster session in library code; callers pass a
``SparkSession``.  ``prepare`` only pins the settings every operator assumes
(UTC session zone, AQE on).  ``local_session`` is for tests and the bench.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

from mercato.sources import files

Result = TypeVar("Result")

# Settings every operator assumes.  UTC is required: month/year extraction,
# timestamp literals and timestamp_ntz -> timestamp casts all use the session zone.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


# Suggested settings for a large cluster (~100 TB inputs); applied by the deployment, never by library code.
# Shuffle partitions start high and AQE coalesces them to ~256 MB; skewed partitions (a hot tenant, cart or
# branch) are split by AQE's skew-join handling; scans read ~256 MB splits.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(64 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session settings the operators depend on (idempotent)."""
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def _context(spark: SparkSession):
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - sessions without a driver-side context (e.g. Spark Connect)
        return None


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster in ``spark.checkpoint.dir``.

    Only when the setting is absent (tests, a laptop) is a scratch folder made.
    """
    sc = _context(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc else None)
    if configured:
        if sc is not None and not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    scratch = tempfile.mkdtemp(prefix="mercato-ckpt-", dir=os.environ.get("MERCATO_SCRATCH", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", scratch)
    if sc is not None:
        sc.setCheckpointDir(scratch)
    return scratch


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "mercato") -> SparkSession:
    """A local session for tests and the bench (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("MERCATO_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
    )
    for key, value in REQUIRED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


#: Removes a query's shuffle files when the query ends; read by Spark when it plans the write.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[list[str]] = []  # paths per open ``settle``, innermost last


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage of an intermediate used by several outputs: write it as a parquet table, read it back.

    The table goes under the shared ``spark.checkpoint.dir`` (never a local
    checkpoint), so a lost executor does not force recomputing the whole DAG,
    and consumers get a columnar scan with pruning instead of a row checkpoint.
    The shuffle files behind the table go once it is written: nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "materialized")
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_UP)
        else:
            spark.conf.set(_CLEAN_UP, before)
    if _written:
        _written[-1].append(path)
    return spark.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df``, joined by shuffles only: for tables that grow with the input, however small their files look.

    Sizes are estimated from compressed files; the rows that the driver would hold and send out are far larger.
    """
    return df.hint("merge")


def released(build: Callable[[], Result]) -> Result:
    """``build()``, after which the tables that it materialized on its way are removed.

    For a step whose result is held by the driver and reads none of them.
    """
    _written.append([])
    try:
        out = build()
    finally:
        steps = _written.pop()
    for path in steps:
        files.remove(SparkSession.active(), path)
    return out


def settle(build: Callable[[], DataFrame]) -> DataFrame:
    """``materialize(build())``, after which the tables that ``build`` materialized on its way are removed.

    For a step whose intermediates nothing but its own result reads.
    """
    _written.append([])
    try:
        out = materialize(build())
    except BaseException:
        _written.pop()
        raise
    *steps, last = _written.pop()
    for path in steps:
        files.remove(out.sparkSession, path)
    if _written:
        _written[-1].append(last)
    return out
