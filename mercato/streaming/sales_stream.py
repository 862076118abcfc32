"""Streaming sales per merchant and day (T2, roadmap companion of the monthly report), without state.

Sums can be added up, so nothing has to wait for a window to close and no row can
come too late.  Orders arrive as a stream and are joined to their (static) items; each
micro-batch writes its own partial sums, one row per (merchant, day) it touched, into
a folder named by its batch id.  A batch that is retried replaces its folder.
Readers add up the parts.

``compact`` adds up all batches to a given one into one part and publishes it;
readers then take that part and the later batches.  ``vacuum`` removes what no reader
needs any more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.functions.money import money_out
from mercato.operators.reports import COUNTED_STATUSES
from mercato.session import checkpoint_dir
from mercato.sources import files
from mercato.sources.fixtures import VIEWS, fixtures
from mercato.sources.tables import table_stream

KEYS = ["merchant_id", "day"]
SUMS = ["total_sales", "total_tax", "total_discount"]
_DONE = "_SUCCESS"  # Spark's mark of a folder written to the end


def daily_sales(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """T2 transformation: counted orders' item sums per merchant and UTC day (of a batch, or of everything)."""
    counted = orders.filter(F.col("status").isin(*COUNTED_STATUSES)).select(
        F.col("id").alias("order_id"), "merchant_id", F.to_date("created_at").cast("string").alias("day"))
    items = order_items.select("order_id", "line_total", "tax_amount", "discount_amount")
    return counted.join(items, "order_id").groupBy(*KEYS).agg(
        F.sum("line_total").alias("total_sales"), F.sum("tax_amount").alias("total_tax"),
        F.sum("discount_amount").alias("total_discount"), F.count(F.lit(1)).cast("bigint").alias("n_items"))


def add_up(parts: DataFrame) -> DataFrame:
    """Partial sums of several parts -> one row per (merchant, day).  In any order, any grouping, the same."""
    kinds = {f.name: f.dataType for f in parts.schema.fields}
    return parts.groupBy(*KEYS).agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in [*SUMS, "n_items"]])


def write_batch(part: DataFrame, base: str, batch_id: int) -> None:
    """One folder per micro-batch, replaced when the batch is retried."""
    part.write.mode("overwrite").parquet(f"{base}/log/b={batch_id}")


def _written(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers of the sub-folders ``prefix`` + number that were written to the end."""
    numbers = [int(n.removeprefix(prefix)) for n in files.names(spark, folder) if n.startswith(prefix)]
    return sorted(n for n in numbers if files.exists(spark, f"{folder}/{prefix}{n}/{_DONE}"))


def parts(spark: SparkSession, base: str, upto: int | None = None) -> list[str]:
    """Folders that together hold every batch (to ``upto``) once: the newest compacted part and the batches after it."""
    whole = [n for n in _written(spark, f"{base}/compacted", "upto=") if upto is None or n <= upto]
    after = whole[-1] if whole else -1
    later = [n for n in _written(spark, f"{base}/log", "b=") if n > after and (upto is None or n <= upto)]
    return [f"{base}/compacted/upto={after}"] * bool(whole) + [f"{base}/log/b={n}" for n in later]


def read_sales(spark: SparkSession, base: str) -> DataFrame:
    """Merchant x day totals of all batches written so far."""
    return add_up(spark.read.parquet(*parts(spark, base)))


def compact(spark: SparkSession, base: str, upto: int) -> None:
    """Publish one part for all batches to ``upto``.  The last batch of a running query may still be retried: leave it out."""
    add_up(spark.read.parquet(*parts(spark, base, upto))).write.mode("overwrite").parquet(f"{base}/compacted/upto={upto}")


def vacuum(spark: SparkSession, base: str) -> None:
    """Remove parts that the newest compacted one holds; call it when no reader that started before ``compact`` is left."""
    whole = _written(spark, f"{base}/compacted", "upto=")
    for n in whole[:-1]:
        files.remove(spark, f"{base}/compacted/upto={n}")
    for n in _written(spark, f"{base}/log", "b="):
        if whole and n <= whole[-1]:
            files.remove(spark, f"{base}/log/b={n}")


def run_sales_stream(spark: SparkSession, sf_dir: str, source: DataFrame | None = None, base: str | None = None) -> DataFrame:
    """Run T2 with orders as the stream source until drained; return merchant x day totals.

    ``source`` overrides the orders stream (raw ``orders`` schema), e.g. with a
    ``maxFilesPerTrigger`` file source to force several micro-batches; ``base`` names
    the folder of parts and checkpoint, a later run with it goes on where the last ended.
    """
    base = base or f"{checkpoint_dir(spark).rstrip('/')}/sales-stream-{uuid.uuid4().hex}"
    items = fixtures(spark, sf_dir).v_order_items
    raw = source if source is not None else table_stream(spark, sf_dir, "orders")

    def sink(batch: DataFrame, batch_id: int) -> None:
        orders = batch.sparkSession.sql(VIEWS["v_orders"], orders=batch.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")))
        write_batch(daily_sales(orders, items), base, batch_id)

    (raw.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/chk").trigger(availableNow=True).start().awaitTermination())
    return read_sales(spark, base).select(*KEYS, *[money_out(c).alias(c) for c in SUMS], "n_items")
