"""Order tables laid out by month, so that a period reads its own folders only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.session import materialize

MONTH = "order_month"  # year * 100 + month of the order


def write(orders: DataFrame, order_items: DataFrame, path: str, tasks_a_month: int = 16) -> None:
    """Orders by the month of ``created_at``, order items by the month of their order; a month is dealt over ``tasks_a_month`` tasks.

    An order without a time, or an item without an order, goes to the folder of no month.
    """
    dated = materialize(orders.withColumn(MONTH, F.year("created_at") * 100 + F.month("created_at")))
    items = order_items.join(dated.select(F.col("id").alias("order_id"), MONTH), "order_id", "left")
    for name, rows, spread in (("orders", dated, "id"), ("order_items", items, "order_id")):
        part = F.pmod(F.xxhash64(spread), F.lit(tasks_a_month).cast("long"))
        rows.withColumn("_part", part).repartition(MONTH, "_part").drop("_part").write.mode("overwrite").partitionBy(MONTH).parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str, name: str, month: int, year: int) -> DataFrame:
    """The rows of one month; no other folder is read."""
    return spark.read.parquet(f"{path}/{name}").where(F.col(MONTH) == year * 100 + month).drop(MONTH)
