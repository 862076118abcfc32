"""Reports (R1-R4, R7, R8).

All aggregates are declared with ``groupBy().agg()`` so Spark plans a partial
(map-side) aggregate before the shuffle: the shuffle carries one row per group
per task, not the line items.  Money columns are summed as ``decimal(12,2)``
(exact) and reported as doubles rounded to cents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.cols import first_reason
from mercato.functions.money import money_out
from mercato.operators.common import top_k_per_group

# Order statuses counted as sales.
COUNTED_STATUSES = ("accepted", "out_for_delivery", "delivered")
# Valid report period.
MIN_MONTH, MAX_MONTH, MIN_YEAR, MAX_YEAR = 1, 12, 2000, 9999

REPORT_COLUMNS = ("total_sales", "total_tax", "total_discount", "profit_estimate")


def _counted_orders(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("status").isin(*COUNTED_STATUSES)).select(
        F.col("id").alias("order_id"),
        "merchant_id",
        F.year("created_at").alias("year"),
        F.month("created_at").alias("month"),
    )


def _report_aggs():
    return [
        F.sum("line_total").alias("total_sales"),
        F.sum("tax_amount").alias("total_tax"),
        F.sum("discount_amount").alias("total_discount"),
        F.sum(F.col("base_amount") + F.col("addon_amount") - F.col("discount_amount")).alias("profit_estimate"),
    ]


def monthly_sales_report(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """R1 for every merchant and month at once: sums of counted orders' items, rounded to cents."""
    items = order_items.select("order_id", "line_total", "tax_amount", "discount_amount", "base_amount", "addon_amount")
    joined = items.join(_counted_orders(orders), "order_id")
    agg = joined.groupBy("merchant_id", "year", "month").agg(*_report_aggs())
    return agg.select("merchant_id", "year", "month", *[money_out(c).alias(c) for c in REPORT_COLUMNS])


def monthly_sales_report_for(orders: DataFrame, order_items: DataFrame, merchant_id, month: int, year: int) -> DataFrame:
    """R1 for one merchant and period; a period without sales gives one row of zeros.

    The period is written as a half-open time range so the filter can be pushed
    to the scan (EXTRACT(...) = m would not be).
    """
    start = F.make_timestamp(F.lit(year), F.lit(month), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    end = F.add_months(F.to_date(start), 1).cast("timestamp")
    o = orders.filter(
        (F.col("merchant_id") == F.lit(merchant_id))
        & F.col("status").isin(*COUNTED_STATUSES)
        & (F.col("created_at") >= start) & (F.col("created_at") < end)
    ).select(F.col("id").alias("order_id"))
    agg = order_items.join(o, "order_id").agg(*_report_aggs())
    return agg.select(
        F.lit(merchant_id).alias("merchant_id"), F.lit(year).alias("year"), F.lit(month).alias("month"),
        *[money_out(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in REPORT_COLUMNS],
    )


def period_reason(month, year):
    """R2: NULL for a valid period, else the rejection reason."""
    return first_reason(
        ((month < MIN_MONTH) | (month > MAX_MONTH), "invalid month"),
        ((year < MIN_YEAR) | (year > MAX_YEAR), "invalid year"),
    )


def sales_report_requests(report: DataFrame, requests: DataFrame) -> DataFrame:
    """R1 + R2 for asked (merchant_id, year, month) periods.

    Invalid periods carry a ``reason`` and NULL totals; valid periods with no
    counted sales get zeros (the reference's COALESCE(SUM(...), 0)).
    """
    req = requests.select("merchant_id", "year", "month").withColumn("reason", period_reason(F.col("month"), F.col("year")))
    joined = req.join(report, ["merchant_id", "year", "month"], "left")
    totals = [
        F.when(F.col("reason").isNull(), F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in REPORT_COLUMNS
    ]
    return joined.select("merchant_id", "year", "month", "reason", *totals)


def inventory_by_product(products: DataFrame, inventory: DataFrame) -> DataFrame:
    """Total stock of each product over branches (0 when it has no rows).

    Inventory is aggregated *before* the join (no join fan-out), then products
    are left-joined so untracked products still appear.  Rows come sorted by
    name within a merchant (range-partitioned sort, one row per product).
    """
    stock = inventory.groupBy("product_id").agg(F.sum("quantity").alias("stock"))
    p = products.select("merchant_id", F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    return p.join(stock, "product_id", "left").select(
        "merchant_id", "product_id", "product_name", F.coalesce("stock", F.lit(0)).cast("int").alias("quantity")
    ).orderBy("merchant_id", "product_name", "product_id")  # listing order: by name within a merchant


def actor_counts(merchants: DataFrame, actors: DataFrame) -> DataFrame:
    """Number of actors of every merchant (0 when none)."""
    counts = actors.groupBy("merchant_id").agg(F.count(F.lit(1)).alias("actor_count"))
    m = merchants.select(F.col("id").alias("merchant_id"))
    return m.join(counts, "merchant_id", "left").select(
        "merchant_id", F.coalesce("actor_count", F.lit(0)).cast("bigint").alias("actor_count")
    )


def _product_sales(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    items = order_items.select("order_id", "product_id", "quantity", "line_total")
    o = _counted_orders(orders).select("order_id", "merchant_id")
    return (
        items.join(o, "order_id")
        .groupBy("merchant_id", "product_id")
        .agg(F.sum("quantity").cast("bigint").alias("units_sold"), F.sum("line_total").alias("revenue"))
    )


def top_selling_products(orders: DataFrame, order_items: DataFrame, k: int = 5) -> DataFrame:
    """The k best-selling products of each merchant by units (ties: revenue desc, product id).

    ``row_number() <= k`` lets Catalyst insert a partial WindowGroupLimit before
    the shuffle, so even a merchant holding most of the products only ships k
    rows per task to the final window.
    """
    sales = _product_sales(orders, order_items)
    ranked = top_k_per_group(sales, ["merchant_id"], [F.desc("units_sold"), F.desc("revenue"), F.asc("product_id")], k)
    return ranked.select("merchant_id", "rank", "product_id", "units_sold", money_out("revenue").alias("revenue"))


def sales_per_merchant(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """All-time counted sales per merchant."""
    items = order_items.select("order_id", "line_total", "tax_amount", "discount_amount", "base_amount", "addon_amount")
    agg = (
        items.join(_counted_orders(orders), "order_id")
        .groupBy("merchant_id")
        .agg(*_report_aggs(), F.countDistinct("order_id").alias("order_count"))
    )
    return agg.select("merchant_id", F.col("order_count").cast("bigint").alias("order_count"),
                      *[money_out(c).alias(c) for c in REPORT_COLUMNS])
