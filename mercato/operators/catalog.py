"""Catalog reads and batch checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.cols import first_reason, unmet


def list_scoped(df: DataFrame, scope_cols, order_cols=("created_at", "id"), desc_first: bool = True) -> DataFrame:
    """Rows sorted per scope, newest first with the id as tie-break.

    A global sort (range-partitioned) instead of a window per scope, so a scope
    holding most rows is still spread over many tasks.
    """
    scope = [F.col(c) for c in ([scope_cols] if isinstance(scope_cols, str) else scope_cols)]
    first, *rest = order_cols
    ordering = [F.col(first).desc() if desc_first else F.col(first).asc()] + [F.col(c).asc() for c in rest]
    return df.orderBy(*scope, *ordering)


def lookup_by_keys(table: DataFrame, keys: DataFrame, key_map: dict[str, str], found_col: str = "found") -> DataFrame:
    """Bulk keyed lookup; every key row is kept, unmatched ones get ``found = false``.

    ``key_map`` maps key-frame columns to table columns.
    """
    renamed = table.select(*[F.col(t).alias(k) for k, t in key_map.items()],
                           *[F.col(c) for c in table.columns if c not in key_map.values()],
                           F.lit(True).alias(found_col))
    j = keys.join(renamed, list(key_map), "left")
    return j.withColumn(found_col, F.coalesce(F.col(found_col), F.lit(False)))


def product_detail(products: DataFrame, categories: DataFrame) -> DataFrame:
    """Products with their category name ('' when none), tenant-matched."""
    c = categories.select(F.col("merchant_id"), F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return products.join(c, ["merchant_id", "category_id"], "left").select(
        "id", "merchant_id", "category_id", "name", F.col("base_price").cast("double").alias("base_price"),
        "track_inventory", "is_active", F.coalesce("category_name", F.lit("")).alias("category_name"),
    )


def product_addons(products: DataFrame, addons: DataFrame) -> DataFrame:
    """K2: addons of existing products, with the product's tenant."""
    p = products.select(F.col("id").alias("product_id"), "merchant_id")
    return addons.join(p, "product_id").select(
        "id", "product_id", "merchant_id", "name", F.col("price").cast("double").alias("price")
    )


def validate_inventory_batch(batch: DataFrame, products: DataFrame, branches: DataFrame) -> DataFrame:
    """K3: (merchant_id, product_id, branch_id, quantity) rows get a ``reason`` or NULL.

    Product must exist in the tenant and track inventory; the branch must exist
    in the tenant; quantity must be given and >= 0.
    """
    p = products.select(F.col("id").alias("product_id"), F.col("merchant_id").alias("_pm"), "track_inventory")
    b = branches.select(F.col("id").alias("branch_id"), F.col("merchant_id").alias("_bm"), F.lit(True).alias("_branch"))
    j = batch.join(p, "product_id", "left").join(b, "branch_id", "left")
    reason = first_reason(
        (F.col("_pm").isNull() | (F.col("_pm") != F.col("merchant_id")), "product_not_found"),
        (~F.col("track_inventory"), "product_not_tracked"),
        (F.col("_branch").isNull() | (F.col("_bm") != F.col("merchant_id")), "branch_not_found"),
        (unmet(F.col("quantity") >= 0), "negative_quantity"),
    )
    return j.withColumn("reason", reason).drop("_pm", "_bm", "_branch", "track_inventory")


def validate_product_batch(batch: DataFrame, categories: DataFrame) -> DataFrame:
    """K4: category (when given) must exist in the tenant; base price > 0; name required."""
    c = categories.select(F.col("id").alias("category_id"), F.col("merchant_id").alias("_cm"), F.lit(True).alias("_cat"))
    j = batch.join(c, "category_id", "left")
    reason = first_reason(
        (F.coalesce(F.trim(F.col("name")), F.lit("")) == "", "name_required"),
        (F.col("category_id").isNotNull() & (F.col("_cat").isNull() | (F.col("_cm") != F.col("merchant_id"))), "category_not_found"),
        (unmet(F.col("base_price") > 0), "price_not_positive"),
    )
    return j.withColumn("reason", reason).drop("_cm", "_cat")


def validate_addon_batch(batch: DataFrame, products: DataFrame) -> DataFrame:
    """K4 (addons): product must exist in the tenant; price > 0; name required."""
    p = products.select(F.col("id").alias("product_id"), F.col("merchant_id").alias("_pm"))
    j = batch.join(p, "product_id", "left")
    reason = first_reason(
        (F.coalesce(F.trim(F.col("name")), F.lit("")) == "", "name_required"),
        (F.col("_pm").isNull() | (F.col("_pm") != F.col("merchant_id")), "product_not_found"),
        (unmet(F.col("price") > 0), "price_not_positive"),
    )
    return j.withColumn("reason", reason).drop("_pm")
