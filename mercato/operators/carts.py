"""Cart operators.

Every per-request step of the reference (add item, update quantity, cart
detail, preview) becomes a set operation over all cart lines: lookups are
joins, the addon loop is an ``explode`` + join + aggregate by line id, and the
first error of a line is a ``when`` chain.  Line order inside a cart is
(product_id, id), as in the reference's item listing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions.arrays import ids_text, normalize_addon_ids
from mercato.functions.cols import first_by, first_reason, reason_code, reason_name
from mercato.functions.money import round2
from mercato.operators import discounts as disc
from mercato.operators.changes import latest_per_key
from mercato.session import materialize, spread

ADDON_REASONS = ("addon_not_found", "addon_wrong_product")
DETAIL_REASONS = ("product_not_found", "addon_not_found")

# Preview VAT rates by payment method (percent).
PREVIEW_VAT = {"card": 8, "cash": 15}


def vat_rate(method) -> "F.Column":
    """Trimmed, lower-cased method -> VAT percent; NULL when unknown (B1 / preview)."""
    m = F.lower(F.trim(method))
    expr = None
    for k, v in PREVIEW_VAT.items():
        expr = F.when(m == k, F.lit(float(v))) if expr is None else expr.when(m == k, F.lit(float(v)))
    return expr


def cart_lines(items: DataFrame, item_addons: DataFrame) -> DataFrame:
    """Cart items with their ``addon_ids`` array built from the long form and normalised."""
    arr = item_addons.groupBy("cart_item_id").agg(F.collect_list("addon_id").alias("_raw"))
    return (
        items.join(arr.withColumnRenamed("cart_item_id", "id"), "id", "left")
        .withColumn("addon_ids", normalize_addon_ids("_raw"))
        .drop("_raw")
    )


def addon_stats(lines: DataFrame, addons: DataFrame, line_id: str = "id") -> DataFrame:
    """Per line, the unit price of its addons and the first addon error (in id order).

    ``addon_not_found`` when the addon id does not exist, ``addon_wrong_product``
    when it belongs to another product.  Lines without addons get no row.
    """
    ex = lines.select(F.col(line_id).alias("_line"), "product_id",
                      F.posexplode("addon_ids").alias("pos", "addon_id"))
    a = addons.select(F.col("id").alias("addon_id"), F.col("product_id").alias("_ap"), F.col("price").alias("_price"))
    j = ex.join(a, "addon_id", "left")
    err = first_reason(
        (F.col("_ap").isNull(), "addon_not_found"),
        (F.col("_ap") != F.col("product_id"), "addon_wrong_product"),
    )
    return j.groupBy("_line").agg(
        F.sum(F.col("_price").cast("double")).alias("addon_unit_price"),
        reason_name(first_by(reason_code(err, ADDON_REASONS), F.col("pos")), ADDON_REASONS).alias("addon_reason"),
        F.count(F.lit(1)).alias("addon_count"),
        F.sum(F.col("_ap").isNull().cast("int")).alias("addon_missing"),
    ).withColumnRenamed("_line", line_id)


def check_addon_ownership(lines: DataFrame, addons: DataFrame) -> DataFrame:
    """C3 as a filter result: every line with ``addon_reason`` (NULL = all addons fine)."""
    stats = addon_stats(lines, addons)
    return lines.join(stats, "id", "left").select(
        "id", "cart_id", "product_id", ids_text("addon_ids").alias("addon_key"),
        F.coalesce("addon_count", F.lit(0)).cast("bigint").alias("addon_count"), "addon_reason",
    )


def lookup_by_signature(cart_items: DataFrame, requests: DataFrame) -> DataFrame:
    """Find the stored line with the same (cart_id, product_id, addon set) as each request.

    Both sides are normalised (C1) and the addon set is compared as its id text,
    so the equi join never depends on the order or duplicates of the given ids.
    Adds ``item_id`` (NULL when no line matches) to every request row.
    """
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_sig", ids_text(normalize_addon_ids("addon_ids")))

    stored = keyed(cart_items).select("cart_id", "product_id", "_sig", F.col("id").alias("item_id"))
    return keyed(requests).join(stored, ["cart_id", "product_id", "_sig"], "left").drop("_sig")


def merge_cart_adds(adds: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Add requests with the same (cart, product, addon set) signature add up.

    Requests with a quantity <= 0 or null are rejected.  ``existing`` (optional) is the
    current cart_items table; matching signatures add the stored quantity.
    """
    a = adds.withColumn("addon_ids", normalize_addon_ids("addon_ids"))
    positive = F.coalesce(F.col("quantity") > 0, F.lit(False))  # a null quantity is rejected as well
    ok = a.filter(positive)
    rejected = a.filter(~positive).select("cart_id", "product_id", ids_text("addon_ids").alias("addon_key"),
                                                          F.col("quantity").cast("bigint").alias("quantity"),
                                                          F.lit(1).cast("bigint").alias("n_requests"),
                                                          F.lit("quantity_not_positive").alias("reason"))
    sig = ["cart_id", "product_id", "addon_key"]
    grouped = ok.withColumn("addon_key", ids_text("addon_ids")).groupBy(*sig).agg(
        F.sum("quantity").cast("bigint").alias("added"), F.count(F.lit(1)).cast("bigint").alias("n_requests"))
    if existing is not None:
        ex = existing.withColumn("addon_key", ids_text(normalize_addon_ids("addon_ids"))).groupBy(*sig).agg(
            F.sum("quantity").cast("bigint").alias("stored"))
        grouped = grouped.join(ex, sig, "left").withColumn("added", F.col("added") + F.coalesce("stored", F.lit(0))).drop("stored")
    merged = grouped.select(*sig, F.col("added").alias("quantity"), "n_requests", F.lit(None).cast("string").alias("reason"))
    return merged.unionByName(rejected)


def addons_by_product(addons: DataFrame, *fields) -> DataFrame:
    """Per product a map ``_own`` from addon id to the rows (array of ``fields``) of that addon.

    Ids that stand under several products, or under none, are left out.
    """
    ids = addons.groupBy("id").agg(
        F.min("product_id").alias("product_id"), F.max("product_id").alias("_last"), F.count("product_id").alias("_owned"),
        F.count(F.lit(1)).alias("_n"), F.collect_list(F.struct(*fields)).alias("_rows"))
    own = ids.where(F.col("id").isNotNull() & (F.col("product_id") == F.col("_last")) & (F.col("_owned") == F.col("_n")))
    return own.groupBy("product_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "_rows"))).alias("_own"))


def _own_rows():
    """Per addon id of a line the rows of that addon in ``_own``, NULL where it is none of the product's."""
    return F.transform("addon_ids", lambda x: F.try_element_at("_own", x))


def _is_strange(found):
    return F.coalesce(F.exists(found, lambda rows: rows.isNull()), F.lit(False))


def _strange_lines(j: DataFrame) -> DataFrame | None:
    """Ids of the lines of ``j`` that name an addon which is not their product's own, or whose id stands more than once (``_twice``).

    They are looked up one addon at a time.  None if there are none, the usual case.
    """
    ids = j.groupBy("id").agg((F.count(F.lit(1)) > 1).alias("_twice"), F.max("_strange").alias("_strange"))
    ids = materialize(ids.where("id IS NOT NULL AND (_strange OR _twice)").select("id", "_twice"))
    return None if ids.isEmpty() else ids


def _priced(lines: DataFrame, carts: DataFrame, products: DataFrame, addons: DataFrame,
            in_force: disc.InForce | None = None, keep=()) -> tuple[DataFrame, bool]:
    """The lines with all they are priced from, and whether an id stands twice.

    ``in_force``: their product's discount at ``_as_of`` as well; ``keep``: columns
    worked out of the lines' own, which need not be carried to the product.
    """
    c = carts.select(F.col("id").alias("cart_id"), F.col("merchant_id"))
    p = products.select(F.col("id").alias("product_id"), F.col("merchant_id").alias("_pm"),
                        "category_id", F.col("base_price").cast("double").alias("base_price"))
    own = addons_by_product(addons, F.col("price").cast("double").alias("price"))
    # the cart and the product, with the addons it has, are met once each; addons of other products are rare
    j = (lines.join(c, "cart_id", "left")
         .join(spread(p), "product_id", "left")
         .join(spread(own), "product_id", "left").withColumn("_found", _own_rows()))
    if in_force:
        j = in_force.take_by_product(j.join(spread(in_force.by_product()), "product_id", "left"), F.col("_as_of"))
    prices = F.filter(F.transform(F.flatten("_found"), lambda r: r["price"]), lambda x: x.isNotNull())
    j = j.withColumn("_prices", prices).select(
        *[x for x in j.columns if x not in ("addon_ids", "_own", "_found", "_prices")], *keep, _is_strange(F.col("_found")).alias("_strange"),
        F.when(F.col("id").isNotNull() & (F.size("_prices") > 0), F.aggregate("_prices", F.lit(0.0), lambda s, x: s + x)).alias("addon_unit_price"))
    j = materialize(j)
    strange = _strange_lines(j)
    twice = strange is not None and not strange.where("_twice").isEmpty()
    if strange is None:
        j = j.withColumn("addon_reason", F.lit(None).cast("string"))
    else:
        strange = strange.select("id")
        stats = addon_stats(lines.join(strange, "id", "left_semi"), addons).select("id", F.col("addon_unit_price").alias("_looked_up"), "addon_reason")
        j = (j.join(strange.withColumn("_one_by_one", F.lit(True)), "id", "left").join(stats, "id", "left")
             .withColumn("addon_unit_price", F.when(F.col("_one_by_one"), F.col("_looked_up")).otherwise(F.col("addon_unit_price")))
             .drop("_one_by_one", "_looked_up"))
    return j.drop("_strange").withColumn("_product_ok", F.col("_pm").isNotNull() & (F.col("_pm") == F.col("merchant_id"))), twice


def price_cart_items(lines: DataFrame, carts: DataFrame, products: DataFrame, addons: DataFrame,
                     discounts: DataFrame, as_of, explicit_col: str | None = None,
                     resolve_missing: bool = True) -> DataFrame:
    """C4 (and D5 when ``explicit_col`` names an explicit discount id column).

    With ``resolve_missing=False`` (C5) a line without a chosen discount is not
    resolved: it gets the sentinel and amount 0.

    subtotal = round2(q * base + addon_unit * q); the discount is the explicit
    one (checked by D5) or the resolved best one (D3), else the merchant's
    NO_DISCOUNT sentinel with amount 0.  First failing check wins.
    """
    return judged_items(lines, carts, products, addons, discounts, as_of, explicit_col, resolve_missing)[0].select(
        "cart_id", "item_id", "product_id", "quantity", "subtotal", "discount_id", "discount_amount", "reason")


def judged_items(lines: DataFrame, carts: DataFrame, products: DataFrame, addons: DataFrame, discounts: DataFrame, as_of,
                 explicit_col: str | None = None, resolve_missing: bool = True, keep: dict[str, Column] | None = None) -> tuple[DataFrame, bool]:
    """``price_cart_items`` with what the price was made of, and whether an item_id stands twice.

    Further columns: base_price, addon_unit_price, discount_type and discount_value of
    discount_id as the discounts have them, ``as_of`` (these with instants of the lines'
    own), and ``keep``, a column worked out of ``addon_ids``.
    """
    asked = ["id", "cart_id", "product_id", "quantity", "addon_ids"]
    in_force = None
    if explicit_col:
        asked.append(F.col(explicit_col).alias("_named"))
    if isinstance(as_of, Column):
        asked.append(as_of.alias("_as_of"))
        as_of = F.col("_as_of")
        in_force = disc.InForce(discounts) if resolve_missing else None
    keep = keep or {}
    j, twice = _priced(lines.select(*asked), carts, products, addons, in_force, [c.alias(x) for x, c in keep.items()])
    q = F.col("quantity").cast("double")
    subtotal = round2(q * F.col("base_price") + F.coalesce("addon_unit_price", F.lit(0.0)) * q)
    j = j.withColumn("subtotal", subtotal)
    if in_force:
        j = disc.resolve_best_discount_at(j, discounts, as_of, prepared=in_force)
    elif resolve_missing:
        j = disc.resolve_best_discount(j, discounts, as_of)
    else:
        j = (j.withColumn("best_discount_id", F.lit(None).cast("bigint"))
             .withColumn("best_discount_type", F.lit(None).cast("string"))
             .withColumn("best_discount_value", F.lit(None).cast("decimal(12,2)")))

    if not in_force:
        j = j.withColumn("best_own_type", F.col("best_discount_type")).withColumn("best_own_value", F.col("best_discount_value"))
    own_type, own_value = F.col("best_own_type"), F.col("best_own_value")

    if explicit_col:
        d = discounts.select(F.col("id").alias("_did"), F.col("merchant_id").alias("_dm"),
                             F.col("product_id").alias("_dp"), F.col("category_id").alias("_dc"),
                             F.col("type").alias("_dt"), F.col("value").alias("_dv"),
                             F.col("valid_from").alias("_vf"), F.col("valid_to").alias("_vt"))
        j = j.join(spread(d), (F.col("_named") == F.col("_did")) & (F.col("merchant_id") == F.col("_dm")), "left")
        use_explicit = F.col("_named").isNotNull()
        d_type = F.when(use_explicit, F.col("_dt")).otherwise(F.col("best_discount_type"))
        d_value = F.when(use_explicit, F.col("_dv")).otherwise(F.col("best_discount_value"))
        own_type, own_value = F.when(use_explicit, F.col("_dt")).otherwise(own_type), F.when(use_explicit, F.col("_dv")).otherwise(own_value)
        d_id = F.when(use_explicit, F.col("_named")).otherwise(F.col("best_discount_id"))
        matches = disc.scope_matches("_dp", "_dc", "product_id", "category_id")
        amount = F.when(d_id.isNull(), F.lit(0.0)).otherwise(disc.discount_amount(d_type, d_value, "subtotal"))
        explicit_reason = F.when(use_explicit, disc.explicit_discount_reason(
            F.col("_did").isNotNull(), "_vf", "_vt", as_of, matches, amount, F.col("subtotal")))
    else:
        d_id = F.col("best_discount_id")
        amount = F.when(d_id.isNull(), F.lit(0.0)).otherwise(
            disc.discount_amount("best_discount_type", "best_discount_value", "subtotal"))
        explicit_reason = F.lit(None).cast("string")

    reason = first_reason(
        (~F.coalesce(F.col("quantity") > 0, F.lit(False)), "quantity_not_positive"),
        (F.col("merchant_id").isNull(), "cart_not_found"),
        (~F.col("_product_ok"), "product_not_found"),
        (F.col("addon_reason").isNotNull(), "addon_error"),
    )
    reason = F.when(reason == "addon_error", F.col("addon_reason")).otherwise(reason)
    reason = F.coalesce(reason, explicit_reason,
                        F.when((amount < 0) | (amount > F.col("subtotal")), F.lit("exceeds_subtotal")))
    out = j.select(
        "cart_id", F.col("id").alias("item_id"), "product_id", "quantity",
        F.col("subtotal"),
        F.coalesce(d_id, disc.sentinel_id("merchant_id")).alias("discount_id"),
        amount.alias("discount_amount"),
        reason.alias("reason"),
        "base_price", "addon_unit_price", own_type.alias("discount_type"), own_value.alias("discount_value"),
        *([as_of.alias("as_of")] if in_force else []), *keep,
    )
    ok = F.col("reason").isNull()
    return out.withColumns({x: F.when(ok, F.col(x)) for x in ("subtotal", "discount_id", "discount_amount", "discount_type", "discount_value")}), twice


def reprice_quantity_updates(updates: DataFrame, lines: DataFrame, carts: DataFrame, products: DataFrame,
                             addons: DataFrame, discounts: DataFrame, as_of, seq_col: str | None = None) -> DataFrame:
    """(cart_id, item_id, new_quantity, stored_discount_id) -> re-priced line or reason.

    The stored discount is re-validated at ``as_of`` (D5); a line without one
    gets the NO_DISCOUNT sentinel and amount 0.  Of several updates of one item
    the one with the largest ``seq_col`` holds (without one, the largest new
    quantity), one row each.  The quantity is checked before the item, and an
    item of another cart is not found.
    """
    keys = ["cart_id", "item_id"]
    if seq_col:
        u = latest_per_key(updates.select(*keys, "new_quantity", "stored_discount_id", seq_col), keys, seq_col)
    else:
        u = updates.groupBy(*keys).agg(F.max(F.struct("new_quantity", "stored_discount_id")).alias("_u")).select(*keys, "_u.*")
    u = materialize(u.select(F.col("item_id").alias("id"), "cart_id", F.col("new_quantity").alias("quantity"),
                             F.col("stored_discount_id").alias("explicit_id")))
    base = lines.select("id", "cart_id", "product_id", "addon_ids")
    updated = materialize(u.join(base, ["id", "cart_id"]))  # read for its prices and for its addons
    priced = price_cart_items(updated, carts, products, addons, discounts, as_of,
                              explicit_col="explicit_id", resolve_missing=False)
    positive = F.coalesce(F.col("quantity") > 0, F.lit(False))
    missing = u.join(base.select("id", "cart_id"), ["id", "cart_id"], "left_anti").select(
        "cart_id", F.col("id").alias("item_id"), "quantity",
        F.when(positive, F.lit("item_not_found")).otherwise(F.lit("quantity_not_positive")).alias("reason"))
    return priced.unionByName(missing, allowMissingColumns=True)


def cart_detail(lines: DataFrame, carts: DataFrame, products: DataFrame, addons: DataFrame,
                applied: DataFrame) -> DataFrame:
    """One nested document per cart: items sorted by (product_id, id), each with product, addons, discount.

    ``applied`` gives (item_id, discount_id, discount_type, discount_value).  A
    missing discount is tolerated; a missing product or addon makes the cart an
    error row (``reason``).  A cart without lines has an empty list.
    """
    c = carts.select(F.col("id").alias("cart_id"), "merchant_id")
    p = products.select(F.col("id").alias("product_id"), F.col("merchant_id").alias("_pm"),
                        F.col("name").alias("product_name"), F.col("base_price").cast("double").alias("price"))
    own = addons_by_product(addons, F.col("name").alias("name"), F.col("price").cast("double").alias("price"))
    # the narrow join comes first; a product brings its addons, so that lines are not taken apart and put together for them
    j = (lines.select("id", "cart_id", "product_id", "quantity", "addon_ids", "applied_discount_amount")
         .join(applied.withColumnRenamed("item_id", "id"), "id", "left")
         .join(spread(p), "product_id", "left")
         .join(spread(own), "product_id", "left").withColumn("_found", _own_rows()))
    listed = F.flatten(F.zip_with("addon_ids", "_found", lambda x, rows: F.transform(
        F.array_sort(rows), lambda r: F.struct(x.alias("id"), r["name"].alias("name"), r["price"].alias("price")))))
    j = materialize(j.select(*[x for x in j.columns if x not in ("addon_ids", "_own", "_found")], _is_strange(F.col("_found")).alias("_strange"),
                             F.when(F.col("id").isNotNull(), listed).alias("_addons")))
    strange = _strange_lines(j)
    j = j.drop("_strange").withColumn("_addon_missing", F.exists("_addons", lambda x: x["name"].isNull()))
    if strange is not None:
        j = _listed_one_by_one(j, lines.join(strange, "id", "left_semi"), addons, strange.select("id"))
    # the cart comes last: its lines are grouped where that join has put them
    j = j.join(c, "cart_id", "left")
    item = F.struct(
        F.col("product_id"), F.col("id").alias("item_id"), F.col("quantity"), F.col("product_name"), F.col("price"),
        F.coalesce("_addons", F.array()).alias("addons"),
        F.when(F.col("discount_id").isNotNull(), F.struct("discount_id", "discount_type", "discount_value")).alias("discount"),
        F.col("applied_discount_amount").cast("double").alias("applied_discount_amount"),
    )
    line_err = first_reason(
        (F.col("_pm").isNull() | (F.col("_pm") != F.col("merchant_id")), "product_not_found"),
        (F.coalesce("_addon_missing", F.lit(False)), "addon_not_found"),
    )
    # a missing product fails every line of that product and otherwise only a missing addon can fail, so the
    # first failing line by (product_id, id) has the same reason as the first by product_id alone
    g = j.groupBy("cart_id").agg(
        F.array_sort(F.collect_list(item)).alias("items"),
        reason_name(first_by(reason_code(line_err, DETAIL_REASONS), F.col("product_id")), DETAIL_REASONS).alias("reason"),
    )
    return c.select("cart_id").join(g, "cart_id", "full").withColumn("items", F.coalesce("items", F.array()))


def _listed_one_by_one(j: DataFrame, lines: DataFrame, addons: DataFrame, ids: DataFrame) -> DataFrame:
    """``j`` with ``_addons`` and ``_addon_missing`` of the lines with ``ids`` taken from the addon table, whatever product an addon is of."""
    a = addons.select(F.col("id").alias("addon_id"), F.col("name").alias("name"), F.col("price").cast("double").alias("price"))
    found = (lines.select(F.col("id").alias("_line"), F.posexplode("addon_ids").alias("pos", "addon_id"))
             .where(F.col("addon_id").isNotNull()).join(a, "addon_id", "left")
             .groupBy("_line").agg(
                 F.array_sort(F.collect_list(F.struct("pos", F.col("addon_id").alias("id"), "name", "price"))).alias("_rows"),
                 F.max(F.col("name").isNull()).alias("_missing")))
    rows = F.transform("_rows", lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"), x["price"].alias("price")))
    one = F.col("_one_by_one")
    return (j.join(ids.select(F.col("id"), F.lit(True).alias("_one_by_one")), "id", "left")
            .join(found.withColumnRenamed("_line", "id"), "id", "left")
            .withColumn("_addons", F.when(one, rows).otherwise(F.col("_addons")))
            .withColumn("_addon_missing", F.when(one, F.col("_missing")).otherwise(F.col("_addon_missing")))
            .drop("_one_by_one", "_rows", "_missing"))


def cart_preview(priced_lines: DataFrame, methods: DataFrame) -> DataFrame:
    """Per cart VAT preview and discount summary.

    ``priced_lines``: cart_id, item_id, product_id, quantity, price (double),
    addon_unit_price (double, NULL = none), line_discount (double),
    discount_id/type/value (NULL = no discount), line_reason (NULL = ok).
    ``methods``: cart_id, payment_method.

    Per line: sub = round2(p*q + addons*q - disc), vat = round2(sub*rate/100).
    Per cart: subtotal = round2(sum sub), total_vat = round2(sum vat),
    total = round2(sum sub + sum vat).  The discount summary takes the identity
    of the first line (product_id, item_id) that has a discount and the sum of
    those lines' discounts; it is dropped when the cart's total discount is 0.
    An invalid method or a failing line rejects the cart.  Without a payment
    method the preview is off: no VAT, and subtotal / total_vat / vat_rate are
    not reported (total_price still is).  A cart without lines has no items and
    totals of 0.
    """
    enabled = F.col("payment_method").isNotNull()
    m = methods.select("cart_id", "payment_method", enabled.alias("_preview"),
                       F.when(enabled, vat_rate(F.col("payment_method"))).otherwise(F.lit(0.0)).alias("vat_rate"))
    j = m.join(priced_lines, "cart_id", "left")
    q = F.col("quantity").cast("double")
    sub = round2(F.col("price") * q + F.coalesce("addon_unit_price", F.lit(0.0)) * q - F.col("line_discount"))
    vat = round2(sub * F.col("vat_rate") / 100)
    j = j.withColumn("_sub", sub.cast("decimal(14,2)")).withColumn("_vat", vat.cast("decimal(14,2)"))
    order_key = F.struct("product_id", "item_id")
    g = j.groupBy("cart_id", "payment_method", "_preview", "vat_rate").agg(
        F.coalesce(F.sum("_sub"), F.lit(0)).alias("_s"), F.coalesce(F.sum("_vat"), F.lit(0)).alias("_v"),
        F.sum(F.col("line_discount").cast("decimal(14,2)")).alias("_d_all"),
        F.sum(F.when(F.col("discount_id").isNotNull(), F.col("line_discount").cast("decimal(14,2)"))).alias("_d_sum"),
        F.min(F.when(F.col("discount_id").isNotNull(), F.struct(order_key.alias("k"), F.col("discount_id"), F.col("discount_type"),
                                                                  F.col("discount_value").cast("double").alias("discount_value")))).alias("_first"),
        F.min(F.when(F.col("line_reason").isNotNull(), F.struct(order_key.alias("k"), F.col("line_reason").alias("r")))).getField("r").alias("_line_reason"),
        F.count("item_id").cast("bigint").alias("item_count"),
    )
    reason = first_reason((F.col("vat_rate").isNull(), "invalid_payment_method"),
                          (F.col("_line_reason").isNotNull(), "line_error"))
    reason = F.when(reason == "line_error", F.col("_line_reason")).otherwise(reason)
    show_disc = F.col("_first").isNotNull() & (F.col("_d_all") != 0)
    ok = reason.isNull()
    shown = ok & F.col("_preview")
    return g.select(
        "cart_id", "payment_method", F.when(shown, F.col("vat_rate")).alias("vat_rate"), "item_count",
        F.when(shown, round2(F.col("_s"))).alias("subtotal"),
        F.when(shown, round2(F.col("_v"))).alias("total_vat"),
        F.when(ok, round2(F.col("_s") + F.col("_v"))).alias("total_price"),
        F.when(ok & show_disc, F.col("_first")["discount_id"]).alias("discount_id"),
        F.when(ok & show_disc, F.col("_first")["discount_type"]).alias("discount_type"),
        F.when(ok & show_disc, F.col("_first")["discount_value"]).alias("discount_value"),
        F.when(ok & show_disc, round2(F.col("_d_sum"))).alias("discount_amount"),
        reason.alias("reason"),
    )
