"""Registered queries: each operator applied to the fixture views of one test directory.

Every callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole tables of that directory.  The matching DuckDB oracle SQL lives in
``mercato.plans.oracle`` under the same key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.functions.arrays import ids_text
from mercato.functions.cols import ts_text
from mercato.operators import access, admission, carts, catalog, changes, coverage, discounts, hours, live_carts, orders, quality, reports, status_state
from mercato.sources import bucketed, documents, monthly
from mercato.session import materialize, scratch_path, settle
from mercato.sources.fixtures import DISCOUNT_AS_OF, SESSION_AS_OF, fixtures
from mercato.streaming import sales_stream, status_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# --- reports -----------------------------------------------------------------

@register("monthly_sales_report")
def q_monthly_sales_report(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    return reports.monthly_sales_report(fx.v_orders, fx.v_order_items)


@register("sales_report_zero_spine")
def q_sales_report_zero_spine(spark, sf_dir):
    # every (merchant, month) that has a cart is asked for; periods before 2000 are rejected by R2
    fx = fixtures(spark, sf_dir)
    requests = fx.v_carts.select(
        "merchant_id", F.year("created_at").alias("year"), F.month("created_at").alias("month")
    ).distinct()
    report = reports.monthly_sales_report(fx.v_orders, fx.v_order_items)
    return reports.sales_report_requests(report, requests)


@register("monthly_sales_report_periods")
def q_monthly_sales_report_periods(spark, sf_dir):
    # the single-period call shape of the reference (one merchant, month, year), for a month with sales and a
    # month without (zeros); the period is a half-open time range over the whole orders table
    fx = fixtures(spark, sf_dir)
    a = reports.monthly_sales_report_for(fx.v_orders, fx.v_order_items, 3, 6, 2000)
    b = reports.monthly_sales_report_for(fx.v_orders, fx.v_order_items, 3, 6, 2030)
    return a.unionByName(b).select(F.col("merchant_id").cast("bigint").alias("merchant_id"),
                                   F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month"),
                                   *reports.REPORT_COLUMNS)


@register("monthly_sales_report_by_month")
def q_monthly_sales_report_by_month(spark, sf_dir):
    # the same calls on order tables laid out by month: each reads its month's folders only
    fx = fixtures(spark, sf_dir)
    path = scratch_path(spark, "months")
    monthly.write(fx.v_orders, fx.v_order_items, path)
    calls = [reports.monthly_sales_report_for(*(monthly.read(spark, path, t, mo, y) for t in ("orders", "order_items")), m, mo, y)
             for m, mo, y in ((3, 6, 2000), (7, 1, 1999), (3, 6, 2030))]
    return reduce(DataFrame.unionByName, calls).select(
        F.col("merchant_id").cast("bigint").alias("merchant_id"), F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month"),
        *reports.REPORT_COLUMNS)


@register("inventory_by_product")
def q_inventory_by_product(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    return reports.inventory_by_product(fx.v_products, fx.v_product_inventory)


@register("actor_counts")
def q_actor_counts(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    return reports.actor_counts(fx.v_merchants, fx.v_actors)


@register("top_selling_products")
def q_top_selling_products(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    return reports.top_selling_products(fx.v_orders, fx.v_order_items, k=5)


@register("sales_per_merchant")
def q_sales_per_merchant(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    return reports.sales_per_merchant(fx.v_orders, fx.v_order_items)


# --- catalog, listing, lookups -----------------------------------------------


# Fixed value: later instant at which stored discounts are re-validated (C5 query).
REPRICE_AS_OF = "2001-06-01 00:00:00"


@register("list_orders")
def q_list_orders(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    o = fx.v_orders.select("id", "merchant_id", "branch_id", "actor_id", "payment_type", "status",
                           ts_text("created_at").alias("created_at"), F.col("created_at").alias("_ts"))
    return catalog.list_scoped(o, "merchant_id", order_cols=("_ts", "id")).drop("_ts")


@register("lookup_by_keys")
def q_lookup_by_keys(spark, sf_dir):
    # every product a cart asks for, looked up in the cart's tenant
    fx = fixtures(spark, sf_dir)
    keys = (fx.v_cart_items.join(fx.v_carts.select(F.col("id").alias("cart_id"), "merchant_id"), "cart_id")
            .select("merchant_id", "product_id").distinct())
    prods = fx.v_products.select("id", "merchant_id", "name", F.col("base_price").cast("double").alias("base_price"))
    return catalog.lookup_by_keys(prods, keys, {"merchant_id": "merchant_id", "product_id": "id"})


@register("product_detail")
def q_product_detail(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    return catalog.product_detail(fx.v_products, fx.v_product_categories)


@register("product_addons")
def q_product_addons(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    return catalog.product_addons(fx.v_products, fx.v_product_addons)


@register("employees")
def q_employees(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    return access.employees(fx.v_actors, fx.v_actor_roles)


@register("actor_profiles")
def q_actor_profiles(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    flat = access.actor_roles_flat(fx.v_actors, fx.v_actor_roles).select(F.col("actor_id").alias("uid"), "role_type")
    return access.actor_profiles(fx.v_actors).join(flat, "uid", "left")


@register("can_view_matrix")
def q_can_view_matrix(spark, sf_dir):
    # every session asks: may its actor view / manage the session's merchant?
    fx = fixtures(spark, sf_dir)
    flags = access.role_flags(fx.v_actors, fx.v_actor_roles)
    req = fx.v_sessions.select(F.col("id").alias("session_id"), "actor_id", "merchant_id")
    return access.can_view(req, flags)


@register("default_roles")
def q_default_roles(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    return access.ensure_default_roles(fx.v_merchants, fx.v_actor_roles)


@register("bootstrap_candidates")
def q_bootstrap_candidates(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    return access.bootstrap_candidates(fx.v_merchants, fx.v_actors).select("id", "name", "category")


@register("split_full_name")
def q_split_full_name(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    names = fx.v_actors.select("id", F.concat(F.lit("  "), "first_name", F.lit("   "), "last_name", F.lit(" ")).alias("full_name"))
    return access.split_full_name(names)


@register("session_states")
def q_session_states(spark, sf_dir):
    # every event is a refresh attempt; some carry a wrong token, e-mail or session id
    fx = fixtures(spark, sf_dir)
    ev = fx.events
    attempts = ev.select(
        F.col("event_id").alias("attempt_id"),
        F.when(ev.event_id % 13 == 0, ev.event_id + 1000000000).otherwise(ev.event_id).alias("session_id"),
        F.concat(F.lit("user"), F.when(ev.event_id % 11 == 0, ev.user_id + 1).otherwise(ev.user_id).cast("string"),
                 F.lit("@example.com")).alias("email"),
        F.concat(F.lit("t"), F.when(ev.event_id % 7 == 0, ev.event_id + 1).otherwise(ev.event_id).cast("string")).alias("refresh_token"),
    )
    return access.classify_sessions(attempts, fx.v_sessions, fx.v_actors, SESSION_AS_OF)


@register("visible_orders")
def q_visible_orders(spark, sf_dir):
    # each order is requested by its own actor and by the next actor id of the same tenant
    fx = fixtures(spark, sf_dir)
    o = fx.v_orders.filter(F.col("actor_id").isNotNull())
    req = o.select(F.col("actor_id").alias("viewer_id"), F.col("id").alias("order_id")).unionByName(
        o.select((F.col("actor_id") + 10).alias("viewer_id"), F.col("id").alias("order_id")))
    flags = access.role_flags(fx.v_actors, fx.v_actor_roles)
    return access.visible_orders(req, fx.v_orders, flags)


# --- discounts and carts -----------------------------------------------------

CART_ITEMS = "cart_items"  # reference-shaped cart items: one row per line with its normalised addon_ids array


def build_cart_items(fx):
    fx = fx.stored("v_cart_items")  # the items are numbered once, for themselves and for their addons
    return carts.cart_lines(fx.v_cart_items, fx.v_cart_item_addons)


def _lines(fx):
    # written once for all that a query reads of them
    if fx.is_stored(CART_ITEMS):
        return fx.derived(CART_ITEMS, build_cart_items)
    return settle(lambda: build_cart_items(fx))


@register("discount_candidates")
def q_discount_candidates(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    return discounts.discount_candidate_counts(fx.v_products, fx.v_discounts, DISCOUNT_AS_OF)


@register("best_discount")
def q_best_discount(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    t = fx.v_products.select(F.col("id").alias("product_id"), "merchant_id", "category_id")
    r = discounts.resolve_best_discount(t, fx.v_discounts, DISCOUNT_AS_OF)
    return r.select("product_id", "merchant_id", "best_discount_id", "best_priority", "best_discount_type",
                    F.col("best_discount_value").cast("double").alias("best_discount_value"))


@register("discount_amounts")
def q_discount_amounts(spark, sf_dir):
    # D4 on each product's base price with its best discount
    fx = fixtures(spark, sf_dir)
    t = fx.v_products.select(F.col("id").alias("product_id"), "merchant_id", "category_id",
                             F.col("base_price").cast("double").alias("subtotal"))
    r = discounts.resolve_best_discount(t, fx.v_discounts, DISCOUNT_AS_OF).filter(F.col("best_discount_id").isNotNull())
    return r.select("product_id", "subtotal", "best_discount_id",
                    discounts.discount_amount("best_discount_type", "best_discount_value", "subtotal").alias("discount_amount"))


@register("no_discount_rows")
def q_no_discount_rows(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    # merchants whose even discounts apply to no product or category have their sentinel row already
    sentinel = (F.col("type") == "flat") & F.col("product_id").isNull() & F.col("category_id").isNull()
    described = fx.v_discounts.withColumn("description", F.when(sentinel, F.lit(discounts.NO_DISCOUNT_DESCRIPTION)))
    r = discounts.ensure_no_discount(fx.v_merchants, described, DISCOUNT_AS_OF)
    return r.select("merchant_id", "id", "type", F.col("value").cast("double").alias("value"), "description",
                    ts_text("valid_from").alias("valid_from"), ts_text("valid_to").alias("valid_to"))


@register("cart_item_signatures")
def q_cart_item_signatures(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    lines = _lines(fx)
    return lines.groupBy("cart_id", "product_id", ids_text("addon_ids").alias("addon_key")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_items"), F.sum("quantity").cast("bigint").alias("quantity"))


@register("cart_merge")
def q_cart_merge(spark, sf_dir):
    # replay every cart line as an add request into an empty cart table
    fx = fixtures(spark, sf_dir)
    adds = _lines(fx).select("cart_id", "product_id", "quantity", "addon_ids")
    return carts.merge_cart_adds(adds)


@register("addon_ownership")
def q_addon_ownership(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    return carts.check_addon_ownership(_lines(fx), fx.v_product_addons)


@register("cart_pricing")
def q_cart_pricing(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    return carts.price_cart_items(_lines(fx), fx.v_carts, fx.v_products, fx.v_product_addons, fx.v_discounts, DISCOUNT_AS_OF)


def _added_lines(fx, lines=None):
    # a line is added up to ten minutes after its cart is made
    c = fx.v_carts.select(F.col("id").alias("cart_id"), "created_at")
    late = F.make_dt_interval(secs=F.col("id") % 600)
    lines = _lines(fx) if lines is None else lines
    return lines.join(c, "cart_id", "left").withColumn("added_at", F.col("created_at") + late).drop("created_at")


@register("cart_pricing_at_add")
def q_cart_pricing_at_add(spark, sf_dir):
    # each line is priced at the instant it is added
    fx = fixtures(spark, sf_dir)
    return carts.price_cart_items(_added_lines(fx), fx.v_carts, fx.v_products, fx.v_product_addons, fx.v_discounts,
                                  F.col("added_at"))


@register("explicit_discount_check_at_add")
def q_explicit_discount_check_at_add(spark, sf_dir):
    # two lines of three name a discount, which is judged at the instant the line is added
    fx = fixtures(spark, sf_dir)
    named = F.when(F.col("id") % 3 > 0, F.col("product_id") - F.col("product_id") % 7)
    return carts.price_cart_items(_added_lines(fx).withColumn("explicit_id", named), fx.v_carts, fx.v_products,
                                  fx.v_product_addons, fx.v_discounts, F.col("added_at"), explicit_col="explicit_id")


def _adds_to_stored(fx):
    # every line is added once more to its cart, then one unit with the discount that has its product's id; discounts are tripled, so that
    # some are above 100 %; lines of a product with tracked stock are stored already
    held = _lines(fx)
    lines = _added_lines(fx, held)
    named = F.when(F.col("id") % 3 > 0, F.col("product_id") - F.col("product_id") % 7)
    both = F.array(F.struct(F.col("id").alias("add_id"), "quantity", named.alias("discount_id")),
                   F.struct((-F.col("id")).alias("add_id"), F.lit(1).alias("quantity"), F.col("product_id").alias("discount_id")))
    adds = lines.select("cart_id", "product_id", "addon_ids", "added_at", F.inline(both)).select(
        "add_id", "cart_id", "product_id", "addon_ids", "quantity", "discount_id", "added_at")
    tracked = fx.v_products.where("track_inventory").select(F.col("id").alias("product_id"))
    return adds, held.join(tracked, "product_id", "left_semi"), fx.v_discounts.withColumn("value", F.col("value") * 3)


@register("cart_merge_existing")
def q_cart_merge_existing(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    adds, stored, dearer = _adds_to_stored(fx)
    return live_carts.add_to_carts(adds, stored, fx.v_carts, fx.v_products, fx.v_product_addons, dearer)


@register("cart_items_after_adds")
def q_cart_items_after_adds(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    adds, stored, dearer = _adds_to_stored(fx)
    outcomes = live_carts.add_to_carts(adds, stored, fx.v_carts, fx.v_products, fx.v_product_addons, dearer)
    return live_carts.items_after(stored, outcomes)


@register("explicit_discount_check")
def q_explicit_discount_check(spark, sf_dir):
    # each line names the discount whose id is its product id rounded down to a multiple of 7
    fx = fixtures(spark, sf_dir)
    lines = _lines(fx).withColumn("explicit_id", F.col("product_id") - F.col("product_id") % 7)
    return carts.price_cart_items(lines, fx.v_carts, fx.v_products, fx.v_product_addons, fx.v_discounts,
                                  DISCOUNT_AS_OF, explicit_col="explicit_id")


@register("cart_reprice")
def q_cart_reprice(spark, sf_dir):
    # new quantity = quantity - 10; the stored discount is the best one resolved when the line was added
    # (at the discount as-of), re-validated at a later instant
    fx = fixtures(spark, sf_dir)
    lines = _lines(fx)
    targets = (lines.select(F.col("id").alias("item_id"), "cart_id", "product_id", "quantity")
               .join(fx.v_carts.select(F.col("id").alias("cart_id"), "merchant_id"), "cart_id")
               .join(fx.v_products.select(F.col("id").alias("product_id"), "category_id"), "product_id", "left"))
    stored = materialize(discounts.resolve_best_discount(targets, fx.v_discounts, DISCOUNT_AS_OF).select(
        "item_id", "cart_id", "quantity", "best_discount_id"))
    # every third line is updated twice; the later update holds
    updates = stored.select("item_id", "cart_id", (F.col("quantity") - 10).alias("new_quantity"),
                            F.col("best_discount_id").alias("stored_discount_id"), F.lit(2).alias("seq"))
    updates = updates.unionByName(updates.filter(F.col("item_id") % 3 == 0).withColumn("new_quantity", F.lit(1)).withColumn("seq", F.lit(1)))
    return carts.reprice_quantity_updates(updates, lines, fx.v_carts, fx.v_products, fx.v_product_addons,
                                          fx.v_discounts, REPRICE_AS_OF, seq_col="seq")


def _preview_lines(fx, lines=None):
    lines = _lines(fx) if lines is None else lines
    c = fx.v_carts.select(F.col("id").alias("cart_id"), "merchant_id")
    p = fx.v_products.select(F.col("id").alias("product_id"), F.col("merchant_id").alias("_pm"), "category_id",
                             F.col("base_price").cast("double").alias("price"))
    stats = carts.addon_stats(lines, fx.v_product_addons)
    j = lines.join(c, "cart_id").join(p, "product_id", "left").join(stats, "id", "left")
    j = discounts.resolve_best_discount(j, fx.v_discounts, DISCOUNT_AS_OF)
    line_reason = F.when(F.col("_pm").isNull() | (F.col("_pm") != F.col("merchant_id")), F.lit("product_not_found")) \
        .when(F.coalesce("addon_missing", F.lit(0)) > 0, F.lit("addon_not_found"))
    has_best = F.col("best_discount_id").isNotNull()
    return j.select(
        "cart_id", F.col("id").alias("item_id"), "product_id", "quantity", "price", "addon_unit_price",
        F.col("applied_discount_amount").cast("double").alias("line_discount"),
        F.when(has_best, F.col("best_discount_id")).otherwise(discounts.sentinel_id("merchant_id")).alias("discount_id"),
        F.when(has_best, F.col("best_discount_type")).otherwise(F.lit(discounts.NO_DISCOUNT_TYPE)).alias("discount_type"),
        F.when(has_best, F.col("best_discount_value")).otherwise(F.lit(discounts.NO_DISCOUNT_VALUE)).alias("discount_value"),
        line_reason.alias("line_reason"),
    )


@register("cart_preview")
def q_cart_preview(spark, sf_dir):
    # preview every cart with its order's payment method; some carts ask without a method (preview off)
    # and some with an unknown one
    fx = fixtures(spark, sf_dir)
    o = fx.v_orders
    method = (F.when(o.id % 11 == 0, F.lit(None).cast("string")).when(o.id % 23 == 0, F.lit("bitcoin"))
              .otherwise(o.payment_type))
    methods = o.select(F.col("cart_id"), method.alias("payment_method"))
    return carts.cart_preview(_preview_lines(fx), methods)


@register("cart_detail")
def q_cart_detail(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    lines = _lines(fx)
    pl = _preview_lines(fx, lines).select("item_id", "discount_id", "discount_type", F.col("discount_value").cast("double").alias("discount_value"))
    return carts.cart_detail(lines, fx.v_carts, fx.v_products, fx.v_product_addons, pl)


@register("cart_detail_items")
def q_cart_detail_items(spark, sf_dir):
    # the cart documents read back item by item (an empty cart is one row without item), comparable with SQL
    it = F.col("it")
    return q_cart_detail(spark, sf_dir).select("cart_id", "reason", F.explode_outer("items").alias("it")).select(
        "cart_id", "reason", it["product_id"].alias("product_id"), it["item_id"].alias("item_id"),
        it["quantity"].alias("quantity"), it["price"].alias("price"),
        F.when(it.isNotNull(), F.size(it["addons"]).cast("bigint")).alias("n_addons"), it["discount"]["discount_id"].alias("discount_id"))


# --- orders ------------------------------------------------------------------


def _order_requests(fx):
    # every order's cart is placed again by the cart's actor; payment text varies in case and spacing,
    # and a few requests carry an unknown payment type
    o = fx.v_orders
    pt = (F.when(o.id % 97 == 0, F.lit("crypto"))
          .when(o.id % 5 == 0, F.concat(F.lit(" "), F.upper(o.payment_type), F.lit(" ")))
          .otherwise(o.payment_type))
    return o.select(F.col("cart_id"), pt.alias("payment_type"), F.col("actor_id").alias("viewer_id"),
                    F.col("created_at").alias("requested_at"))


def _placed(fx, several_outputs: bool = True):
    flags = access.role_flags(fx.v_actors, fx.v_actor_roles)
    return orders.place_orders(_order_requests(fx), fx.v_carts, _lines(fx), fx.v_products, fx.v_product_addons,
                               fx.v_product_inventory, fx.v_branches, flags, SESSION_AS_OF,
                               materialize_decisions=several_outputs)


@register("merged_cart_lines")
def q_merged_cart_lines(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    merged, addon_q = orders.merge_cart_lines(_lines(fx))
    addon_sum = addon_q.groupBy("cart_id", "product_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_addons"), F.sum("addon_quantity").cast("bigint").alias("addon_units"))
    return merged.join(addon_sum, ["cart_id", "product_id"], "left").select(
        "cart_id", "product_id", F.col("quantity").cast("bigint").alias("quantity"),
        F.col("discount_amount").cast("double").alias("discount_amount"),
        F.coalesce("n_addons", F.lit(0)).cast("bigint").alias("n_addons"),
        F.coalesce("addon_units", F.lit(0)).cast("bigint").alias("addon_units"))


@register("order_bills")
def q_order_bills(spark, sf_dir):
    return _placed(fixtures(spark, sf_dir), several_outputs=False)["bills"]


@register("order_lines")
def q_order_lines(spark, sf_dir):
    return _placed(fixtures(spark, sf_dir), several_outputs=False)["lines"]


@register("order_rejects")
def q_order_rejects(spark, sf_dir):
    return _placed(fixtures(spark, sf_dir), several_outputs=False)["rejects"]


@register("order_inventory")
def q_order_inventory(spark, sf_dir):
    return _placed(fixtures(spark, sf_dir), several_outputs=False)["inventory"]


@register("order_detail")
def q_order_detail(spark, sf_dir):
    placed = _placed(fixtures(spark, sf_dir))
    return orders.order_detail(placed["bills"], placed["lines"], placed["addons"])


@register("order_detail_items")
def q_order_detail_items(spark, sf_dir):
    # the order documents read back item by item (addons summarised), comparable with SQL
    it = F.col("it")
    doc = q_order_detail(spark, sf_dir)
    return doc.select("order_id", "total", F.explode("items").alias("it")).select(
        "order_id", "total", it["product_id"].alias("product_id"), it["quantity"].alias("quantity"),
        it["line_total"].alias("line_total"), F.size(it["addons"]).cast("bigint").alias("n_addons"),
        F.aggregate(it["addons"], F.lit(0).cast("bigint"), lambda acc, a: acc + a["quantity"]).alias("addon_units"),
        F.try_element_at(it["addons"], F.lit(1))["id"].alias("first_addon_id"))


@register("status_transitions")
def q_status_transitions(spark, sf_dir):
    return orders.status_transition_table(fixtures(spark, sf_dir).v_orders)


@register("status_fold")
def q_status_fold(spark, sf_dir):
    return orders.apply_status_changes(fixtures(spark, sf_dir).v_status_requests)


@register("status_fold_incremental")
def q_status_fold_incremental(spark, sf_dir):
    # every other request of the whole table arrives in a second batch, late and in between those folded before
    requests = fixtures(spark, sf_dir).v_status_requests
    path = scratch_path(spark, "status")
    status_state.create(requests.where("event_id % 2 = 0"), path, n_buckets=8)
    status_state.add(spark, path, requests.where("event_id % 2 <> 0"))
    return status_state.states(spark, path)


@register("status_changes_authorized")
def q_status_changes_authorized(spark, sf_dir):
    # the requester is the event's user; the order belongs to that user's tenant; only a merchant-role holder
    # of that tenant may change the status (others are rejected and leave it unchanged)
    fx = fixtures(spark, sf_dir)
    ev = fx.events.select("event_id", "user_id")
    flags = access.role_flags(fx.v_actors, fx.v_actor_roles).select(F.col("actor_id").alias("user_id"), "merchant_role_of")
    req = (fx.v_status_requests.join(ev, "event_id").join(flags, "user_id", "left")
           .withColumn("authorized", F.coalesce(F.col("merchant_role_of") == F.col("user_id") % 10, F.lit(False))))
    return orders.apply_status_changes(req, authorized_col="authorized")


# --- branch hours and coverage -------------------------------------------------


@register("clock_parse")
def q_clock_parse(spark, sf_dir):
    # clock text from every event: its own HH:MM, or an hour taken from the user id (some out of range,
    # some with one digit), or words
    ev = fixtures(spark, sf_dir).events
    hh = F.lpad(F.hour("ts").cast("string"), 2, "0")
    mm = F.lpad(F.minute("ts").cast("string"), 2, "0")
    text = (F.when(ev.event_id % 7 == 0, F.lit("not-a-time"))
            .when(ev.event_id % 5 == 0, F.concat((ev.user_id % 30).cast("string"), F.lit(":"), mm))
            .otherwise(F.concat(hh, F.lit(":"), mm)))
    return hours.clock_parse(ev.select("event_id", text.alias("text")), "text")


@register("branch_availability")
def q_branch_availability(spark, sf_dir):
    return hours.branch_availability(fixtures(spark, sf_dir).v_branches, SESSION_AS_OF)


@register("service_zones")
def q_service_zones(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    return coverage.list_service_zones(fx.v_service_zones, fx.v_zones, fx.v_areas, fx.v_branches).select(
        "id", "merchant_id", "zone_id", "branch_id", "zone_name", "branch_name", "area_id", "area_name", "area_city",
        ts_text("created_at").alias("created_at"))


@register("areas_zones")
def q_areas_zones(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    return coverage.list_areas_zones(fx.v_zones, fx.v_areas)


@register("zone_coverage")
def q_zone_coverage(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    return coverage.zone_coverage(fx.v_points, fx.v_service_zones, fx.v_zones, fx.v_areas, fx.v_branches)


# --- data quality and batch validation -----------------------------------------


@register("unique_violations")
def q_unique_violations(spark, sf_dir):
    fx = fixtures(spark, sf_dir).stored("v_cart_items")
    lines = _lines(fx).withColumn("addon_key", ids_text("addon_ids"))
    checks = [
        quality.check_unique(lines, ["cart_id", "product_id", "addon_key"], "cart_items_cart_product_addons_key"),
        quality.check_unique(fx.v_order_items, ["order_id", "product_id"], "order_items_pkey"),
        quality.check_unique(fx.v_product_inventory, ["product_id", "branch_id"], "product_inventory_product_branch_key"),
        quality.check_unique(fx.v_product_categories, ["merchant_id", "name"], "product_categories_merchant_name_key"),
        quality.check_unique(fx.v_actors, ["merchant_id", "email"], "actors_merchant_email_key"),
        quality.check_unique(fx.v_service_zones, ["merchant_id", "zone_id", "branch_id"], "merchant_service_zones_key"),
        quality.check_unique(fx.v_cart_items, ["id"], "cart_items_pkey"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


@register("admit_sessions")
def q_admit_sessions(spark, sf_dir):
    # every event asks for a session of its user; the whole number of its value names the session and its user's day
    # the token (errors bring none); every actor has one session already
    fx = fixtures(spark, sf_dir)
    e = fx.events
    user = F.col("user_id").cast("string")
    batch = e.select("event_id", "user_id", "ts", F.concat_ws(":", user, F.floor("value").cast("string")).alias("id"),
                     F.when(e.event_type != "error", F.concat_ws(":", user, F.date_format("ts", "yyyy-MM-dd"))).alias("refresh_token"))
    actor = F.col("id").cast("string")
    stored = fx.v_actors.select(F.concat(actor, F.lit(":1")).alias("id"), F.concat(actor, F.lit(":2024-01-01")).alias("refresh_token"))
    keys = [("sessions_pkey", ["id"]), ("sessions_refresh_token_key", ["refresh_token"])]
    return admission.admit(batch, keys, "ts", "event_id", stored).select("event_id", "id", "refresh_token", "accepted", "reason")


@register("fk_orphans")
def q_fk_orphans(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    checks = [
        quality.check_fk(fx.v_cart_items, fx.v_products, ["product_id"], ["id"], "cart_items_product_id_fkey"),
        quality.check_fk(fx.v_carts, fx.v_branches, ["branch_id"], ["id"], "carts_branch_id_fkey"),
        quality.check_fk(fx.v_carts, fx.v_actors, ["merchant_id", "actor_id"], ["merchant_id", "id"], "carts_actor_fkey"),
        quality.check_fk(fx.v_orders, fx.v_actors, ["merchant_id", "actor_id"], ["merchant_id", "id"], "orders_actor_fkey"),
        quality.check_fk(fx.v_service_zones, fx.v_branches, ["branch_id"], ["id"], "merchant_service_zones_branch_id_fkey"),
        quality.check_fk(fx.v_products, fx.v_product_categories, ["category_id"], ["id"], "products_category_id_fkey"),
        quality.check_fk(fx.v_order_items, fx.v_products, ["product_id"], ["id"], "order_items_product_id_fkey"),
        quality.check_fk(fx.v_branches, fx.v_merchants, ["merchant_id"], ["id"], "branches_merchant_id_fkey"),
        # incoming batches derived from the tables, some rows naming parents that do not exist
        quality.check_fk(fx.v_cart_items.withColumn("product_id", F.when(F.col("id") % 50 == 0, F.col("product_id") + 1000000000)
                                                    .otherwise(F.col("product_id"))),
                         fx.v_products, ["product_id"], ["id"], "incoming_cart_items_product_id_fkey"),
        quality.check_fk(fx.v_carts.withColumn("actor_id", F.when(F.col("id") % 7 == 0, F.col("actor_id") + 1).otherwise(F.col("actor_id"))),
                         fx.v_actors, ["merchant_id", "actor_id"], ["merchant_id", "id"], "incoming_carts_actor_fkey"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def _violations(df, table, key_cols, rules):
    checked = quality.check_rules(df, rules)
    return checked.filter(F.size("violations") > 0).select(
        F.lit(table).alias("table_name"), quality.key_text(key_cols).alias("key"),
        F.array_join("violations", ",").alias("violations"))


@register("rule_violations")
def q_rule_violations(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    oi = fx.v_order_items
    parts = [
        _violations(oi, "order_items", ["order_id", "product_id"], [
            ("price_nonneg", F.col("price") >= 0), ("quantity_positive", F.col("quantity") > 0),
            ("base_amount_nonneg", F.col("base_amount") >= 0), ("addon_amount_nonneg", F.col("addon_amount") >= 0),
            ("discount_amount_nonneg", F.col("discount_amount") >= 0), ("tax_amount_nonneg", F.col("tax_amount") >= 0),
            ("line_total_nonneg", F.col("line_total") >= 0)]),
        _violations(fx.v_branches, "branches", ["id"], [
            ("opening_time_range", F.col("opening_time_minutes").between(0, 1439)),
            ("closing_time_range", F.col("closing_time_minutes").between(0, 1439)),
            ("city_enum", quality.in_enum("city", "city_type"))]),
        _violations(fx.v_discounts, "merchant_discounts", ["id"], [
            ("single_scope", ~(F.col("product_id").isNotNull() & F.col("category_id").isNotNull())),
            ("type_enum", quality.in_enum("type", "discount_type"))]),
        _violations(fx.v_orders, "orders", ["id"], [
            ("payment_type_enum", quality.in_enum("payment_type", "payment_type")),
            ("status_enum", quality.in_enum("status", "order_status_type"))]),
        _violations(fx.v_actors, "actors", ["id"], [
            ("email_format", quality.is_email("email")), ("first_name_required", quality.required("first_name"))]),
        _violations(fx.v_cart_items, "cart_items", ["id"], [
            ("quantity_positive", F.col("quantity") > 0),
            ("discount_amount_nonneg", F.col("applied_discount_amount") >= 0)]),
        # incoming batches derived from the tables, some rows breaking one or more rules
        _violations(oi.select("order_id", "product_id", (F.col("quantity") - 10).alias("quantity"), (F.col("price") - 1000).alias("price")),
                    "incoming_order_items", ["order_id", "product_id"], [
            ("price_nonneg", F.col("price") >= 0), ("quantity_positive", F.col("quantity") > 0)]),
        _violations(fx.v_orders.withColumn("status", F.when(F.col("id") % 9 == 0, F.lit("lost")).otherwise(F.col("status"))),
                    "incoming_orders", ["id"], [("status_enum", quality.in_enum("status", "order_status_type"))]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _reason_counts(df, validator):
    return df.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")) \
        .select(F.lit(validator).alias("validator"), "reason", "n_rows")


@register("batch_validation")
def q_batch_validation(spark, sf_dir):
    # batches derived from the given tables, checked by every validator; output = rows per (validator, reason)
    fx = fixtures(spark, sf_dir)
    part, nation = fx.part, fx.nation
    carts_ = fx.v_carts.select(F.col("id").alias("cart_id"), "merchant_id", "branch_id")
    inv_batch = fx.v_cart_items.join(carts_, "cart_id").select(
        "merchant_id", "product_id", "branch_id", (F.col("quantity") - 25).alias("quantity"))
    prod_batch = part.select(
        (part.p_partkey % 10).alias("merchant_id"),
        F.when(part.p_partkey % 4 == 0, F.concat(((part.p_partkey + 1) % 10).cast("string"), F.lit(":"), part.p_type))
        .when(part.p_partkey % 4 == 1, F.lit(None).cast("string"))
        .otherwise(F.concat((part.p_partkey % 10).cast("string"), F.lit(":"), part.p_type)).alias("category_id"),
        F.when(part.p_partkey % 50 == 0, F.lit(" ")).otherwise(part.p_name).alias("name"),
        (part.p_retailprice - 1000).alias("base_price"))
    addon_batch = fx.v_product_addons.select(
        F.when(F.col("id") % 7 == 0, (F.col("product_id") + 1) % 10).otherwise(F.col("product_id") % 10).alias("merchant_id"),
        "product_id", "name", (F.col("price") - 5).alias("price"))
    disc_batch = fx.v_discounts.select(
        "merchant_id", F.when(F.col("id") % 5 == 0, F.lit("bogus")).otherwise(F.col("type")).alias("type"),
        (F.col("value") - 10).alias("value"),
        F.when(F.col("id") % 3 == 0, F.col("product_id")).otherwise(F.col("product_id") + 1).alias("product_id"),
        F.when(F.col("id") % 11 == 0, F.concat(F.col("merchant_id").cast("string"), F.lit(":X"))).otherwise(F.col("category_id")).alias("category_id"))
    hh = F.lpad(((nation.n_nationkey * 7) % 26).cast("string"), 2, "0")
    branch_batch = nation.select(
        F.col("n_name").alias("name"), F.concat(F.lit("street "), nation.n_nationkey.cast("string")).alias("address"),
        F.when(nation.n_nationkey % 6 == 0, F.lit("")).otherwise(F.lit("0300")).alias("contact_number"),
        F.when(nation.n_nationkey % 3 == 0, F.lit("Karachi")).when(nation.n_nationkey % 3 == 1, F.lit("Lahore")).otherwise(F.lit("Quetta")).alias("city"),
        F.concat(hh, F.lit(":00")).alias("opening_time"), F.concat(hh, F.lit(":3")).alias("closing_time"))
    zone_batch = fx.v_zones.select(
        (F.col("area_id") + F.when(F.col("id") % 8 == 0, 10).otherwise(0)).alias("area_id"), "name",
        F.when(F.col("id") % 5 == 0, F.regexp_replace("coordinates_wkt", "POLYGON", "LINESTRING")).otherwise(F.col("coordinates_wkt")).alias("coordinates_wkt"))
    cust = fx.customer
    actor_batch = cust.select(
        (cust.c_custkey % 10).alias("merchant_id"), cust.c_name.alias("full_name"),
        F.when(cust.c_custkey % 9 == 0, F.lit("not-an-email")).when(cust.c_custkey % 7 == 0, F.lit("dup@example.com"))
        .otherwise(F.concat(F.lit("new"), cust.c_custkey.cast("string"), F.lit("@example.com"))).alias("email"),
        F.when(cust.c_custkey % 4 == 0, F.lit("")).otherwise(F.lit("secret")).alias("password"),
        F.when(cust.c_custkey % 5 == 0, F.lit(" Customer ")).when(cust.c_custkey % 13 == 0, F.lit("admin"))
        .otherwise(F.lit("employee")).alias("role"))
    parts = [
        _reason_counts(catalog.validate_inventory_batch(inv_batch, fx.v_products, fx.v_branches), "inventory"),
        _reason_counts(catalog.validate_product_batch(prod_batch, fx.v_product_categories), "product"),
        _reason_counts(catalog.validate_addon_batch(addon_batch, fx.v_products), "addon"),
        _reason_counts(discounts.validate_discount_batch(disc_batch, fx.v_products, fx.v_product_categories), "discount"),
        _reason_counts(hours.validate_branch_batch(branch_batch), "branch"),
        _reason_counts(coverage.validate_zone_batch(zone_batch, fx.v_areas), "zone"),
        _reason_counts(coverage.validate_point_batch(fx.v_points.withColumn("lat", F.col("lat") * 3)), "point"),
        _reason_counts(access.validate_actor_batch(actor_batch, fx.v_actors), "actor"),
        _reason_counts(coverage.validate_area_batch(fx.region.select(
            F.when(fx.region.r_regionkey % 4 == 0, F.lit(" ")).otherwise(fx.region.r_name).alias("name"),
            F.when(fx.region.r_regionkey % 2 == 0, F.lit("Karachi")).otherwise(F.lit("Multan")).alias("city"))), "area"),
        _reason_counts(coverage.validate_service_zone_batch(fx.v_service_zones.select(
            "merchant_id", "zone_id", F.when(F.col("zone_id") % 7 == 0, F.col("zone_id") + 1).otherwise(F.col("branch_id")).alias("branch_id")),
            fx.v_zones, fx.v_branches), "service_zone"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- batch changes ----------------------------------------------------------------

@register("upsert_inventory")
def q_upsert_inventory(spark, sf_dir):
    # every cart line sets the stock of its product at its cart's branch; the latest line id wins
    fx = fixtures(spark, sf_dir)
    carts_ = fx.v_carts.select(F.col("id").alias("cart_id"), "branch_id")
    batch = fx.v_cart_items.join(carts_, "cart_id").select("product_id", "branch_id", "quantity", F.col("id").alias("seq"))
    return changes.upsert(fx.v_product_inventory, batch, ["product_id", "branch_id"], ["quantity"], "seq")


@register("upsert_actor_roles")
def q_upsert_actor_roles(spark, sf_dir):
    # every event gives its user a role in the user's tenant, a signup in the next one, where it is inserted; the latest event holds
    fx = fixtures(spark, sf_dir)
    path = scratch_path(spark, "actor_roles")
    bucketed.create(fx.v_actor_roles.withColumn("assigned_at", F.lit("2024-01-01 00:00:00").cast("timestamp")), path, ["merchant_id", "actor_id"], 8)
    role = F.when(F.col("event_type") == "purchase", "merchant").when(F.col("event_type") == "signup", "employee").otherwise("customer")
    tenant = (F.col("user_id") + F.when(F.col("event_type") == "signup", 1).otherwise(0)) % 10
    batch = fx.events.select(tenant.alias("merchant_id"), F.col("user_id").alias("actor_id"), role.alias("role_type"), F.col("event_id").alias("seq"))
    changes.upsert_into(spark, path, "actor_roles", batch, "seq", SESSION_AS_OF)
    return bucketed.read(spark, path).select("merchant_id", "actor_id", "role_type", (F.col("assigned_at") > F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("changed"))


@register("upsert_order_items")
def q_upsert_order_items(spark, sf_dir):
    # items of pending orders are written again with one more piece, each together with a new item of another product
    fx = fixtures(spark, sf_dir).stored("v_order_items")
    path = scratch_path(spark, "order_items")
    bucketed.create(fx.v_order_items, path, changes.CONFLICTS["order_items"]["keys"], 8)
    again = fx.v_order_items.join(fx.v_orders.where("status = 'pending'").select(F.col("id").alias("order_id")), "order_id")
    again = again.withColumn("quantity", F.col("quantity") + 1)
    batch = again.unionByName(again.withColumn("product_id", F.col("product_id") + 1_000_000_000)).withColumn("seq", F.lit(1))
    changes.upsert_into(spark, path, "order_items", batch, "seq")
    return bucketed.read(spark, path).select("order_id", "product_id", F.col("quantity").cast("bigint").alias("quantity"), F.col("line_total").cast("double").alias("line_total"))


@register("update_by_key")
def q_update_by_key(spark, sf_dir):
    # pending orders move to cancelled and then to accepted (the later update holds); the batch also names order ids
    # that do not exist
    fx = fixtures(spark, sf_dir)
    o = fx.v_orders.select("id", "merchant_id", "status", "payment_type")
    pend = o.filter(F.col("status") == "pending")
    first = pend.select("id", F.lit("cancelled").alias("status"), F.lit(1).alias("seq"))
    batch = first.unionByName(pend.select("id", F.lit("accepted").alias("status"), F.lit(2).alias("seq"))).unionByName(
        pend.select((F.col("id") + 1000000000).alias("id"), F.lit("accepted").alias("status"), F.lit(3).alias("seq")))
    updated, not_found = changes.update_by_key(o, batch, ["id"], seq_col="seq")
    return updated.unionByName(not_found.select("id", F.lit(None).cast("bigint").alias("merchant_id"), "status",
                                                F.lit(None).cast("string").alias("payment_type"),
                                                F.lit(False).alias("updated")))


@register("delete_by_key")
def q_delete_by_key(spark, sf_dir):
    # delete lines with quantity > 45, and ask for line ids that do not exist next to short lines
    fx = fixtures(spark, sf_dir)
    items = fx.v_cart_items.select("id", "cart_id", "quantity")
    keys = items.filter(F.col("quantity") > 45).select("cart_id", "id").unionByName(
        items.filter(F.col("quantity") < 3).select("cart_id", (F.col("id") + 500).alias("id")))
    remaining, deleted, not_found = changes.delete_by_key(items, keys, ["cart_id", "id"])
    return (deleted.select("cart_id", "id", F.lit("deleted").alias("outcome"))
            .unionByName(not_found.select("cart_id", "id", F.lit("not_found").alias("outcome")))
            .unionByName(remaining.select("cart_id", "id", F.lit("kept").alias("outcome"))))


def _new_sessions(fx):
    return fx.v_sessions.select((F.col("id") + 1000000000).alias("id"), "merchant_id", "actor_id",
                                F.concat(F.lit("r"), F.col("id").cast("string")).alias("refresh_token"))


@register("append_rows")
def q_append_rows(spark, sf_dir):
    # A new session per existing session; creation time and the blocked flag are defaults
    fx = fixtures(spark, sf_dir)
    out = changes.append_rows(fx.v_sessions.drop("expires_at"), _new_sessions(fx), SESSION_AS_OF, {"is_blocked": False})
    return out.select("id", "merchant_id", "actor_id", "refresh_token", "is_blocked", ts_text("created_at").alias("created_at"))


@register("insert_then_enrich")
def q_insert_then_enrich(spark, sf_dir):
    # The inserted sessions with their actor's e-mail; sessions without a known actor are not returned
    fx = fixtures(spark, sf_dir)
    emails = fx.v_actors.select("merchant_id", F.col("id").alias("actor_id"), F.col("email").alias("actor_email"))
    out = changes.insert_then_enrich(fx.v_sessions.drop("expires_at"), _new_sessions(fx), SESSION_AS_OF, emails,
                                     ["merchant_id", "actor_id"], ["id"])
    return out.select("id", "merchant_id", "actor_id", "refresh_token", ts_text("created_at").alias("created_at"), "actor_email")


# ON DELETE rules of the commerce schema (child, its columns, parent, its columns, rule), parents before children.
DELETE_RULES = [
    ("actors", ["merchant_id"], "merchants", ["id"], "cascade"),
    ("actor_roles", ["merchant_id"], "merchants", ["id"], "cascade"),
    ("actor_roles", ["merchant_id", "actor_id"], "actors", ["merchant_id", "id"], "cascade"),
    ("sessions", ["merchant_id"], "merchants", ["id"], "cascade"),
    ("sessions", ["merchant_id", "actor_id"], "actors", ["merchant_id", "id"], "cascade"),
    ("branches", ["merchant_id"], "merchants", ["id"], "cascade"),
    ("product_categories", ["merchant_id"], "merchants", ["id"], "cascade"),
    ("products", ["merchant_id"], "merchants", ["id"], "cascade"),
    ("products", ["category_id"], "product_categories", ["id"], "set_null"),
    ("product_addons", ["product_id"], "products", ["id"], "cascade"),
    ("product_inventory", ["product_id"], "products", ["id"], "cascade"),
    ("product_inventory", ["branch_id"], "branches", ["id"], "cascade"),
    ("service_zones", ["merchant_id"], "merchants", ["id"], "cascade"),
    ("service_zones", ["branch_id"], "branches", ["id"], "set_null"),
    ("discounts", ["merchant_id"], "merchants", ["id"], "cascade"),
    ("discounts", ["product_id"], "products", ["id"], "cascade"),
    ("discounts", ["category_id"], "product_categories", ["id"], "cascade"),
    ("carts", ["merchant_id"], "merchants", ["id"], "cascade"),
    ("carts", ["branch_id"], "branches", ["id"], "set_null"),
    ("carts", ["merchant_id", "actor_id"], "actors", ["merchant_id", "id"], "restrict"),
    ("cart_items", ["cart_id"], "carts", ["id"], "cascade"),
    ("cart_items", ["product_id"], "products", ["id"], "cascade"),
    ("orders", ["cart_id"], "carts", ["id"], "cascade"),
    ("orders", ["merchant_id"], "merchants", ["id"], "cascade"),
    ("orders", ["branch_id"], "branches", ["id"], "set_null"),
    ("orders", ["merchant_id", "actor_id"], "actors", ["merchant_id", "id"], "restrict"),
    ("order_items", ["order_id"], "orders", ["id"], "cascade"),
    ("order_items", ["product_id"], "products", ["id"], "cascade"),
    ("order_item_addons", ["order_id", "product_id"], "order_items", ["order_id", "product_id"], "cascade"),
    ("order_item_addons", ["addon_id"], "product_addons", ["id"], "restrict"),
]
# key columns per table, parents before children
DELETE_TABLES = {
    "merchants": ["id"], "actors": ["merchant_id", "id"], "actor_roles": ["merchant_id", "actor_id", "role_type"], "sessions": ["id"], "branches": ["id"],
    "product_categories": ["id"], "products": ["id"], "product_addons": ["id"], "product_inventory": ["product_id", "branch_id"], "service_zones": ["id"],
    "discounts": ["id"], "carts": ["id"], "cart_items": ["id"], "orders": ["id"], "order_items": ["order_id", "product_id"],
    "order_item_addons": ["order_id", "product_id", "addon_id"],
}
# delete requests: the merchants of one category, the branches of one city, products no longer sold, carts of guests
DELETE_REQUESTS = {"merchants": "category = 'bakery'", "branches": "city = 'Lahore'", "products": "NOT is_active", "carts": "actor_id IS NULL"}


@register("cascade_delete")
def q_cascade_delete(spark, sf_dir):
    # what each kind of delete request does to every table: rejected requests, deleted and cleared rows, rows left
    fx = fixtures(spark, sf_dir).stored(*[f"v_{name}" for name, key in DELETE_TABLES.items() if len(key) > 1 or name == "cart_items"])
    rows = {name: getattr(fx, f"v_{name}") for name in DELETE_TABLES}
    edges = [dict(zip(("child", "child_cols", "parent", "parent_cols", "rule"), e)) for e in DELETE_RULES]
    out = []
    for root, which in DELETE_REQUESTS.items():
        got = changes.cascade_delete(root, rows[root].filter(which), {n: (rows[n], k) for n, k in DELETE_TABLES.items()}, edges)

        def part(df, table, outcome, key, n, root=root):
            return df.select(F.lit(root).alias("request"), table.alias("table_name"), F.lit(outcome).alias("outcome"), key.alias("key"), n.cast("bigint").alias("n_rows"))

        def key_of(cols):
            return F.concat_ws(":", *[F.col(c).cast("string") for c in cols])

        out.append(part(got["rejected"], F.col("blocked_by"), "rejected", key_of(DELETE_TABLES[root]), F.col("n_blocking")))
        for name, cols in DELETE_TABLES.items():
            t = got["tables"][name]
            out += [part(t[o], F.lit(name), o, key_of(cols), F.lit(1)) for o in ("deleted", "cleared")]
            out.append(part(t["remaining"].agg(F.count(F.lit(1)).alias("n")), F.lit(name), "remaining", F.lit(""), F.col("n")))
    return reduce(lambda a, b: a.unionByName(b), out)


@register("stock_allocation")
def q_stock_allocation(spark, sf_dir):
    # the stock decision of every request that passes against the opening stock, in request order
    return _placed(fixtures(spark, sf_dir), several_outputs=False)["allocation"]


# --- JSON sources / sinks and streams ----------------------------------------------


ORDER_COMMAND_SCHEMA = T.StructType([
    T.StructField("cart_id", T.StringType()), T.StructField("payment_type", T.StringType()),
    T.StructField("delivery_address", T.StringType()), T.StructField("customer_name", T.StringType()),
    T.StructField("customer_phone", T.StringType()),
])


@register("json_commands")
def q_json_commands(spark, sf_dir):
    # one place-order request body per order; some are cut off, some carry bad or empty fields
    o = fixtures(spark, sf_dir).v_orders
    body = F.to_json(F.struct(
        F.col("cart_id").cast("string").alias("cart_id"),
        F.when(o.id % 9 == 0, F.lit("bitcoin")).otherwise(o.payment_type).alias("payment_type"),
        F.when(o.id % 13 == 0, F.lit("")).otherwise(F.concat(F.lit("addr "), o.id.cast("string"))).alias("delivery_address"),
        F.lit("name").alias("customer_name"),
        F.when(o.id % 17 == 0, F.lit(None).cast("string")).otherwise(F.lit("0300")).alias("customer_phone")))
    text = F.when(o.id % 50 == 0, F.concat(F.lit('{"cart_id": "'), o.id.cast("string"))).otherwise(body)
    parsed = documents.parse_commands(o.select(F.col("id"), text.alias("body")), "body", ORDER_COMMAND_SCHEMA)
    errors = documents.field_errors([
        ("cart_id", "required", documents.required("cart_id")),
        ("cart_id", "uuid", F.col("cart_id").rlike(r"^[0-9]+$")),
        ("payment_type", "required", documents.required("payment_type")),
        ("payment_type", "oneof", documents.one_of("payment_type", ("card", "cash"))),
        ("delivery_address", "required", documents.required("delivery_address")),
        ("customer_name", "required", documents.required("customer_name")),
        ("customer_phone", "required", documents.required("customer_phone")),
    ])
    return parsed.select(
        "id", "bad_json", F.col("payment_type"),
        F.when(~F.col("bad_json"), F.array_join(F.map_keys(errors), ",")).alias("invalid_fields"),
        F.when(~F.col("bad_json"), F.to_json(errors)).alias("errors"),
        (~F.col("bad_json") & (F.size(errors) == 0)).alias("accepted"))


@register("json_documents")
def q_json_documents(spark, sf_dir):
    placed = _placed(fixtures(spark, sf_dir))
    return documents.to_documents(orders.order_detail(placed["bills"], placed["lines"], placed["addons"]), "order_id")


ORDER_DOCUMENT_SCHEMA = T.StructType([
    T.StructField("order_id", T.LongType()), T.StructField("total", T.DoubleType()),
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("product_id", T.LongType()), T.StructField("quantity", T.IntegerType()),
        T.StructField("line_total", T.DoubleType()),
        T.StructField("addons", T.ArrayType(T.StructType([
            T.StructField("id", T.LongType()), T.StructField("quantity", T.IntegerType())]))),
    ]))),
])


@register("json_documents_items")
def q_json_documents_items(spark, sf_dir):
    # the JSON documents parsed back with an explicit schema and flattened like order_detail_items
    docs = q_json_documents(spark, sf_dir)
    d = docs.select(F.from_json("document", ORDER_DOCUMENT_SCHEMA).alias("d")).select("d.*")
    it = F.col("it")
    return d.select("order_id", "total", F.explode("items").alias("it")).select(
        "order_id", "total", it["product_id"].alias("product_id"), it["quantity"].alias("quantity"),
        it["line_total"].alias("line_total"), F.size(it["addons"]).cast("bigint").alias("n_addons"),
        F.aggregate(it["addons"], F.lit(0).cast("bigint"), lambda acc, a: acc + a["quantity"]).alias("addon_units"),
        F.try_element_at(it["addons"], F.lit(1))["id"].alias("first_addon_id"))


@register("status_stream")
def q_status_stream(spark, sf_dir):
    feed = status_stream.run_status_stream(spark, sf_dir)
    return feed.select("order_ref", "event_id", ts_text("ts").alias("ts"), "from_status", "to_status", "applied",
                       "status_after")


@register("sales_stream")
def q_sales_stream(spark, sf_dir):
    return sales_stream.run_sales_stream(spark, sf_dir)
