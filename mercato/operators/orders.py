"""Order operators.

``place_orders`` turns the reference's per-request transaction into one DAG
over all requests: merge cart lines by product (R5), look up products, stock
and addons with joins, compute line amounts (B3), reduce every cart to its
first failing check, and total the accepted ones (R6).  All per-cart steps are
aggregates keyed by (cart_id, product_id) or cart_id, which Spark combines
map-side before the shuffle.

Check order (first failure wins), as in the reference:
invalid_payment_type (request wrapper), cart_not_found, forbidden,
branch_not_found, branch_closed, quantity_not_positive, then per merged line in
product order: product_not_found, inventory_not_found, insufficient_inventory,
addon_not_found / addon_wrong_product (addons in id-text order); then
cart_empty; then per line: negative_discount, discount_exceeds_line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.clock import is_open
from mercato.functions.cols import first_by, first_reason, reason_code, reason_name
from mercato.functions.money import round2
from mercato.operators.conflicts import conflict_groups, replay_earliest
from mercato.session import materialize

# VAT percent by payment type used when billing.
BILL_VAT = {"card": 8, "cash": 15}

# Order status machine (from -> allowed targets); no self loops.
STATUSES = ("pending", "accepted", "out_for_delivery", "delivered", "cancelled", "refunded")
ALLOWED_TRANSITIONS = {
    "pending": ("accepted", "cancelled"),
    "accepted": ("out_for_delivery", "cancelled"),
    "out_for_delivery": ("delivered", "cancelled"),
    "delivered": ("refunded",),
}
INITIAL_STATUS = "pending"

FIRST_TIME = "0001-01-01 00:00:00"  # requests without a time come first

LINE_REASONS = ("product_not_found", "inventory_not_found", "insufficient_inventory", "addon_not_found",
                "addon_wrong_product", "negative_discount", "discount_exceeds_line")


def bill_vat_rate(payment_type) -> Column:
    """B1: trimmed, lower-cased payment type -> VAT percent (double); NULL when invalid."""
    m = F.lower(F.trim(payment_type))
    expr = None
    for k, v in BILL_VAT.items():
        expr = F.when(m == k, F.lit(float(v))) if expr is None else expr.when(m == k, F.lit(float(v)))
    return expr


def merge_cart_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge raw cart lines by (cart, product) and addon quantities by (cart, product, addon).

    Discounts are rounded per raw line and summed exactly (decimal), matching the
    reference's running Round2 over cent values.
    """
    disc = round2(F.coalesce(F.col("applied_discount_amount").cast("double"), F.lit(0.0))).cast("decimal(12,2)")
    merged = lines.groupBy("cart_id", "product_id").agg(
        F.sum("quantity").cast("int").alias("quantity"),
        F.sum(disc).alias("discount_amount"),
        F.min("quantity").alias("_min_q"),
    )
    addon_q = (
        lines.select("cart_id", "product_id", "quantity", F.explode("addon_ids").alias("addon_id"))
        .groupBy("cart_id", "product_id", "addon_id")
        .agg(F.sum("quantity").cast("int").alias("addon_quantity"))
    )
    return merged, addon_q


def order_line_amounts(quantity, price, addon_amount, discount, rate) -> dict[str, Column]:
    """Base, subtotal, tax and total of one merged line (each Round2)."""
    base = round2(F.col(quantity).cast("double") * F.col(price).cast("double"))
    sub = round2(base + F.col(addon_amount) - F.col(discount).cast("double"))
    tax = round2(sub * (F.col(rate) / 100.0))
    total = round2(sub + tax)
    return {"base_amount": base, "line_subtotal": sub, "tax_amount": tax, "line_total": total}


def place_orders(requests: DataFrame, carts: DataFrame, lines: DataFrame, products: DataFrame,
                 addons: DataFrame, inventory: DataFrame, branches: DataFrame, role_flags: DataFrame,
                 as_of, materialize_steps: bool = True, materialize_decisions: bool = True) -> dict[str, DataFrame]:
    """B2: bill every request ``(cart_id, payment_type, viewer_id[, requested_at])``, stock used up in request order.

    Requests take effect in (requested_at, cart_id) order (null or missing
    ``requested_at``: first); an accepted one uses up its stock, a refused one
    uses none, and a later request sees what is left (B4, B5).  Branch hours are
    checked at the request's own time, ``as_of`` where it has none.

    Returns ``bills`` (accepted orders with totals), ``lines`` (B3 amounts of
    accepted orders), ``addons`` (order_item_addons rows), ``rejects`` (request
    with reason), ``allocation`` (the stock decision of every request that
    passes all checks against the opening stock) and ``inventory`` (stock after
    all requests, never below zero).
    """
    rate = bill_vat_rate(F.col("payment_type"))
    asked = F.col("requested_at") if "requested_at" in requests.columns else F.lit(None)
    req = requests.select("cart_id", "payment_type", "viewer_id", F.coalesce(asked.cast("timestamp"), F.lit(FIRST_TIME).cast("timestamp")).alias("ts"),
                          F.coalesce(asked.cast("timestamp"), F.lit(as_of).cast("timestamp")).alias("_at")).withColumn("vat_rate", rate)

    # cart, viewer and branch checks (one row per request)
    c = carts.select(F.col("id").alias("cart_id"), "merchant_id", "branch_id", F.col("actor_id").alias("cart_actor_id"))
    f = role_flags.select(F.col("actor_id").alias("viewer_id"), "merchant_role_of", "customer_role_of")
    b = branches.select(F.col("id").alias("branch_id"), F.col("merchant_id").alias("_bm"),
                        "opening_time_minutes", "closing_time_minutes")
    r = req.join(c, "cart_id", "left").join(f, "viewer_id", "left").join(b, "branch_id", "left")
    guest = F.col("cart_actor_id").isNull()
    is_merchant = F.coalesce(F.col("merchant_role_of") == F.col("merchant_id"), F.lit(False))
    is_owner = F.coalesce((F.col("customer_role_of") == F.col("merchant_id")) & (F.col("cart_actor_id") == F.col("viewer_id")), F.lit(False))
    branch_ok = F.col("_bm").isNotNull() & (F.col("_bm") == F.col("merchant_id"))
    r = r.withColumn("_head_reason", first_reason(
        (F.col("vat_rate").isNull(), "invalid_payment_type"),
        (F.col("merchant_id").isNull(), "cart_not_found"),
        (~guest & ~is_merchant & ~is_owner, "forbidden"),
        (~branch_ok, "branch_not_found"),
        (~is_open("opening_time_minutes", "closing_time_minutes", F.col("_at")), "branch_closed"),
    )).select("cart_id", "payment_type", "viewer_id", "ts", "vat_rate", "merchant_id", "branch_id", "cart_actor_id", "_head_reason")
    if materialize_steps:
        r = materialize(r)
    in_play = r.filter(F.col("_head_reason").isNull()).select("cart_id", "merchant_id", "branch_id", "vat_rate", "ts")

    # merged lines of the requests still in play, with their lookups, checks and amounts (one row per cart and product)
    lines = lines.join(in_play.select("cart_id"), "cart_id", "left_semi").select(
        "cart_id", "product_id", "quantity", "applied_discount_amount", "addon_ids")
    if materialize_steps:
        lines = materialize(lines)
    merged, addon_q = merge_cart_lines(lines)
    a = addons.select(F.col("id").alias("addon_id"), F.col("product_id").alias("_ap"), F.col("name").alias("addon_name"),
                      F.col("price").alias("addon_price"))
    al = addon_q.join(a, "addon_id", "left")
    addon_err = first_reason((F.col("_ap").isNull(), "addon_not_found"),
                             (F.col("_ap") != F.col("product_id"), "addon_wrong_product"))
    al = al.withColumn("_err", addon_err).withColumn(
        "line_addon_total", round2(F.col("addon_price").cast("double") * F.col("addon_quantity")))
    if materialize_steps and materialize_decisions:
        al = materialize(al)
    # addons of one product are few: the first failing one in id-text order comes from a bounded list
    addon_agg = al.groupBy("cart_id", "product_id").agg(
        round2(F.sum("line_addon_total")).alias("addon_amount"),
        F.collect_list(F.when(F.col("_err").isNotNull(), F.struct(F.col("addon_id").cast("string").alias("k"),
                                                                   F.col("_err").alias("r")))).alias("_errs"),
    ).select("cart_id", "product_id", "addon_amount", F.array_min("_errs")["r"].alias("addon_reason"))
    p = products.select(F.col("id").alias("product_id"), F.col("merchant_id").alias("_pm"), F.col("name").alias("product_name"),
                        F.col("base_price").alias("price"), "track_inventory")
    inv = inventory.select("product_id", "branch_id", F.col("quantity").alias("stock"))
    # the two aggregates lie together by (cart, product); names come last, so that no other shuffle carries them
    bl = (merged.join(addon_agg, ["cart_id", "product_id"], "left")
          .join(in_play, "cart_id")
          .join(inv, ["product_id", "branch_id"], "left")
          .join(p, "product_id", "left")
          .withColumn("addon_amount", F.coalesce("addon_amount", F.lit(0.0))))
    bl = bl.withColumn("_tracked", F.coalesce(F.col("track_inventory"), F.lit(False)) & F.col("branch_id").isNotNull())
    stage1 = first_reason(
        (F.col("_pm").isNull() | (F.col("_pm") != F.col("merchant_id")), "product_not_found"),
        (F.col("_tracked") & F.col("stock").isNull(), "inventory_not_found"),
        (F.col("_tracked") & (F.col("stock") < F.col("quantity")), "insufficient_inventory"),
        (F.col("addon_reason").isNotNull(), "addon"),
    )
    stage1 = F.when(stage1 == "addon", F.col("addon_reason")).otherwise(stage1)
    for name, expr in order_line_amounts("quantity", "price", "addon_amount", "discount_amount", "vat_rate").items():
        bl = bl.withColumn(name, expr)
    stage2 = first_reason((F.col("discount_amount") < 0, "negative_discount"),
                          (F.col("line_subtotal") < 0, "discount_exceeds_line"))
    bl = (bl.withColumn("_stage1", reason_code(stage1, LINE_REASONS))
          .withColumn("_stage2", reason_code(stage2, LINE_REASONS)))
    if materialize_steps:
        bl = materialize(bl)
    per_cart = bl.groupBy("cart_id").agg(
        first_by(F.col("_stage1"), F.col("product_id")).alias("_err1"),
        first_by(F.col("_stage2"), F.col("product_id")).alias("_err2"),
        F.min("_min_q").alias("_min_q"),
        F.count(F.lit(1)).alias("_n_lines"),
        F.sum(F.col("line_subtotal").cast("decimal(14,2)")).alias("_sub"),
        F.sum(F.col("tax_amount").cast("decimal(14,2)")).alias("_tax"),
        F.sum(F.col("line_total").cast("decimal(14,2)")).alias("_tot"),
    )

    if materialize_steps:
        per_cart = materialize(per_cart)

    # requests that pass against the opening stock compete for it in order
    passing = per_cart.filter(F.col("_err1").isNull() & F.col("_err2").isNull() & (F.col("_min_q") > 0)).select("cart_id")
    stock_lines = bl.filter("_tracked").select(F.col("cart_id").alias("order_id"), "branch_id", "ts", "product_id",
                                               "quantity", "stock", "_stage1")
    fits = passing.select(F.col("cart_id").alias("order_id"), F.lit(True).alias("_fits"))
    refused = refused_orders(stock_lines.join(fits, "order_id", "left_semi"))

    # what was left for every tracked line when its request came: gives the first failing line of all requests
    served = fits.join(refused, "order_id", "left_anti")
    left = running_before(
        stock_lines.join(served.withColumnRenamed("_fits", "_served"), "order_id", "left"),
        {"_taken": F.when(F.col("_served"), F.col("quantity")).otherwise(F.lit(0))})
    short = (F.col("stock") - F.col("_taken")) < F.col("quantity")
    insufficient = LINE_REASONS.index("insufficient_inventory") + 1
    serial = left.filter(short).groupBy(F.col("order_id").alias("cart_id")).agg(F.min("product_id").alias("_short_at"))
    line_errors = bl.filter(F.col("_stage1").isNotNull() & (F.col("_stage1") != insufficient)).groupBy("cart_id").agg(
        first_by(F.col("_stage1"), F.col("product_id")).alias("_other"), F.min("product_id").alias("_other_at"))
    line_err = F.when(F.col("_short_at").isNotNull() & (F.col("_other_at").isNull() | (F.col("_short_at") < F.col("_other_at"))),
                      F.lit(insufficient)).otherwise(F.col("_other"))

    r = (r.join(per_cart, "cart_id", "left").join(serial, "cart_id", "left").join(line_errors, "cart_id", "left")
         .withColumn("_line_err", reason_name(line_err, LINE_REASONS)))
    reason = first_reason(
        (F.col("_head_reason").isNotNull(), "head"),
        (F.coalesce(F.col("_min_q"), F.lit(1)) <= 0, "quantity_not_positive"),
        (F.col("_line_err").isNotNull(), "line"),
        (F.coalesce(F.col("_n_lines"), F.lit(0)) == 0, "cart_empty"),
    )
    reason = F.when(reason == "head", F.col("_head_reason")).when(reason == "line", F.col("_line_err")).otherwise(reason)
    r = r.withColumn("reason", F.coalesce(reason, reason_name(F.col("_err2"), LINE_REASONS)))
    if materialize_steps and materialize_decisions:
        r = materialize(r)

    accepted = r.filter(F.col("reason").isNull())
    bills = accepted.select(
        F.col("cart_id").alias("order_id"), "merchant_id", "branch_id", F.col("cart_actor_id").alias("actor_id"),
        F.lower(F.trim("payment_type")).alias("payment_type"), "vat_rate",
        round2(F.col("_sub")).alias("subtotal"), round2(F.col("_tax")).alias("total_tax"), round2(F.col("_tot")).alias("total"),
        F.lit(INITIAL_STATUS).alias("status"),
    )
    rejects = r.filter(F.col("reason").isNotNull()).select("cart_id", "payment_type", "viewer_id", "reason")
    ok_ids = accepted.select("cart_id")
    allocation = r.join(passing, "cart_id", "left_semi").select(
        F.col("cart_id").alias("order_id"), "branch_id", F.col("reason").isNull().alias("accepted"), "reason")
    order_lines = bl.join(ok_ids, "cart_id", "left_semi").select(
        F.col("cart_id").alias("order_id"), "product_id", "product_name", "quantity",
        F.col("price").cast("double").alias("price"), "base_amount", "addon_amount",
        F.col("discount_amount").cast("double").alias("discount_amount"), "line_subtotal", "tax_amount", "line_total",
    )
    order_addons = al.join(ok_ids, "cart_id", "left_semi").select(
        F.col("cart_id").alias("order_id"), "product_id", "addon_id", "addon_name",
        F.col("addon_price").cast("double").alias("addon_price"), "addon_quantity", "line_addon_total",
    )
    new_inventory = use_stock(inventory, bl.filter("_tracked").join(ok_ids, "cart_id", "left_semi"))
    return {"bills": bills, "lines": order_lines, "addons": order_addons, "rejects": rejects, "allocation": allocation,
            "inventory": new_inventory}


def order_detail(bills: DataFrame, order_lines: DataFrame, order_addons: DataFrame) -> DataFrame:
    """One nested document per order: items by product id, each with its addons by addon id.

    The addon and item arrays are bounded by the size of one order; both are listed by
    order, as the orders' lines lie, and an item takes its addons out of its order's.
    """
    ad = order_addons.groupBy("order_id").agg(
        F.array_sort(F.collect_list(F.struct("product_id", F.col("addon_id").alias("id"), F.col("addon_name").alias("name"),
                                             F.col("addon_price").alias("price"), F.col("addon_quantity").alias("quantity"),
                                             F.col("line_addon_total").alias("total")))).alias("_addons"))
    it = order_lines.groupBy("order_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "product_id", "product_name", "quantity", "price", "base_amount", "addon_amount", "discount_amount",
            "tax_amount", "line_total"))).alias("_items"))
    fields = ("id", "name", "price", "quantity", "total")

    def with_addons(item: Column) -> Column:
        own = F.filter(F.coalesce("_addons", F.array()), lambda a: a["product_id"] == item["product_id"])
        return item.withField("addons", F.transform(own, lambda a: F.struct(*[a[c].alias(c) for c in fields])))

    it = it.join(ad, "order_id", "left").select("order_id", F.transform("_items", with_addons).alias("items"))
    return bills.join(it, "order_id", "left")


def _allowed_expr(frm: Column, to: Column) -> Column:
    cond = F.lit(False)
    for s, targets in ALLOWED_TRANSITIONS.items():
        cond = cond | ((frm == F.lit(s)) & to.isin(*targets))
    return cond


def check_status_transition(frm, to) -> Column:
    """Is ``frm -> to`` an allowed status change?"""
    return _allowed_expr(F.col(frm) if isinstance(frm, str) else frm, F.col(to) if isinstance(to, str) else to)


def status_transition_table(orders: DataFrame) -> DataFrame:
    """B9 over data: every order's current status against every possible target status."""
    return orders.select(
        F.col("id").alias("order_id"), F.col("status").alias("from_status"),
        F.explode(F.array(*[F.lit(s) for s in STATUSES])).alias("to_status"),
    ).withColumn("allowed", check_status_transition("from_status", "to_status"))


# --- B10: ordered status fold --------------------------------------------------
# A request for target t is the function s -> (t if allowed(s, t) else s) on the
# six statuses, plus a count of applied requests per start state.  Functions
# compose associatively, so the fold is done bottom-up over time buckets of one
# order (minute -> hour -> day -> order), each a short sorted list.  No single
# group holds all requests of a busy order.

_IDX = {s: i for i, s in enumerate(STATUSES)}


def _status_index(c: Column) -> Column:
    expr = None
    for s, i in _IDX.items():
        expr = F.when(c == s, F.lit(i)) if expr is None else expr.when(c == s, F.lit(i))
    return expr


def _allowed_idx(x: Column, t: Column) -> Column:
    cond = F.lit(False)
    for s, targets in ALLOWED_TRANSITIONS.items():
        cond = cond | ((x == _IDX[s]) & t.isin(*[_IDX[v] for v in targets]))
    return cond


def _identity() -> Column:
    return F.struct(F.array(*[F.lit(i) for i in range(len(STATUSES))]).alias("f"),
                    F.array(*[F.lit(0) for _ in STATUSES]).alias("c"))


def _apply_request(acc: Column, t: Column) -> Column:
    f, c = acc["f"], acc["c"]
    return F.struct(
        F.transform(f, lambda x: F.when(_allowed_idx(x, t), t).otherwise(x)).alias("f"),
        F.zip_with(c, f, lambda n, x: n + F.when(_allowed_idx(x, t), 1).otherwise(0)).alias("c"),
    )


def _compose(acc: Column, g: Column) -> Column:
    f, c = acc["f"], acc["c"]
    return F.struct(
        F.transform(f, lambda x: F.element_at(g["f"], x + 1)).alias("f"),
        F.zip_with(c, f, lambda n, x: n + F.element_at(g["c"], x + 1)).alias("c"),
    )


def apply_status_changes(requests: DataFrame, key: str = "order_ref",
                         levels: tuple[str, ...] = ("minute", "hour", "day"),
                         authorized_col: str | None = None) -> DataFrame:
    """Final status of each order after its requests in (ts, event_id) order.

    Starts at ``pending``; a request that is not an allowed transition from the
    current status is rejected and the status stays.  Output: key,
    final_status, n_requests, n_applied, n_rejected.

    With ``authorized_col`` (e.g. "requester holds the merchant role in the
    order's tenant", see ``access.role_flags``), unauthorized requests are
    rejected and leave the status unchanged.

    The fold is hierarchical: requests are composed inside (key, finest time
    bucket), then bucket functions are composed into the next coarser bucket,
    and so on up to the key.  Each list that is sorted and folded holds at most
    one bucket's parts (<= 60 minutes, 24 hours, the days of one order), so a
    busy order is spread over many groups and tasks.
    """
    target = _status_index(F.col("requested_status"))
    if authorized_col:
        target = F.when(F.coalesce(F.col(authorized_col), F.lit(False)), target).otherwise(F.lit(-1))  # -1: no-op
    req = requests.select(key, "ts", "event_id", target.alias("t"))
    finest = levels[0]
    parts = req.withColumn("_b", F.date_trunc(finest, "ts")).groupBy(key, "_b").agg(
        F.array_sort(F.collect_list(F.struct("ts", "event_id", "t"))).alias("_reqs"),
        F.count(F.lit(1)).alias("_n"),
    ).select(key, "_b", "_n", F.aggregate("_reqs", _identity(), lambda acc, r: _apply_request(acc, r["t"])).alias("_fn"))
    for coarser in levels[1:]:
        parts = parts.withColumn("_up", F.date_trunc(coarser, "_b")).groupBy(key, "_up").agg(
            F.array_sort(F.collect_list(F.struct("_b", "_fn"))).alias("_parts"), F.sum("_n").alias("_n"),
        ).select(key, F.col("_up").alias("_b"), "_n",
                 F.aggregate("_parts", _identity(), lambda acc, p: _compose(acc, p["_fn"])).alias("_fn"))
    top = parts.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("_b", "_fn"))).alias("_parts"), F.sum("_n").alias("n_requests"),
    ).select(key, "n_requests", F.aggregate("_parts", _identity(), lambda acc, p: _compose(acc, p["_fn"])).alias("_fn"))
    return folded(top, key, "_fn", "n_requests")


def folded(top: DataFrame, key: str, fn: str, n: str) -> DataFrame:
    """Key, final status and counts from each order's composed function and number of requests."""
    names = F.array(*[F.lit(s) for s in STATUSES])
    start = _IDX[INITIAL_STATUS] + 1
    applied = F.element_at(F.col(fn)["c"], start)
    return top.select(
        key,
        F.element_at(names, F.element_at(F.col(fn)["f"], start) + 1).alias("final_status"),
        F.col(n).cast("bigint").alias("n_requests"),
        applied.cast("bigint").alias("n_applied"),
        (F.col(n) - applied).cast("bigint").alias("n_rejected"),
    )


# --- B5: serial stock allocation -------------------------------------------------



def running_before(lines: DataFrame, amounts: dict[str, Column], keys=("branch_id", "product_id"),
                   bucket: str = "hour") -> DataFrame:
    """Add, per line, the sum of each amount over the lines of the same key that come before it by (ts, order_id).

    Sums run inside one time bucket of a key and are offset by the totals of the
    key's earlier buckets, so a hot product's lines are spread over its buckets.
    """
    k = [*keys, "_bucket"]
    b = lines.withColumn("_bucket", F.date_trunc(bucket, "ts"))
    for name, expr in amounts.items():
        b = b.withColumn(name, expr.cast("long"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = b.groupBy(*k).agg(*[F.sum(n).alias(f"_sum_{n}") for n in amounts]).select(
        *k, *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_off_{n}") for n in amounts])
    inside = Window.partitionBy(*k).orderBy("ts", "order_id").rowsBetween(Window.unboundedPreceding, -1)
    out = b.select("*", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"_in_{n}") for n in amounts]).join(offsets, k)
    for n in amounts:
        out = out.withColumn(n, F.col(f"_in_{n}") + F.col(f"_off_{n}"))
    return out.drop("_bucket", *[f"_in_{n}" for n in amounts], *[f"_off_{n}" for n in amounts])


def refused_orders(candidates: DataFrame, at_once: int = 20_000) -> DataFrame:
    """Orders (order_id) that find too little stock when all are served in (ts, order_id) order.

    ``candidates``: one row per order and product (order_id, branch_id, ts,
    product_id, quantity > 0, stock).  Only products asked for beyond their stock
    can refuse an order.  On those, a round serves the earliest ``at_once`` open
    orders of every component of conflicting orders one by one
    (``conflicts.replay_earliest``).  If some are left, those whose outcome follows
    from running sums are settled too: with the open demand U before a line, an order
    is accepted when every line has U + q <= left and refused when any has q > left.
    Rounds are written as tables; the driver sees only whether one is empty.
    """
    asked = candidates.groupBy("branch_id", "product_id").agg(F.sum("quantity").alias("_asked"))
    lines = materialize(
        candidates.select("order_id", "branch_id", "ts", "product_id", "quantity", F.coalesce("stock", F.lit(-1)).alias("left"))
        .join(asked, ["branch_id", "product_id"]).filter(F.col("_asked") > F.col("left")).drop("_asked"))
    state = lines.join(conflict_groups(lines, at_once), "order_id")
    decided = []
    while True:
        decided.append(materialize(replay_earliest(state, at_once)))
        state = _open_after(state, decided[-1])
        if state.isEmpty():
            return reduce(DataFrame.unionByName, decided).filter(~F.col("served")).select("order_id")
        state = materialize(state)
        before = running_before(state, {"_u": F.col("quantity")})
        decided.append(materialize(before.groupBy("order_id").agg(
            F.min(F.col("_u") + F.col("quantity") <= F.col("left")).alias("served"),
            F.max(F.col("quantity") > F.col("left")).alias("_short"),
        ).filter(F.col("served") | F.col("_short")).select("order_id", "served")))
        state = materialize(_open_after(state, decided[-1]))


def _open_after(state: DataFrame, decided: DataFrame) -> DataFrame:
    """Lines of the orders still open, with the stock left after the accepted ones."""
    marked = state.join(decided, "order_id", "left")
    used = marked.filter("served").groupBy("branch_id", "product_id").agg(F.sum("quantity").alias("_used"))
    return (marked.filter(F.col("served").isNull()).join(used, ["branch_id", "product_id"], "left")
            .withColumn("left", F.col("left") - F.coalesce("_used", F.lit(0))).select(*state.columns))


def use_stock(inventory: DataFrame, served_lines: DataFrame) -> DataFrame:
    """Inventory after the given lines (branch_id, product_id, quantity) have used up their stock."""
    used = served_lines.groupBy("product_id", "branch_id").agg(F.sum("quantity").alias("_used"))
    return inventory.join(used, ["product_id", "branch_id"], "left").select(
        "product_id", "branch_id", (F.col("quantity") - F.coalesce("_used", F.lit(0))).cast("int").alias("quantity"))


def allocate_stock(candidates: DataFrame, inventory: DataFrame) -> dict[str, DataFrame]:
    """Serial stock use in (ts, order_id) order; refused orders do not consume stock.

    ``candidates``: (order_id, branch_id, ts, product_id, quantity), one row per
    order and product, for the tracked lines of orders that pass every other
    check.  A product without a stock row refuses its orders.  Returns
    ``decisions`` (order_id, branch_id, accepted, reason) and the new ``inventory``.
    """
    candidates = materialize(candidates.withColumn("ts", F.coalesce("ts", F.lit(FIRST_TIME).cast("timestamp"))))
    stock = inventory.select("product_id", "branch_id", F.col("quantity").alias("stock"))
    refused = materialize(refused_orders(candidates.join(stock, ["product_id", "branch_id"], "left")))
    decisions = (candidates.select("order_id", "branch_id").distinct()
                 .join(refused.withColumn("reason", F.lit("insufficient_inventory")), "order_id", "left")
                 .select("order_id", "branch_id", F.col("reason").isNull().alias("accepted"), "reason"))
    return {"decisions": decisions,
            "inventory": use_stock(inventory, candidates.join(refused, "order_id", "left_anti"))}
