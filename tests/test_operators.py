"""Worked cases from the reference's rules (FIXTURES.md 3.2) on tiny frames, operator by operator."""

import datetime as dt
from decimal import Decimal as D

from mercato.operators import carts, catalog, coverage, discounts, orders, reports

AS_OF = "2000-01-01 00:00:00"
T0 = dt.datetime(1999, 1, 1)


def _discounts(spark, rows):
    return spark.createDataFrame(rows, "id long, merchant_id long, product_id long, category_id string, type string, "
                                       "value decimal(12,2), valid_from timestamp, valid_to timestamp, created_at timestamp")


def test_scope_order_product_then_newest_then_lowest_id(spark):
    d = _discounts(spark, [
        (1, 0, None, None, "flat", D(1), None, None, T0),             # merchant-wide
        (2, 0, None, "0:c", "flat", D(2), None, None, T0),            # category
        (3, 0, 7, None, "flat", D(3), None, None, T0),                # product, older
        (5, 0, 7, None, "flat", D(4), None, None, dt.datetime(1999, 6, 1)),   # product, newest
        (4, 0, 7, None, "flat", D(5), None, None, dt.datetime(1999, 6, 1)),   # product, newest, lower id -> wins
        (6, 0, 7, None, "flat", D(6), dt.datetime(2000, 6, 1), None, dt.datetime(1999, 12, 1)),  # not active yet
        (8, 0, None, "0:c", "flat", D(7), None, None, dt.datetime(1999, 3, 1)),  # newer category
    ])
    t = spark.createDataFrame([(7, 0, "0:c"), (8, 0, "0:c"), (9, 0, "0:x"), (10, 1, None)], "product_id long, merchant_id long, category_id string")
    got = {r.product_id: (r.best_discount_id, r.best_priority) for r in discounts.resolve_best_discount(t, d, AS_OF).collect()}
    assert got == {7: (4, 1), 8: (8, 2), 9: (1, 3), 10: (None, None)}


def _pricing_inputs(spark, dtype, value, price="10.00", qty=1):
    lines = spark.createDataFrame([(1, 100, 7, qty, [])], "id long, cart_id long, product_id long, quantity int, addon_ids array<bigint>")
    carts_ = spark.createDataFrame([(100, 0)], "id long, merchant_id long")
    products = spark.createDataFrame([(7, 0, None, D(price), "p")], "id long, merchant_id long, category_id string, base_price decimal(12,2), name string")
    addons = spark.createDataFrame([], "id long, product_id long, price decimal(12,2)")
    d = _discounts(spark, [(1, 0, 7, None, dtype, D(value), None, None, T0)])
    return lines, carts_, products, addons, d


def test_percentage_above_100_is_rejected(spark):
    r = carts.price_cart_items(*_pricing_inputs(spark, "percentage", 150), AS_OF).first()
    assert r.reason == "exceeds_subtotal"


def test_percentage_and_flat_amounts(spark):
    r = carts.price_cart_items(*_pricing_inputs(spark, "percentage", 15, price="99.99"), AS_OF).first()
    assert (r.subtotal, r.discount_amount, r.reason) == (99.99, 15.0, None)
    r = carts.price_cart_items(*_pricing_inputs(spark, "flat", 50, price="20.00"), AS_OF).first()
    assert (r.discount_amount, r.reason) == (20.0, None)


def test_no_discount_gets_sentinel(spark):
    lines, carts_, products, addons, _ = _pricing_inputs(spark, "flat", 1)
    r = carts.price_cart_items(lines, carts_, products, addons, _discounts(spark, []), AS_OF).first()
    assert (r.discount_id, r.discount_amount, r.reason) == (-1, 0.0, None)


def test_tracked_product_without_inventory_row_is_rejected(spark):
    req = spark.createDataFrame([(100, "card", None)], "cart_id long, payment_type string, viewer_id long")
    carts_ = spark.createDataFrame([(100, 0, 3, None)], "id long, merchant_id long, branch_id long, actor_id long")
    lines = spark.createDataFrame([(1, 100, 7, 2, [], 0.0)], "id long, cart_id long, product_id long, quantity int, addon_ids array<bigint>, applied_discount_amount double")
    products = spark.createDataFrame([(7, 0, "p", D("10.00"), True)], "id long, merchant_id long, name string, base_price decimal(12,2), track_inventory boolean")
    addons = spark.createDataFrame([], "id long, product_id long, name string, price decimal(12,2)")
    inventory = spark.createDataFrame([(7, 4, 50)], "product_id long, branch_id long, quantity int")
    branches = spark.createDataFrame([(3, 0, 0, 0)], "id long, merchant_id long, opening_time_minutes int, closing_time_minutes int")
    flags = spark.createDataFrame([], "actor_id long, merchant_role_of long, customer_role_of long")
    out = orders.place_orders(req, carts_, lines, products, addons, inventory, branches, flags, AS_OF, materialize_steps=False)
    assert [r.reason for r in out["rejects"].collect()] == ["inventory_not_found"]
    inventory2 = spark.createDataFrame([(7, 3, 50)], "product_id long, branch_id long, quantity int")
    out = orders.place_orders(req, carts_, lines, products, addons, inventory2, branches, flags, AS_OF, materialize_steps=False)
    bill = out["bills"].first()
    assert (bill.subtotal, bill.total_tax, bill.total) == (20.0, 1.6, 21.6)
    assert {(r.product_id, r.quantity) for r in out["inventory"].collect()} == {(7, 48)}


def test_reprice_repeated_updates_give_one_row(spark):
    carts_ = spark.createDataFrame([(100, 0), (101, 0)], "id long, merchant_id long")
    lines = spark.createDataFrame([(1, 100, 7, 2, [5], 0.0)], "id long, cart_id long, product_id long, quantity int, addon_ids array<bigint>, applied_discount_amount double")
    products = spark.createDataFrame([(7, 0, None, D("10.00"), "p")], "id long, merchant_id long, category_id string, base_price decimal(12,2), name string")
    addons = spark.createDataFrame([(5, 7, D("1.50"))], "id long, product_id long, price decimal(12,2)")
    ups = spark.createDataFrame([(100, 1, 3, None, 1), (100, 1, 4, None, 2), (101, 1, 4, None, 1), (101, 1, 0, None, 3)],
                                "cart_id long, item_id long, new_quantity int, stored_discount_id long, seq int")
    out = carts.reprice_quantity_updates(ups, lines, carts_, products, addons, _discounts(spark, []), AS_OF, seq_col="seq")
    got = sorted((r.cart_id, r.quantity, r.subtotal, r.reason) for r in out.collect())
    assert got == [(100, 4, 46.0, None), (101, 0, None, "quantity_not_positive")]


def test_report_period_without_sales_is_zeros(spark):
    o = spark.createDataFrame([(1, 0, "delivered", dt.datetime(2000, 3, 5))], "id long, merchant_id long, status string, created_at timestamp")
    i = spark.createDataFrame([(1, D("10.00"), D("0.00"), D("1.00"), D("0.80"), D("9.80"))],
                              "order_id long, base_amount decimal(12,2), addon_amount decimal(12,2), discount_amount decimal(12,2), tax_amount decimal(12,2), line_total decimal(12,2)")
    r = reports.monthly_sales_report_for(o, i, 0, 4, 2000).first()
    assert (r.total_sales, r.total_tax, r.total_discount, r.profit_estimate) == (0.0, 0.0, 0.0, 0.0)
    r = reports.monthly_sales_report_for(o, i, 0, 3, 2000).first()
    assert (r.total_sales, r.total_tax, r.total_discount, r.profit_estimate) == (9.8, 0.8, 1.0, 9.0)


def test_lookup_by_signature_normalises_both_sides(spark):
    items = spark.createDataFrame([(1, 100, 7, [30, 20]), (2, 100, 7, []), (3, 100, 8, [20])],
                                  "id long, cart_id long, product_id long, addon_ids array<bigint>")
    req = spark.createDataFrame([(100, 7, [20, 30, 20, 0]), (100, 7, None), (100, 8, [30]), (101, 7, [])],
                                "cart_id long, product_id long, addon_ids array<bigint>")
    got = sorted(((r.cart_id, r.product_id, r.item_id) for r in carts.lookup_by_signature(items, req).collect()),
                 key=lambda t: (t[0], t[1], t[2] is None, t[2] or 0))
    assert got == [(100, 7, 1), (100, 7, 2), (100, 8, None), (101, 7, None)]


def test_merge_adds_rejects_null_quantity(spark):
    from mercato.operators.carts import merge_cart_adds

    adds = spark.createDataFrame([(1, 1, [1], 2), (1, 1, [1], None), (1, 2, [1], 0)],
                                 "cart_id long, product_id long, addon_ids array<long>, quantity int")
    out = merge_cart_adds(adds)
    rows = out.collect()
    assert sum(r.n_requests for r in rows) == 3


def test_multi_line_json_body_is_accepted(spark):
    from mercato.sources.documents import parse_commands

    df = spark.createDataFrame([('{\n "a": 1\n}',), ("[1]",)], "body string")
    rows = parse_commands(df, "body", "a int").collect()
    assert [(r.a, r.bad_json) for r in rows] == [(1, False), (None, True)]


def test_validators_reject_nulls(spark):
    products = spark.createDataFrame([(7, 0, True)], "id long, merchant_id long, track_inventory boolean")
    branches = spark.createDataFrame([(3, 0)], "id long, merchant_id long")
    categories = spark.createDataFrame([("c", 0)], "id string, merchant_id long")
    inv = spark.createDataFrame([(0, 7, 3, None), (0, 7, 3, 0)], "merchant_id long, product_id long, branch_id long, quantity int")
    assert sorted(str(r.reason) for r in catalog.validate_inventory_batch(inv, products, branches).collect()) == ["None", "negative_quantity"]
    prod = spark.createDataFrame([(0, "c", "n", None)], "merchant_id long, category_id string, name string, base_price double")
    assert catalog.validate_product_batch(prod, categories).first().reason == "price_not_positive"
    add = spark.createDataFrame([(0, 7, "n", None)], "merchant_id long, product_id long, name string, price double")
    assert catalog.validate_addon_batch(add, products).first().reason == "price_not_positive"
    d = spark.createDataFrame([(0, "flat", None, None, None)], "merchant_id long, type string, value double, product_id long, category_id string")
    assert discounts.validate_discount_batch(d, products, categories).first().reason == "value_not_positive"
    pts = spark.createDataFrame([(None, 1.0), (1.0, None), (1.0, 1.0)], "lat double, lon double")
    assert sorted(str(r.reason) for r in coverage.validate_point_batch(pts).collect()) == ["None", "invalid_latitude", "invalid_longitude"]


def test_cart_documents_group_lines_where_the_cart_join_put_them(spark):
    from mercato.operators import carts

    c = spark.createDataFrame([(1, 0), (2, 0)], "id long, merchant_id long")
    lines = spark.createDataFrame([(10, 1, 5, 2, 0.0, [51])], "id long, cart_id long, product_id long, quantity int, applied_discount_amount double, addon_ids array<long>")
    products = spark.createDataFrame([(5, 0, "p", 1.0)], "id long, merchant_id long, name string, base_price double")
    addons = spark.createDataFrame([(51, 5, "a", 1.0)], "id long, product_id long, name string, price double")
    applied = spark.createDataFrame([(10, 7, "flat", 1.0)], "item_id long, discount_id long, discount_type string, discount_value double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = carts.cart_detail(lines, c, products, addons, applied)
        plan = docs._jdf.queryExecution().executedPlan().toString()
        got = {r.cart_id: (r.reason, [(i.item_id, i.discount.discount_id, [a.id for a in i.addons]) for i in r["items"]]) for r in docs.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {1: (None, [(10, 7, [51])]), 2: (None, [])}
    # the lines once; the carts for the join and for the carts without lines
    assert sum("hashpartitioning(cart_id" in line for line in plan.splitlines()) == 3
