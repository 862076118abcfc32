"""Steps that several outputs of a query read are written once, and rows that cannot count are left out early."""

import datetime as dt

from conftest import SF_SMALL
from pyspark.sql import functions as F

from mercato.operators import carts, changes, discounts, orders
from mercato.plans import queries
from mercato.sources import bucketed
from mercato.sources.fixtures import Fixtures

AT = dt.datetime(2024, 1, 1, 12)


def plan(df, part="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), part)().toString()


def test_cart_lines_are_written_once(spark):
    fx = Fixtures(spark, SF_SMALL)
    lines = queries._lines(fx)
    assert "Window" not in plan(lines) and "collect_list" not in plan(lines)
    assert sorted(lines.columns) == sorted(queries.build_cart_items(fx).columns)
    assert lines.count() == fx.lineitem.count()


def test_views_on_a_stored_view_read_its_table(spark):
    fx = Fixtures(spark, SF_SMALL).stored("v_cart_items")
    for name in ("v_cart_items", "v_order_items", "v_order_item_addons"):
        assert "Window" not in plan(fx[name])
    assert fx.v_order_items.exceptAll(Fixtures(spark, SF_SMALL).v_order_items).isEmpty()


def test_unique_violations_number_the_items_once(spark):
    assert "Window" not in plan(queries.QUERIES["unique_violations"](spark, SF_SMALL))


def test_orders_look_up_the_lines_of_requests_in_play_only(spark, monkeypatch):
    seen = []
    whole = orders.merge_cart_lines
    monkeypatch.setattr(orders, "merge_cart_lines", lambda lines: seen.append(lines) or whole(lines))
    requests = spark.createDataFrame([(1, "card", None), (2, "shells", None)], "cart_id long, payment_type string, viewer_id long")
    carts_ = spark.createDataFrame([(1, 1, 1, None), (2, 1, 1, None)], "id long, merchant_id long, branch_id long, actor_id long")
    lines = spark.createDataFrame([(1, 7, 2, 0.0, [70]), (2, 7, 3, 0.0, [70]), (3, 7, 1, 0.0, None), (None, 7, 1, 0.0, [70])],
                                  "cart_id long, product_id long, quantity int, applied_discount_amount double, addon_ids array<long>")
    products = spark.createDataFrame([(7, 1, "p", 10.0, False)], "id long, merchant_id long, name string, base_price double, track_inventory boolean")
    addons = spark.createDataFrame([(70, 7, "a", 1.0)], "id long, product_id long, name string, price double")
    inventory = spark.createDataFrame([], "product_id long, branch_id long, quantity int")
    branches = spark.createDataFrame([(1, 1, 0, 0)], "id long, merchant_id long, opening_time_minutes int, closing_time_minutes int")
    flags = spark.createDataFrame([], "actor_id long, merchant_role_of long, customer_role_of long")
    out = orders.place_orders(requests, carts_, lines, products, addons, inventory, branches, flags, AT)
    assert [r.cart_id for r in seen[0].select("cart_id").collect()] == [1]
    assert [(r.order_id, r.line_total) for r in out["lines"].collect()] == [(1, 23.76)]
    assert [(r.order_id, r.addon_quantity) for r in out["addons"].collect()] == [(1, 2)]
    assert [(r.cart_id, r.reason) for r in out["rejects"].collect()] == [(2, "invalid_payment_type")]


def test_discounts_at_own_instant_join_on_plain_columns(spark):
    targets = spark.createDataFrame([(1, 7, "c", AT), (1, 8, None, AT), (None, 7, "c", AT), (1, 7, "c", None)],
                                    "merchant_id long, product_id long, category_id string, at timestamp")
    rows = spark.createDataFrame([(1, 1, 7, None, "flat", 1.0, None, None, AT), (2, 1, None, None, "flat", 2.0, None, None, AT)],
                                 "id long, merchant_id long, product_id long, category_id string, type string, value double, "
                                 "valid_from timestamp, valid_to timestamp, created_at timestamp")
    got = discounts.resolve_best_discount(targets, rows, F.col("at"))
    assert got.columns == [*targets.columns, "best_discount_id", "best_discount_type", "best_discount_value", "best_priority"]
    joins = [line for line in plan(got).splitlines() if "Join " in line]
    assert joins and not any("element_at" in line or "array(" in line for line in joins)
    assert sorted((r.product_id, r.best_discount_id) for r in got.where("merchant_id = 1 AND at IS NOT NULL").collect()) == [(7, 1), (8, 2)]
    assert got.where("merchant_id IS NULL OR at IS NULL").where("best_discount_id IS NOT NULL").isEmpty()


def test_reprice_works_updates_out_once(spark):
    updates = spark.createDataFrame([(1, 5, 2, None, 1), (1, 5, 3, None, 2), (1, 6, 1, None, 1)],
                                    "cart_id long, item_id long, new_quantity int, stored_discount_id long, seq int")
    lines = spark.createDataFrame([(5, 1, 7, [])], "id long, cart_id long, product_id long, addon_ids array<long>")
    carts_ = spark.createDataFrame([(1, 1)], "id long, merchant_id long")
    products = spark.createDataFrame([(7, 1, None, "p", 10.0)], "id long, merchant_id long, category_id string, name string, base_price double")
    addons = spark.createDataFrame([], "id long, product_id long, price double")
    none = spark.createDataFrame([], "id long, merchant_id long, product_id long, category_id string, type string, value double, "
                                     "valid_from timestamp, valid_to timestamp, created_at timestamp")
    got = carts.reprice_quantity_updates(updates, lines, carts_, products, addons, none, AT, seq_col="seq")
    assert "max_by" not in plan(got)
    assert sorted((r.item_id, r.quantity, r.subtotal, r.reason) for r in got.collect()) == [(5, 3, 30.0, None), (6, 1, None, "item_not_found")]


def test_upsert_writes_the_new_rows_aside_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "inventory")
    rows = "product_id long, branch_id long, quantity int, updated_at timestamp"
    bucketed.create(spark.createDataFrame([(1, 1, 5, AT), (2, 1, 6, AT)], rows), path, ["product_id", "branch_id"], 2)
    again = []
    whole = bucketed.materialize
    monkeypatch.setattr(bucketed, "materialize", lambda df: again.append(1) or whole(df))
    batch = spark.createDataFrame([(1, 1, 9, 1), (3, 1, 7, 1)], "product_id long, branch_id long, quantity int, seq int")
    changes.upsert_into(spark, path, "product_inventory", batch, "seq", AT)
    assert not again
    assert sorted((r.product_id, r.quantity) for r in bucketed.read(spark, path).collect()) == [(1, 9), (2, 6), (3, 7)]
