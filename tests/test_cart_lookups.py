"""Lookups of cart lines: discounts in force by their few contenders, addons by the product that has them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from mercato.operators import carts, discounts

DISCOUNT = ("id bigint, merchant_id bigint, product_id bigint, category_id string, type string, value int, "
            "valid_from timestamp, valid_to timestamp, created_at timestamp")
T0 = dt.datetime(2000, 1, 1)


def _random_discounts(spark, rnd, n):
    def bound():
        return rnd.choice([None, T0 + dt.timedelta(minutes=rnd.randrange(60 * 24 * 20)), T0 + dt.timedelta(days=rnd.randrange(20))])

    rows = []
    for i in range(n):
        product, category = rnd.choice([(rnd.randrange(6), None), (None, rnd.choice("ab")), (None, None)])
        rows.append((i, rnd.choice([1, 2, None]) if i % 9 == 0 else rnd.choice([1, 2]), product, category, rnd.choice(["flat", "percentage"]), i, bound(), bound(),
                     T0 - dt.timedelta(days=rnd.randrange(30))))
    return rows, spark.createDataFrame(rows, DISCOUNT)


def _best(rows, merchant, product, category, at):
    if at is None or merchant is None:
        return None
    def scope(r):
        return 1 if r[2] is not None else 2 if r[3] is not None else 3
    hits = [r for r in rows if r[1] == merchant and (r[6] is None or r[6] <= at) and (r[7] is None or at <= r[7])
            and (r[2] == product if scope(r) == 1 else r[3] == category if scope(r) == 2 else True)]
    return min(hits, key=lambda r: (scope(r), -r[8].timestamp(), r[0]))[0] if hits else None


@pytest.mark.parametrize("few", [0, 2, 1000])
def test_discount_at_an_instant_is_the_same_for_few_and_many_contenders(spark, monkeypatch, few):
    monkeypatch.setattr(discounts, "FEW", few)
    rnd = random.Random(3)
    rows, ds = _random_discounts(spark, rnd, 120)
    asks = [(i, rnd.choice([1, 2, 3, None]), rnd.choice([*range(6), None]), rnd.choice(["a", "b", "c", None]),
             rnd.choice([None, T0 + dt.timedelta(days=rnd.randrange(20)), T0 + dt.timedelta(minutes=rnd.randrange(60 * 24 * 20))])) for i in range(300)]
    asks += asks[:3]
    targets = spark.createDataFrame(asks, "n int, merchant_id bigint, product_id bigint, category_id string, asked timestamp")
    got = discounts.resolve_best_discount(targets, ds, F.col("asked")).collect()
    assert len(got) == len(asks) and got[0].__fields__[:5] == targets.columns
    assert {r.n: r.best_discount_id for r in got} == {a[0]: _best(rows, *a[1:]) for a in asks}


def test_discounts_with_few_contenders_are_not_looked_up_by_cells(spark, monkeypatch):
    # lines were exploded by scope and by width of time before, some eight rows for each line and scope
    monkeypatch.setattr(discounts, "in_force", None)
    rows, ds = _random_discounts(spark, random.Random(4), 12)
    targets = spark.createDataFrame([(1, 3, "a", T0)], "merchant_id bigint, product_id bigint, category_id string, asked timestamp")
    assert discounts.resolve_best_discount(targets, ds, F.col("asked")).first().best_discount_id == _best(rows, 1, 3, "a", T0)


def _tables(spark):
    return (spark.createDataFrame([(1, 1), (2, 2)], "id bigint, merchant_id bigint"),
            spark.createDataFrame([(10, 1, None, "p", 2.0), (11, 1, "a", "q", 3.0), (12, 2, None, "r", 5.0)],
                                  "id bigint, merchant_id bigint, category_id string, name string, base_price double"),
            spark.createDataFrame([(100, 10, "x", 0.5), (101, 10, "y", 0.25), (101, 10, "y2", 0.25), (110, 11, "z", 1.0),
                                   (111, 11, "both", 2.0), (111, 10, "both", 4.0), (112, None, "none", 8.0), (113, 11, "free", None)],
                                  "id bigint, product_id bigint, name string, price double"))


LINE = "id bigint, cart_id bigint, product_id bigint, quantity int, addon_ids array<bigint>"


def test_addons_are_looked_up_at_their_product(spark, monkeypatch):
    # every line was exploded by its addons, joined with them and grouped again before
    monkeypatch.setattr(carts, "addon_stats", None)
    c, p, a = _tables(spark)
    lines = spark.createDataFrame([(1, 1, 10, 2, [100, 101]), (2, 1, 11, 1, [110, 113]), (3, 1, 11, 1, [113]), (4, 1, 10, 1, []), (None, 1, 10, 1, [100])], LINE)
    got = carts.price_cart_items(lines, c, p, a, spark.createDataFrame([], DISCOUNT), "2000-01-01 00:00:00").collect()
    assert {r.item_id: (r.subtotal, r.reason) for r in got} == {1: (6.0, None), 2: (4.0, None), 3: (3.0, None), 4: (2.0, None), None: (2.0, None)}


def test_strange_addons_and_repeated_lines_equal_the_lookup_one_by_one(spark):
    c, p, a = _tables(spark)
    rows = [(1, 1, 10, 1, [100, 110]), (2, 1, 10, 1, [100, 999]), (3, 1, 10, 1, [111]), (4, 1, 11, 1, [112]), (5, 1, None, 1, [100]),
            (6, 1, 10, 1, [101]), (7, 1, 10, 1, [100]), (7, 1, 10, 1, [100]), (8, 1, 99, 1, [100]), (9, 1, 10, 1, None)]
    lines = spark.createDataFrame(rows, LINE)
    stats = {r.id: r for r in carts.addon_stats(lines, a).collect()}
    j = carts._priced(lines, c, p, a)[0].collect()
    assert len(j) == len(rows)
    for r in j:
        want = stats.get(r.id)
        assert (r.addon_unit_price, r.addon_reason) == ((want.addon_unit_price, want.addon_reason) if want else (None, None)), r
    assert {stats[i].addon_reason for i in (1, 2, 3)} == {"addon_wrong_product", "addon_not_found"}


def _documents(spark, rows):
    c, p, a = _tables(spark)
    lines = spark.createDataFrame([(*r, 1.5) for r in rows], LINE + ", applied_discount_amount double")
    applied = spark.createDataFrame([(1, 7, "flat", 1.0)], "item_id bigint, discount_id bigint, discount_type string, discount_value double")
    docs = carts.cart_detail(lines, c, p, a, applied).collect()
    return {d.cart_id: (d.reason, [(i.product_id, i.item_id, i.quantity, i.price, [tuple(x) for x in i.addons], i.discount and tuple(i.discount)) for i in d["items"]])
            for d in docs}


def test_documents_take_addons_from_their_product(spark, monkeypatch):
    # every line was taken apart by its addons and put together again before
    monkeypatch.setattr(carts.F, "posexplode_outer", None)
    monkeypatch.setattr(carts, "_listed_one_by_one", None, raising=False)
    got = _documents(spark, [(1, 1, 10, 2, [100, 101]), (2, 1, 11, 1, [110]), (3, 2, 12, 1, [])])
    assert got == {1: (None, [(10, 1, 2, 2.0, [(100, "x", 0.5), (101, "y", 0.25), (101, "y2", 0.25)], (7, "flat", 1.0)), (11, 2, 1, 3.0, [(110, "z", 1.0)], None)]),
                   2: (None, [(12, 3, 1, 5.0, [], None)])}


def test_documents_with_strange_addons_and_repeated_lines(spark):
    got = _documents(spark, [(1, 1, 10, 1, [100, 110]), (2, 1, 10, 1, [111]), (7, 1, 11, 1, [110]), (7, 1, 11, 1, [110]), (None, 1, 11, 1, [110]),
                             (3, 2, 12, 1, [999, 100])])
    assert got[1] == (None, [(10, 1, 1, 2.0, [(100, "x", 0.5), (110, "z", 1.0)], (7, "flat", 1.0)), (10, 2, 1, 2.0, [(111, "both", 2.0), (111, "both", 4.0)], None),
                             (11, None, 1, 3.0, [], None), *[(11, 7, 1, 3.0, [(110, "z", 1.0)] * 2, None)] * 2])
    assert got[2] == ("addon_not_found", [(12, 3, 1, 5.0, [(999, None, None), (100, "x", 0.5)], None)])


def test_tables_of_the_catalogues_size_are_not_sent_out_by_the_driver(spark):
    c, p, a = _tables(spark)
    lines = spark.createDataFrame([(1, 1, 10, 2, [100], 5)], LINE + ", named bigint")
    ds = spark.createDataFrame([(5, 1, 10, None, "flat", 1, None, None, T0)], DISCOUNT)
    got = carts.price_cart_items(lines, c, p, a, ds, "2000-01-01 00:00:00", explicit_col="named")
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "_did" in x] and "_did" in plan
    assert got.first().discount_amount == 1.0
