"""Order invariants and the serial stock use against a plain Python replay."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from mercato.operators import orders
from mercato.plans import queries as Q
from mercato.sources.fixtures import fixtures


def test_every_request_is_billed_or_rejected(spark):
    fx = fixtures(spark, SF_SMALL)
    placed = Q._placed(fx)
    n_req = Q._order_requests(fx).count()
    assert placed["bills"].count() + placed["rejects"].count() == n_req
    assert placed["bills"].join(placed["rejects"], F.col("order_id") == F.col("cart_id")).count() == 0


def test_bill_total_is_sum_of_lines(spark):
    placed = Q._placed(fixtures(spark, SF_SMALL))
    sums = placed["lines"].groupBy("order_id").agg(F.sum(F.col("line_total").cast("decimal(14,2)")).alias("s"))
    bad = placed["bills"].join(sums, "order_id").filter(F.abs(F.col("total") - F.col("s").cast("double")) > 0.005)
    assert bad.count() == 0


def test_stock_never_negative(spark):
    placed = Q._placed(fixtures(spark, SF_SMALL))
    assert placed["inventory"].filter("quantity < 0").count() == 0
    assert placed["inventory"].count() == fixtures(spark, SF_SMALL).v_product_inventory.count()


def replay(cand, stock):
    """Serve orders one at a time in (ts, order_id) order; returns ({order: accepted}, stock left)."""
    lines, first_ts = {}, {}
    for o, b, ts, p, q in cand:
        lines.setdefault((o, b), []).append((p, q))
        first_ts[o] = ts
    left, accepted = dict(stock), {}
    for (o, b) in sorted(lines, key=lambda k: (first_ts[k[0]], k[0])):
        ok = all(left.get((p, b), -1) >= q for p, q in lines[(o, b)])
        if ok:
            for p, q in lines[(o, b)]:
                left[(p, b)] -= q
        accepted[o] = ok
    return accepted, left


CANDIDATES = "order_id long, branch_id long, ts timestamp, product_id long, quantity int"
STOCK = "product_id long, branch_id long, quantity int"


def random_orders(seed, branches, products, orders, minutes):
    rng = random.Random(seed)
    stock = {(p, b): rng.randint(0, 12) for b in range(branches) for p in range(products) if rng.random() < 0.95}
    cand = []
    for oid in range(orders):
        b = 0 if rng.random() < 0.6 else rng.randrange(branches)  # branch 0 is hot
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(minutes))
        for p in rng.sample(range(products), rng.randint(1, 4)):
            cand.append((oid, b, ts, p, rng.randint(1, 4)))
    return cand, stock


@pytest.mark.parametrize("seed, branches, products, n, minutes",
                         [(1, 3, 30, 300, 5000), (2, 1, 6, 120, 1), (3, 4, 8, 250, 600)])
def test_serial_allocation_matches_replay(spark, seed, branches, products, n, minutes):
    cand, stock = random_orders(seed, branches, products, n, minutes)
    expected, left = replay(cand, stock)
    out = orders.allocate_stock(spark.createDataFrame(cand, CANDIDATES),
                                spark.createDataFrame([(p, b, q) for (p, b), q in stock.items()], STOCK))
    got = out["decisions"].collect()
    assert {r.order_id: r.accepted for r in got} == expected and len(got) == len(expected)
    assert {r.reason for r in got if not r.accepted} == {"insufficient_inventory"}
    assert {(r.product_id, r.branch_id): r.quantity for r in out["inventory"].collect()} == left
    assert any(expected.values()) and not all(expected.values())


def chain(n, stock):
    """Order i asks for one piece of products i and i + 1: each hinges on the one before."""
    t = dt.datetime(2024, 1, 1)
    cand = [(i, 0, t + dt.timedelta(seconds=i), p, 1) for i in range(n) for p in (i, i + 1)]
    return cand, {(p, 0): stock for p in range(n + 1)}


@pytest.mark.parametrize("at_once", [1_000, 100])
def test_long_chain_needs_few_rounds(spark, monkeypatch, at_once):
    """A chain of 400 orders, replayed in the prefixes given: n / at_once rounds at most."""
    rounds, replay_round = [], orders.replay_earliest
    monkeypatch.setattr(orders, "replay_earliest", lambda *a: rounds.append(1) or replay_round(*a))
    cand, stock = chain(400, 1)
    expected, _ = replay(cand, stock)
    with_stock = spark.createDataFrame(cand, CANDIDATES).withColumn("stock", F.lit(1))
    refused = {r.order_id for r in orders.refused_orders(with_stock, at_once).collect()}
    assert refused == {o for o, ok in expected.items() if not ok} and len(refused) == 200
    assert len(rounds) <= max(1, 400 // at_once)


@pytest.mark.parametrize("at_once", [1, 7])
def test_short_prefixes_give_the_replay(spark, at_once):
    """Components larger than the prefix: several rounds, running sums between them."""
    cand, stock = random_orders(5, 2, 9, 40, 300)
    expected, _ = replay(cand, stock)
    rows = [(*c, stock.get((c[3], c[1]))) for c in cand]
    got = orders.refused_orders(spark.createDataFrame(rows, CANDIDATES + ", stock int"), at_once)
    assert {r.order_id for r in got.collect()} == {o for o, ok in expected.items() if not ok}


def test_conflict_components(spark):
    from mercato.operators import conflicts

    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5)]
    up = {n: n for e in edges for n in e}

    def find(n):
        return n if up[n] == n else find(up[n])

    for u, v in edges:
        up[max(find(u), find(v))] = min(find(u), find(v))
    got = conflicts.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted((r.node, r.label) for r in got) == sorted((n, find(n)) for n in up if any(n in e and e[0] != e[1] for e in edges))
    lines = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (2, 0, 2), (3, 0, 9), (4, 1, 2)], "order_id long, branch_id long, product_id long")
    group = {r.order_id: r.component for r in conflicts.conflict_groups(lines, 1).collect()}
    assert group[1] == group[2] and len(set(group.values())) == 3
    assert len(set(r.component for r in conflicts.conflict_groups(lines, 10).collect())) == 2


def test_branch_hours_at_the_time_of_the_request(spark):
    """A branch open from 10:00 to 12:00 local time: requests at 10:30 and at 12:30 on one day, another without a time."""
    req = spark.createDataFrame([(1, "cash", 9, dt.datetime(2024, 1, 1, 5, 30)), (2, "cash", 9, dt.datetime(2024, 1, 1, 7, 30)), (3, "cash", 9, None)],
                                "cart_id long, payment_type string, viewer_id long, requested_at timestamp")
    carts = spark.createDataFrame([(i, 1, 7, None) for i in (1, 2, 3)], "id long, merchant_id long, branch_id long, actor_id long")
    lines = spark.createDataFrame([(i, 5, 1, 0.0, []) for i in (1, 2, 3)],
                                  "cart_id long, product_id long, quantity int, applied_discount_amount double, addon_ids array<long>")
    products = spark.createDataFrame([(5, 1, "p", 10.0, False)], "id long, merchant_id long, name string, base_price double, track_inventory boolean")
    addons = spark.createDataFrame([], "id long, product_id long, name string, price double")
    stock = spark.createDataFrame([], "product_id long, branch_id long, quantity int")
    branches = spark.createDataFrame([(7, 1, 600, 720)], "id long, merchant_id long, opening_time_minutes int, closing_time_minutes int")
    flags = spark.createDataFrame([], "actor_id long, merchant_role_of long, customer_role_of long")
    out = orders.place_orders(req, carts, lines, products, addons, stock, branches, flags, dt.datetime(2024, 1, 1, 6, 0))
    assert {r.order_id for r in out["bills"].collect()} == {1, 3}
    assert [(r.cart_id, r.reason) for r in out["rejects"].collect()] == [(2, "branch_closed")]


def test_allocation_of_no_orders(spark):
    out = orders.allocate_stock(spark.createDataFrame([], CANDIDATES), spark.createDataFrame([(1, 0, 5)], STOCK))
    assert out["decisions"].count() == 0
    assert [tuple(r) for r in out["inventory"].collect()] == [(1, 0, 5)]


def test_orders_without_time_come_first(spark):
    t = dt.datetime(2024, 1, 1)
    cand = spark.createDataFrame([(1, 0, t, 7, 3), (2, 0, None, 7, 3)], CANDIDATES)
    out = orders.allocate_stock(cand, spark.createDataFrame([(7, 0, 4)], STOCK))
    assert {r.order_id: r.accepted for r in out["decisions"].collect()} == {1: False, 2: True}


def test_status_stream_matches_batch_fold(spark):
    from mercato.streaming import status_stream

    feed = status_stream.run_status_stream(spark, SF_SMALL)
    last = feed.groupBy("order_ref").agg(F.max_by("status_after", F.struct("ts", "event_id")).alias("final_status"),
                                         F.sum(F.col("applied").cast("int")).alias("n_applied"))
    fold = Q.QUERIES["status_fold"](spark, SF_SMALL).select("order_ref", "final_status", "n_applied")
    a = sorted((r.order_ref, r.final_status, r.n_applied) for r in last.collect())
    b = sorted((r.order_ref, r.final_status, r.n_applied) for r in fold.collect())
    assert a == b


def test_order_documents_are_shuffled_by_order_only(spark):
    """Items and addons are listed where their order lies; no shuffle deals them by product again."""
    from mercato.operators import orders

    bills = spark.createDataFrame([(1, 9.0), (2, 4.0), (3, 0.0)], "order_id long, total double")
    numbers = "quantity int, price double, base_amount double, addon_amount double, discount_amount double, tax_amount double, line_total double"
    lines = spark.createDataFrame([(o, p, f"p{p}", 1, *[1.0] * 6) for o, p in ((1, 8), (1, 7), (1, 7), (2, 7), (2, None))],
                                  f"order_id long, product_id long, product_name string, {numbers}")
    addons = spark.createDataFrame([(1, 7, 72, "b", 1.0, 1, 1.0), (1, 7, 71, "a", 1.0, 1, 1.0), (2, None, 5, "x", 1.0, 1, 1.0), (2, 7, 71, "a", 1.0, 2, 2.0)],
                                   "order_id long, product_id long, addon_id long, addon_name string, addon_price double, addon_quantity int, line_addon_total double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = orders.order_detail(bills, lines, addons)
        plan = docs._jdf.queryExecution().executedPlan().toString()
        got = {r.order_id: r["items"] and [(i.product_id, [a.id for a in i.addons]) for i in r["items"]] for r in docs.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {1: [(7, [71, 72]), (7, [71, 72]), (8, [])], 2: [(None, []), (7, [71])], 3: None}
    dealt = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert dealt and not any("product_id" in line.split("hashpartitioning(")[1].split(")")[0] for line in dealt)
