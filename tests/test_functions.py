"""Hand cases: the reference's unit tests and rules worked from its code (FIXTURES.md part 3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mercato.functions import arrays, clock, money, names
from mercato.operators import discounts, orders


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("text,minutes", [("09:00", 540), ("22:30", 1350), ("00:00", 0), ("23:59", 1439),
                                          ("25:00", None), ("not-a-time", None), ("9:05", 545), ("09:5", None)])
def test_parse_clock(spark, text, minutes):
    assert one(spark, clock.parse_clock(F.lit(text))) == minutes


@pytest.mark.parametrize("minutes,text", [(540, "09:00"), (1350, "22:30"), (0, "00:00"), (-5, "00:00"), (1500, "01:00")])
def test_format_clock(spark, minutes, text):
    assert one(spark, clock.format_clock(F.lit(minutes))) == text


def _open(spark, o, c, karachi_hhmm):
    h, m = map(int, karachi_hhmm.split(":"))
    utc = dt.datetime(2024, 1, 20, h, m) - dt.timedelta(hours=5)
    ts = F.lit(utc.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    return one(spark, clock.is_open(F.lit(o), F.lit(c), ts))


@pytest.mark.parametrize("t,expected", [("14:00", True), ("09:00", True), ("22:29", True), ("22:30", False),
                                        ("22:59", False), ("08:00", False), ("23:30", False)])
def test_open_same_day(spark, t, expected):
    assert _open(spark, 540, 1350, t) is expected


@pytest.mark.parametrize("t,expected", [("23:00", True), ("01:00", True), ("03:00", False), ("21:00", False)])
def test_open_overnight(spark, t, expected):
    assert _open(spark, 1320, 120, t) is expected


def test_open_all_day(spark):
    assert _open(spark, 600, 600, "03:17") is True


@pytest.mark.parametrize("x,expected", [(1.005, 1.0), (0.025, 0.03), (10.0, 10.0), (-0.025, -0.03), (2.675, 2.68)])
def test_round2(spark, x, expected):
    # half away from zero on x*100 in double precision (2.675*100 = 267.49999999999997 -> 267)
    import math
    go = math.floor(abs(x) * 100 + 0.5) / 100 * (1 if x >= 0 else -1)
    assert one(spark, money.round2(F.lit(x))) == pytest.approx(go)
    if x != 2.675:
        assert one(spark, money.round2(F.lit(x))) == pytest.approx(expected)


@pytest.mark.parametrize("dtype,value,sub,expected", [("percentage", 15, 99.99, 15.0), ("flat", 50, 20.0, 20.0),
                                                      ("flat", 5, 20.0, 5.0), ("percentage", 150, 10.0, 15.0)])
def test_discount_amount(spark, dtype, value, sub, expected):
    assert one(spark, discounts.discount_amount(F.lit(dtype), F.lit(value), F.lit(sub))) == pytest.approx(expected)


def test_normalize_addon_ids(spark):
    got = one(spark, arrays.normalize_addon_ids(F.array(F.lit(12), F.lit(9), F.lit(0), F.lit(12), F.lit(None).cast("int"))))
    assert got == [12, 9]  # text order: "12" < "9"


def test_split_full_name(spark):
    row = spark.range(1).select(names.first_name(F.lit("  Ada  Mary King ")).alias("f"),
                                names.last_name(F.lit("  Ada  Mary King ")).alias("l")).first()
    assert (row.f, row.l) == ("Ada", "Mary King")
    row = spark.range(1).select(names.first_name(F.lit("   ")).alias("f"), names.last_name(F.lit("Solo")).alias("l")).first()
    assert (row.f, row.l) == ("", "")


@pytest.mark.parametrize("rate,sub,tax,total", [(8.0, 20.0, 1.6, 21.6), (15.0, 20.0, 3.0, 23.0)])
def test_line_bill(spark, rate, sub, tax, total):
    df = spark.createDataFrame([(2, 10.0, 3.0, 3.0, rate)], "q int, p double, addon double, disc double, rate double")
    cols = orders.order_line_amounts("q", "p", "addon", "disc", "rate")
    row = df.select(*[c.alias(k) for k, c in cols.items()]).first()
    assert (row.line_subtotal, row.tax_amount, row.line_total) == (sub, tax, total)


@pytest.mark.parametrize("frm,to,ok", [("pending", "delivered", False), ("delivered", "refunded", True),
                                       ("pending", "pending", False), ("out_for_delivery", "cancelled", True),
                                       ("cancelled", "accepted", False)])
def test_status_transition(spark, frm, to, ok):
    assert one(spark, orders.check_status_transition(F.lit(frm), F.lit(to))) is ok


def test_status_fold_rejected_keeps_state(spark):
    rows = [("o1", dt.datetime(2024, 1, 1, 0, 0, 1), 1, "delivered"),   # rejected from pending
            ("o1", dt.datetime(2024, 1, 1, 0, 0, 2), 2, "accepted"),
            ("o1", dt.datetime(2024, 1, 1, 3, 0, 0), 3, "out_for_delivery"),  # other hour bucket
            ("o1", dt.datetime(2024, 1, 1, 3, 0, 1), 4, "accepted"),    # rejected
            ("o2", dt.datetime(2024, 1, 1, 0, 0, 1), 5, "cancelled"),
            ("o2", dt.datetime(2024, 1, 1, 0, 0, 2), 6, "accepted")]    # rejected: cancelled is final
    df = spark.createDataFrame(rows, "order_ref string, ts timestamp, event_id long, requested_status string")
    got = {r.order_ref: (r.final_status, r.n_applied, r.n_rejected) for r in orders.apply_status_changes(df).collect()}
    assert got == {"o1": ("out_for_delivery", 2, 2), "o2": ("cancelled", 1, 1)}


def test_status_fold_matches_sequential_replay(spark):
    # random request sequences spread over seconds to days: the bucketed composition must equal a plain replay
    import random

    rng = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    rows, expected = [], {}
    eid = 0
    for o in range(150):
        n = rng.randint(1, 25)
        reqs = []
        for _ in range(n):
            eid += 1
            offset = rng.choice([rng.randint(0, 59), rng.randint(0, 3600 * 5), rng.randint(0, 86400 * 3)])
            reqs.append((base + dt.timedelta(seconds=offset), eid, rng.choice(orders.STATUSES)))
        state, applied = orders.INITIAL_STATUS, 0
        for ts, e, to in sorted(reqs):
            if to in orders.ALLOWED_TRANSITIONS.get(state, ()):
                state, applied = to, applied + 1
        expected[f"o{o}"] = (state, n, applied)
        rows += [(f"o{o}", ts, e, to) for ts, e, to in reqs]
    df = spark.createDataFrame(rows, "order_ref string, ts timestamp, event_id long, requested_status string")
    got = {r.order_ref: (r.final_status, r.n_requests, r.n_applied) for r in orders.apply_status_changes(df).collect()}
    assert got == expected


def test_null_helpers(spark):
    from mercato.functions import nulls

    row = spark.range(1).select(
        nulls.zero_id_to_null(F.lit(nulls.ZERO_UUID)).alias("a"), nulls.zero_id_to_null(F.lit(0), 0).alias("b"),
        nulls.null_to_default(F.lit(None).cast("string"), "").alias("c"),
        nulls.unset_time(F.lit("0001-01-01 00:00:00").cast("timestamp")).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (None, None, "", None)


def test_best_per_group_picks_newest_then_lowest_id(spark):
    from mercato.operators.common import best_per_group

    df = spark.createDataFrame([(1, 10, 5), (1, 11, 7), (1, 9, 7), (2, 3, 1)], "k int, id int, created int")
    got = {r.k: r.id for r in best_per_group(df, ["k"], [F.desc("created"), F.asc("id")]).collect()}
    assert got == {1: 9, 2: 3}
