"""Property tests: Spark column rules against plain-Python statements of the reference's rules.

Each property draws a batch of inputs with hypothesis and checks them in one Spark job.
"""

import math
import re
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mercato.functions import arrays, clock, money


def go_round2(x: float) -> float:
    # math.Round(x*100)/100: the double x*100 rounded half away from zero on its exact binary value
    y = x * 100
    r = float(Decimal(y).quantize(Decimal(1), rounding=ROUND_HALF_UP))
    return math.copysign(r, y) / 100 if r == 0 else r / 100


def go_clock(text: str):
    m = re.fullmatch(r"([0-9]{1,2}):([0-9]{2})", text)
    if not m:
        return None
    h, mi = int(m.group(1)), int(m.group(2))
    return h * 60 + mi if h <= 23 and mi <= 59 else None


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False),
                          st.integers(min_value=-10**7, max_value=10**7).map(lambda n: n / 1000),
                          st.sampled_from([0.004999999999999999, 1.005, 2.675, -0.025, 0.0049999999999999994])),
                min_size=50, max_size=50))
def test_round2_matches_reference_rule(spark, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = {r.i: r.v for r in df.select("i", money.round2("x").alias("v")).collect()}
    for i, x in enumerate(xs):
        assert got[i] == go_round2(x), (x, got[i], go_round2(x))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.one_of(st.none(), st.integers(min_value=0, max_value=2000)), max_size=6), min_size=30, max_size=30))
def test_addon_normalisation_matches_reference_rule(spark, arrs):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrs)], "i int, a array<bigint>")
    got = {r.i: list(r.v) for r in df.select("i", arrays.normalize_addon_ids("a").alias("v")).collect()}
    for i, a in enumerate(arrs):
        kept = []
        for x in a:
            if x is not None and x != 0 and x not in kept:
                kept.append(x)
        assert got[i] == sorted(kept, key=str)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(
    st.from_regex(r"\A[0-9]{1,3}:[0-9]{1,3}\Z"), st.text(alphabet="0123456789: ab", max_size=6)), min_size=40, max_size=40))
def test_clock_parse_matches_reference_rule(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", clock.parse_clock(F.col("t")).cast("int").alias("v")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == go_clock(t), (t, got[i])


def go_is_open(o: int, c: int, now: int) -> bool:
    if o == c:
        return True
    if o < c:
        return o <= now < c
    return now >= o or now < c


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1439), st.integers(0, 1439), st.integers(0, 1439)), min_size=60, max_size=60))
def test_is_open_matches_reference_rule(spark, cases):
    import datetime as dt

    base = dt.datetime(2024, 1, 20) - dt.timedelta(hours=5)  # local Karachi midnight in UTC
    rows = [(i, o, c, base + dt.timedelta(minutes=m)) for i, (o, c, m) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, o int, c int, ts timestamp")
    got = {r.i: r.v for r in df.select("i", clock.is_open("o", "c", "ts").alias("v")).collect()}
    for i, (o, c, m) in enumerate(cases):
        assert got[i] == go_is_open(o, c, m), (o, c, m)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["percentage", "flat"]), st.integers(0, 20000), st.integers(0, 10**7)),
                min_size=60, max_size=60))
def test_discount_amount_matches_reference_rule(spark, cases):
    from mercato.operators import discounts

    rows = [(i, t, v / 100, s / 100) for i, (t, v, s) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, t string, v double, s double")
    got = {r.i: r.a for r in df.select("i", discounts.discount_amount("t", "v", "s").alias("a")).collect()}
    for i, t, v, s in rows:
        want = go_round2(s * v / 100) if t == "percentage" else go_round2(s if v > s else v)
        assert got[i] == want, (t, v, s, got[i], want)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=" \tabcXY", max_size=12), min_size=40, max_size=40))
def test_split_full_name_matches_reference_rule(spark, names_):
    from mercato.functions import names

    df = spark.createDataFrame([(i, n) for i, n in enumerate(names_)], "i int, n string")
    got = {r.i: (r.f, r.l) for r in df.select("i", names.first_name("n").alias("f"), names.last_name("n").alias("l")).collect()}
    for i, n in enumerate(names_):
        parts = n.split()
        assert got[i] == ((parts[0] if parts else ""), " ".join(parts[1:])), repr(n)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-3000, 5000), min_size=40, max_size=40))
def test_format_clock_matches_reference_rule(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, m int")
    got = {r.i: r.t for r in df.select("i", clock.format_clock("m").alias("t")).collect()}
    for i, v in enumerate(values):
        m = max(v, 0) % 1440
        assert got[i] == f"{m // 60:02d}:{m % 60:02d}"
