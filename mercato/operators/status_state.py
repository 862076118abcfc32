"""B10, kept up to date: the status fold as stored transition functions per order and time bucket.

``orders.apply_status_changes`` folds all requests anew.  Here its parts are kept: the
requests of each (order, minute) with the function they make together, and the
composed functions per (order, hour), (order, day) and order.  A batch of requests,
however late, changes its own minutes; from there only the hours, days and orders above
those are composed again.  Each level is a table in hash buckets of (order, next coarser time), so
a busy order is spread over buckets, what is composed lies together, and a batch
rewrites only the buckets that it reaches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.operators import orders
from mercato.session import materialize
from mercato.sources import bucketed

LEVELS = ("minute", "hour", "day", "order")
_KEYS = ["order_ref", "at"]


def _coarser(level: str) -> Column:
    """Time of the bucket one level above; an order has one for all time."""
    up = LEVELS[LEVELS.index(level) + 1] if level != "order" else "order"
    return F.lit(0).cast("timestamp") if up == "order" else F.date_trunc(up, "at")


def _minutes(requests: DataFrame) -> DataFrame:
    """``order_ref, at, up, requests, n, fn`` per (order, minute); a request delivered twice counts once."""
    listed = requests.groupBy("order_ref", "at").agg(F.array_sort(F.collect_set(F.struct("ts", "event_id", "t"))).alias("requests"))
    fn = F.aggregate("requests", orders._identity(), lambda acc, r: orders._apply_request(acc, r["t"]))
    return listed.select("order_ref", "at", _coarser("minute").alias("up"), "requests", F.size("requests").cast("long").alias("n"), fn.alias("fn"))


def _composed(parts: DataFrame, level: str) -> DataFrame:
    """``order_ref, at, up, n, fn`` of a level from the parts of the level below (``at`` is their ``up``)."""
    listed = parts.groupBy("order_ref", F.col("up").alias("_up")).agg(
        F.array_sort(F.collect_list(F.struct("at", "fn"))).alias("parts"), F.sum("n").alias("n"))
    fn = F.aggregate("parts", orders._identity(), lambda acc, p: orders._compose(acc, p["fn"]))
    return listed.select("order_ref", F.col("_up").alias("at"), "n", fn.alias("fn")).select("order_ref", "at", _coarser(level).alias("up"), "n", "fn")


def _requests(requests: DataFrame) -> DataFrame:
    return requests.select("order_ref", F.date_trunc("minute", "ts").alias("at"), "ts", "event_id", orders._status_index(F.col("requested_status")).alias("t"))


def create(requests: DataFrame, path: str, n_buckets: int = 4096) -> None:
    """Fold ``requests`` (order_ref, ts, event_id, requested_status) into new tables under ``path``."""
    parts = materialize(_minutes(_requests(requests)))
    for level in LEVELS:
        parts = parts if level == "minute" else materialize(_composed(parts, level))
        bucketed.create(parts, f"{path}/{level}", ["order_ref", "up"], n_buckets)


def add(spark: SparkSession, path: str, requests: DataFrame) -> None:
    """Add a batch of requests, early or late, in any order.  A batch added again changes nothing."""
    new = materialize(bucketed.with_bucket(spark, f"{path}/minute", _requests(requests).withColumn("up", _coarser("minute"))))
    old = bucketed.read(spark, f"{path}/minute", bucketed.touched(new)).join(new.select(*_KEYS).distinct(), _KEYS, "left_semi")
    known = old.select("order_ref", "at", F.inline("requests"))
    changed = materialize(_minutes(known.unionByName(new.select(*known.columns))))
    bucketed.put(spark, f"{path}/minute", changed, _KEYS)
    for below, level in zip(LEVELS, LEVELS[1:]):
        above = materialize(bucketed.with_bucket(spark, f"{path}/{below}", changed.select("order_ref", "up").distinct()))
        parts = bucketed.read(spark, f"{path}/{below}", bucketed.touched(above)).join(above.select("order_ref", "up"), ["order_ref", "up"], "left_semi")
        changed = materialize(_composed(parts, level))
        bucketed.put(spark, f"{path}/{level}", changed, _KEYS)


def states(spark: SparkSession, path: str, order_refs: Sequence[str] | None = None) -> DataFrame:
    """Final status and counts per order, as ``orders.apply_status_changes`` gives them."""
    top = bucketed.read(spark, f"{path}/order")
    return orders.folded(top if order_refs is None else top.where(F.col("order_ref").isin(list(order_refs))), "order_ref", "fn", "n")
