"""Serial decisions without one round per link of a chain (used by B5).

Orders conflict when they ask for the same (branch, product) and the stock does not
serve all.  ``conflict_groups`` labels the connected components of these conflicts.
Orders of different components cannot influence one another, and in a component the
earliest ones depend on nothing later.  So ``replay_earliest`` takes the earliest
``at_once`` open orders of every component and serves them one by one in a task of
its own.  ``at_once`` bounds the memory of that task, not the result; a chain of k
orders needs k / at_once rounds.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of the nodes of ``edges`` (u, v, long): the least node that can be reached.

    Large-star and small-star steps in turn; the number of steps grows with the
    logarithm of the longest chain.  Each step is written as a table, the driver
    sees its size and a checksum.
    """
    def state_of(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    stars = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before, now = None, state_of(stars)
    while now != before:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, now = now, state_of(stars)
    roots = stars.select(F.col("v").alias("node")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots.select("node", F.col("node").alias("label")))


def conflict_groups(lines: DataFrame, at_once: int) -> DataFrame:
    """``order_id, component`` of the orders of ``lines`` (order_id, branch_id, product_id).

    While no branch has more than ``at_once`` orders the branch itself is the
    component: it holds whole components and is small enough.  Keys are hashes;
    two that collide make one larger component, which is right as well.
    """
    most = lines.groupBy("branch_id").agg(F.count_distinct("order_id").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= at_once:
        return lines.select("order_id", F.xxhash64("branch_id").alias("component")).distinct()
    asked = lines.groupBy("order_id").agg(F.min(F.xxhash64("branch_id", "product_id")).alias("u"))
    edges = lines.join(asked, "order_id").select("u", F.xxhash64("branch_id", "product_id").alias("v"))
    labels = components(edges)
    return asked.join(labels.withColumnRenamed("node", "u"), "u", "left").select("order_id", F.coalesce("label", "u").alias("component"))


def _replay(lines: pd.DataFrame) -> pd.DataFrame:
    """Serve the orders of one component by (ts, order_id): all lines or none."""
    lines = lines.sort_values(["ts", "order_id"], kind="stable")
    left: dict[tuple, int] = {}
    orders, served = [], []
    for order, own in _runs(lines["order_id"].tolist()):
        part = [((b, p), q) for b, p, q in zip(*(lines[c].iloc[own].tolist() for c in ("branch_id", "product_id", "quantity")))]
        for (key, _), stock in zip(part, lines["left"].iloc[own].tolist()):
            left.setdefault(key, stock)
        ok = all(left[key] >= q for key, q in part)
        if ok:
            for key, q in part:
                left[key] -= q
        orders.append(order)
        served.append(ok)
    return pd.DataFrame({"order_id": orders, "served": served})


def _runs(keys: list) -> list[tuple[object, slice]]:
    """(key, slice) of the runs of equal neighbours."""
    starts = [i for i, k in enumerate(keys) if i == 0 or k != keys[i - 1]]
    return [(keys[a], slice(a, b)) for a, b in zip(starts, [*starts[1:], len(keys)])]


def replay_earliest(lines: DataFrame, at_once: int) -> DataFrame:
    """``order_id, served`` of the earliest ``at_once`` orders of every component.

    ``lines``: order_id, component, branch_id, ts, product_id, quantity, left (the
    stock less what accepted orders use).  An accepted order that comes later than
    an open one was accepted with all earlier open demand set aside, so that taking
    it off first refuses nobody.
    """
    by_time = Window.partitionBy("component").orderBy("ts", "order_id")
    first = (lines.select("order_id", "component", "ts").distinct().withColumn("_n", F.row_number().over(by_time))
             .where(F.col("_n") <= at_once).select("order_id"))
    order_type = lines.schema["order_id"].dataType.simpleString()
    earliest = lines.join(first, "order_id").withColumn("ts", F.unix_micros("ts"))  # pandas holds no year 1
    return earliest.groupBy("component").applyInPandas(_replay, f"order_id {order_type}, served boolean")
