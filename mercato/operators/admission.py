"""Admission of a batch under several unique keys (Q1): the first to arrive holds a key.

Rows arrive one after another.  A row is accepted when none of its keys is held by a
stored row or by an accepted earlier row; a refused row holds nothing, so a row that is
refused by one key blocks nobody by another.  Whether a row is accepted can thus hang on
a long chain of earlier ones.

Most rows share no key and are accepted at once.  Of the others, those that come first
under all of their keys are accepted and take their keys from everybody else; this
settles hot keys by one minimum per key, in a partial aggregate.  That is done again
as long as it settles half of the open rows.  What is left, long chains, falls
into connected components of rows and keys.  The earliest rows of a component depend on
nothing later, so rounds replay the earliest ``at_once`` open rows of every component
one by one in a task of its own (components are not looked for when no more rows than
that are left).  ``at_once`` bounds that task's memory, not the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.operators.conflicts import components
from mercato.session import materialize

Uniques = Sequence[tuple[str, Sequence[str]]]
ORDER = ["_at", "_tie", "_hash", "_row"]  # of arrival


def _claims(rows: DataFrame, uniques: Uniques, *carried: str) -> DataFrame:
    """One row per row and unique constraint whose columns are all set: carried columns, ``n`` (place of the constraint), ``key``."""
    each = []
    for n, (_, cols) in enumerate(uniques):
        filled = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
        each.append(F.when(filled, F.struct(F.lit(n).alias("n"), F.to_json(F.struct(*cols)).alias("key"))))
    return rows.select(*carried, F.explode(F.filter(F.array(*each), lambda c: c.isNotNull())).alias("_c")).select(*carried, "_c.*")


def _replay(claims: pd.DataFrame) -> pd.DataFrame:
    """Admit the rows of one component one by one."""
    claims = claims.sort_values(ORDER, kind="stable")
    taken: set = set()
    rows, accepted = [], []
    for row, own in groupby(zip(claims["_row"].tolist(), claims["n"].tolist(), claims["key"].tolist()), key=itemgetter(0)):
        keys = [(n, key) for _, n, key in own]
        free = not any(k in taken for k in keys)
        if free:
            taken.update(keys)
        rows.append(row)
        accepted.append(free)
    return pd.DataFrame({"_row": rows, "accepted": accepted})


def _settle(open_claims: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys now held with the order of their holders, claims still open) after the rows ``accepted`` took their keys."""
    held = materialize(open_claims.join(accepted, "_row", "left_semi").select("n", "key", F.struct(*ORDER).alias("_holder")))
    refused = open_claims.join(held, ["n", "key"], "left_semi").select("_row")
    return held, materialize(open_claims.join(refused, "_row", "left_anti"))


def admit(batch: DataFrame, uniques: Uniques, arrived: str, tie: str, target: DataFrame | None = None,
          at_once: int = 20_000) -> DataFrame:
    """``batch`` with ``accepted`` and ``reason``, the first constraint in the given order whose key is held.

    ``uniques``: (constraint, columns) each; a NULL column never clashes.  Rows arrive
    by (``arrived``, ``tie``), a timestamp and a whole number, NULL first.  Rows equal in both
    come in the order of a hash of their columns; equal rows are interchangeable.
    ``target`` holds the stored rows with the same key columns.  Every row of the
    batch is returned once, whatever other columns it has.
    """
    columns = batch.columns
    unset = F.lit(-2 ** 63).cast("bigint")
    rows = materialize(batch.select(
        F.struct("*").alias("_b"), F.monotonically_increasing_id().alias("_row"), F.xxhash64("*").alias("_hash"),
        F.coalesce(F.unix_micros(F.col(arrived).cast("timestamp")), unset).alias("_at"),
        F.coalesce(F.col(tie).cast("bigint"), unset).alias("_tie")))
    claims = materialize(_claims(rows.select("_b.*", F.struct(*ORDER).alias("_o")), uniques, "_o").select("_o.*", "n", "key"))
    order = F.struct(*ORDER)

    still_open, stored = claims, None
    if target is not None:
        stored = _claims(target, uniques).select("n", "key")
        refused = materialize(claims.join(stored, ["n", "key"], "left_semi").select("_row", "n"))
        still_open = claims.join(refused, "_row", "left_anti")

    # first under every key it asks for; a row that shares no key is one of them
    held, before, n_open = [], None, still_open.select("_row").distinct().count()
    while before is None or (n_open > at_once and 2 * n_open <= before):
        first = still_open.groupBy("n", "key").agg(F.min(order).alias("_first"))
        leads = (still_open.join(first, ["n", "key"]).groupBy("_row").agg(F.min(F.col("_first") == order).alias("_all"))
                 .where("_all").select("_row"))
        before = n_open
        now_held, still_open = _settle(still_open, materialize(leads))
        held.append(now_held)
        n_open = still_open.select("_row").distinct().count()
    if n_open <= at_once:
        still_open = still_open.withColumn("component", F.lit(0))  # small enough to be replayed at once
    else:
        node = F.xxhash64("n", "key")
        least = still_open.groupBy("_row").agg(F.min(node).alias("u"))
        labels = components(still_open.join(least, "_row").select("u", node.alias("v"))).withColumnRenamed("node", "u")
        still_open = materialize(still_open.join(
            least.join(labels, "u", "left").select("_row", F.coalesce("label", "u").alias("component")), "_row"))
    by_time = Window.partitionBy("component").orderBy(*ORDER)
    while not still_open.isEmpty():
        earliest = (still_open.select("component", *ORDER).distinct().withColumn("_n", F.row_number().over(by_time))
                    .where(F.col("_n") <= at_once).select("_row"))
        # components share no key: a task replays as many as make up about ``at_once`` rows
        together = F.pmod(F.xxhash64("component"), F.lit(n_open // at_once + 1)).alias("together")
        replayed = materialize(still_open.join(earliest, "_row", "left_semi").select("*", together).groupBy("together")
                               .applyInPandas(_replay, "_row bigint, accepted boolean"))
        still_open = still_open.join(replayed.where("NOT accepted"), "_row", "left_anti")
        now_held, still_open = _settle(still_open, replayed.where("accepted"))
        held.append(now_held)

    # a key has one holder; a refused row may share another key with an accepted row that came later
    holders = reduce(DataFrame.unionByName, held)
    refusals = claims.join(holders, ["n", "key"]).where(F.col("_holder") < order).select("_row", "n")
    if stored is not None:
        refusals = refusals.unionByName(refused)
    names = F.array(*[F.lit(name) for name, _ in uniques])
    worst = refusals.groupBy("_row").agg((F.min("n") + 1).alias("_n"))
    return rows.join(worst, "_row", "left").select(
        *[F.col("_b")[c].alias(c) for c in columns], F.col("_n").isNull().alias("accepted"),
        F.when(F.col("_n").isNotNull(), F.element_at(names, F.col("_n"))).alias("reason"))
