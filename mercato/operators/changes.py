"""Batch changes (S4-S9): insert, upsert, keyed update, delete and cascades.

The reference changes one row per statement inside a transaction.  Here a
change is a batch DataFrame applied to a table snapshot, producing the next
snapshot (written by the caller as a new directory, then swapped in):

* ``append_rows`` fills defaults (ids derived from the row's natural key,
  timestamps from an explicit ``as_of``) so a re-run gives the same rows;
* ``upsert`` keeps the last batch row per key (``max_by`` on a sequence column,
  aggregated map-side) and full-outer-joins it onto the target;
* ``update_by_key`` / ``delete_by_key`` are a left join / anti join;
* ``cascade_delete`` follows the foreign-key edges from each delete request: CASCADE removes
  children, SET NULL clears them, RESTRICT refuses the request.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.session import materialize
from mercato.sources import bucketed


def derived_id(*cols) -> "F.Column":
    """Deterministic 64-bit id from natural-key columns (stands in for gen_random_uuid)."""
    return F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols])


def append_rows(target: DataFrame, batch: DataFrame, as_of, defaults: dict | None = None,
                id_from: Sequence[str] | None = None, time_cols: Sequence[str] = ("created_at",)) -> DataFrame:
    """Target plus the batch, with defaults for missing columns (ids, timestamps, flags)."""
    b = batch
    if id_from and "id" not in b.columns:
        b = b.withColumn("id", derived_id(*id_from))
    for c in time_cols:
        if c in target.columns and c not in b.columns:
            b = b.withColumn(c, F.lit(as_of).cast("timestamp"))
    for c, v in (defaults or {}).items():
        if c not in b.columns:
            b = b.withColumn(c, F.lit(v))
    for f in target.schema.fields:
        if f.name in b.columns:
            b = b.withColumn(f.name, F.col(f.name).cast(f.dataType))
    return target.unionByName(b.select(*[c for c in target.columns if c in b.columns]), allowMissingColumns=True)


_FIXED_WIDTH = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)


def latest_per_key(batch: DataFrame, keys: Sequence[str], seq_col: str) -> DataFrame:
    """Last batch row per key by ``seq_col`` (a partial aggregate, no window sort).

    Fixed-width columns each take their own ``max_by`` so the aggregation buffer
    stays fixed-width (hash aggregate); other columns travel together in one struct.
    """
    others = [f for f in batch.schema.fields if f.name not in keys]
    fixed = [f.name for f in others if isinstance(f.dataType, _FIXED_WIDTH)]
    rest = [f.name for f in others if f.name not in fixed]
    aggs = [F.max_by(F.col(c), F.col(seq_col)).alias(c) for c in fixed if c != seq_col]
    aggs.append(F.max(seq_col).alias(seq_col))
    if rest:
        aggs.append(F.max_by(F.struct(*rest), F.col(seq_col)).alias("_rest"))
    agg = batch.groupBy(*keys).agg(*aggs)
    return agg.select(*keys, *[F.col(f"_rest.{c}").alias(c) if c in rest else F.col(c) for c in (f.name for f in others)])


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], set_cols: Sequence[str], seq_col: str,
           touch_col: str | None = None, as_of=None, created_col: str | None = None, id_col: str | None = None) -> DataFrame:
    """ON CONFLICT (keys) DO UPDATE SET set_cols; new keys are inserted.

    Output is the new snapshot with an ``action`` column: inserted / updated / unchanged.
    The target keeps its other columns (id, created_at) on update.  An inserted row gets
    ``as_of`` in ``created_col`` and in ``touch_col``, and an id derived from its keys in ``id_col``.
    """
    last = latest_per_key(batch, keys, seq_col).select(*keys, *[F.col(c).alias(f"_new_{c}") for c in set_cols])
    t = target.withColumn("_in_target", F.lit(True))
    j = t.join(last.withColumn("_in_batch", F.lit(True)), list(keys), "full")
    in_t, in_b = F.coalesce("_in_target", F.lit(False)), F.coalesce("_in_batch", F.lit(False))
    on_insert = {created_col: F.lit(as_of).cast("timestamp"), id_col: derived_id(*keys)}
    cols = []
    for c in target.columns:
        if c in keys:
            cols.append(F.col(c))
        elif c in on_insert:
            cols.append(F.when(in_b & ~in_t, on_insert[c]).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c))
        elif c in set_cols:
            cols.append(F.when(in_b, F.col(f"_new_{c}")).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c))
        elif touch_col and c == touch_col:
            cols.append(F.when(in_b, F.lit(as_of).cast("timestamp")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    action = F.when(in_b & ~in_t, "inserted").when(in_b, "updated").otherwise("unchanged")
    return j.select(*cols, action.alias("action"))


#: Conflict keys and updated columns of the tables that are upserted; ``touch``: set to the time of the change.
CONFLICTS = {
    "actor_roles": {"keys": ["merchant_id", "actor_id"], "set_cols": ["role_type"], "touch_col": "assigned_at"},
    "product_inventory": {"keys": ["product_id", "branch_id"], "set_cols": ["quantity"], "touch_col": "updated_at"},
    "order_items": {"keys": ["order_id", "product_id"],
                    "set_cols": ["quantity", "price", "base_amount", "addon_amount", "discount_amount", "tax_amount", "line_total"]},
    "order_item_addons": {"keys": ["order_id", "product_id", "addon_id"],
                          "set_cols": ["addon_name", "addon_price", "quantity", "line_addon_total"]},
    "vat_rules": {"keys": ["merchant_id", "payment_type"], "set_cols": ["rate"], "created_col": "created_at", "id_col": "id"},
}


def upsert_into(spark: SparkSession, path: str, table: str, batch: DataFrame, seq_col: str, as_of=None) -> DataFrame:
    """S5 on a table of ``CONFLICTS`` laid out by ``bucketed.create`` over its keys: only buckets of the batch are read and rewritten.

    Returns the batch's keys with their ``action`` (inserted / updated).  Applied again, the batch gives the same table.
    """
    rule = CONFLICTS[table]
    last = materialize(bucketed.with_bucket(spark, path, latest_per_key(batch, rule["keys"], seq_col)))
    target = bucketed.read(spark, path, bucketed.touched(last)).drop(bucketed.BUCKET)
    new = materialize(upsert(target, last, seq_col=seq_col, as_of=as_of, **rule))
    bucketed.replace(spark, path, bucketed.with_bucket(spark, path, new.drop("action")), aside=True)
    return new.where("action <> 'unchanged'").select(*rule["keys"], "action")


def update_by_key(target: DataFrame, batch: DataFrame, keys: Sequence[str], touch_col: str | None = None,
                  as_of=None, seq_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Full-column update of rows matched by key; unmatched batch keys are returned as not found.

    Of repeated batch keys the row with the largest ``seq_col`` holds (without
    one, the largest row by its other columns), so every target row stays single.
    """
    if seq_col:
        batch = latest_per_key(batch, keys, seq_col).drop(seq_col)
    else:
        rest = [c for c in batch.columns if c not in keys]
        batch = batch.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row")).select(*keys, "_row.*") if rest else batch.distinct()
    upd_cols = [c for c in batch.columns if c not in keys]
    b = batch.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in upd_cols], F.lit(True).alias("_hit"))
    j = target.join(b, list(keys), "left")
    hit = F.coalesce("_hit", F.lit(False))
    cols = []
    for c in target.columns:
        if c in upd_cols:
            cols.append(F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c))
        elif touch_col and c == touch_col:
            cols.append(F.when(hit, F.lit(as_of).cast("timestamp")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    updated = j.select(*cols, hit.alias("updated"))
    not_found = batch.join(target.select(*keys), list(keys), "left_anti")
    return updated, not_found


def delete_by_key(target: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(remaining rows, deleted rows, keys that matched nothing -> not found)."""
    k = keys_df.select(*keys).distinct()
    remaining = target.join(k, list(keys), "left_anti")
    deleted = target.join(k, list(keys), "left_semi")
    not_found = k.join(target.select(*keys), list(keys), "left_anti")
    return remaining, deleted, not_found


def insert_then_enrich(target: DataFrame, batch: DataFrame, as_of, enrich: DataFrame, on: Sequence[str],
                       id_from: Sequence[str]) -> DataFrame:
    """The rows to insert (S4) joined with ``enrich`` (e.g. actor e-mail); rows without a match are not returned."""
    b = batch.withColumn("id", derived_id(*id_from)) if "id" not in batch.columns else batch
    if "created_at" in target.columns and "created_at" not in b.columns:
        b = b.withColumn("created_at", F.lit(as_of).cast("timestamp"))
    return b.join(enrich, list(on))


def cascade_delete(root: str, requests: DataFrame, tables: dict[str, tuple[DataFrame, Sequence[str]]], edges: Sequence[dict]) -> dict:
    """Delete the requested rows of table ``root`` and follow the ON DELETE rules.

    ``requests``: key columns of ``root``, one delete request per row.  ``tables``
    maps a name to (rows, key columns), parents before children.  An edge is a dict
    ``{"child", "child_cols", "parent", "parent_cols", "rule"}`` with the rule cascade,
    set_null (``"clear"``: the columns to clear, by default ``child_cols``) or restrict.

    Every row that a request reaches carries the request along, over all paths to it.
    A restrict edge that finds a row vetoes its request, even if that row would go by
    the same request.  Each request is judged against the tables as given; a row goes
    if some request without a veto reaches it.

    Returns ``rejected`` (request keys, ``blocked_by``: child table, ``n_blocking`` rows),
    and per table ``deleted``, ``cleared`` (rows as they were) and ``remaining`` (the resulting table).
    """
    key = tables[root][1]
    ids = [f"_request_{k}" for k in key]
    asked = requests.select(*key).distinct().select("*", *[F.col(k).alias(i) for k, i in zip(key, ids)])

    def reached_by(edge: dict, reached: dict[str, DataFrame]) -> DataFrame:
        """Rows of the child that refer to a reached row of the parent, once per request."""
        parent = reached[edge["parent"]].select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(edge["parent_cols"])], *ids).distinct()
        child = tables[edge["child"]][0]
        on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(edge["child_cols"])])
        return child.join(parent, on).select(*child.columns, *ids)

    reached: dict[str, DataFrame] = {}
    for name, (rows, cols) in tables.items():
        parts = [reached_by(e, reached) for e in edges if e["child"] == name and e["rule"] == "cascade" and e["parent"] in reached]
        parts += [rows.join(asked, list(key))] if name == root else []
        if parts:  # several paths to a row are one
            reached[name] = materialize(reduce(DataFrame.unionByName, parts).dropDuplicates([*cols, *ids]))
    no_row = asked.select(*ids, F.lit("").alias("blocked_by"), F.lit(0).cast("long").alias("n_blocking")).limit(0)
    blocked = [reached_by(e, reached).groupBy(*ids).agg(F.count(F.lit(1)).alias("n_blocking")).withColumn("blocked_by", F.lit(e["child"]))
               for e in edges if e["rule"] == "restrict" and e["parent"] in reached]
    vetoes = materialize(reduce(DataFrame.unionByName, blocked, no_row).groupBy(*ids, "blocked_by").agg(F.sum("n_blocking").alias("n_blocking")))
    free = {name: rows.join(vetoes, ids, "left_anti") for name, rows in reached.items()}
    gone = {name: free[name].dropDuplicates(list(tables[name][1])).drop(*ids) for name in reached}
    out = {}
    for name, (rows, cols) in tables.items():
        left = rows.join(gone[name].select(*cols), list(cols), "left_anti") if name in gone else rows
        cleared = []
        for n, e in enumerate(e for e in edges if e["child"] == name and e["rule"] == "set_null" and e["parent"] in gone):
            hit = gone[e["parent"]].select(*[F.col(p).alias(c) for c, p in zip(e["child_cols"], e["parent_cols"])]).distinct().withColumn(f"_hit{n}", F.lit(True))
            left = left.join(hit, list(e["child_cols"]), "left")
            cleared.append((f"_hit{n}", e.get("clear", e["child_cols"])))
        wipe = {c: F.when(reduce(lambda a, b: a | b, [F.coalesce(F.col(h), F.lit(False)) for h, cs in cleared if c in cs]), None).otherwise(F.col(c))
                for c in {c for _, cs in cleared for c in cs}}
        was = left.where(reduce(lambda a, b: a | b, [F.col(h).isNotNull() for h, _ in cleared])) if cleared else left.limit(0)
        out[name] = {"deleted": gone.get(name, rows.limit(0)), "cleared": was.select(*rows.columns), "remaining": left.withColumns(wipe).select(*rows.columns)}
    return {"rejected": vetoes.select(*[F.col(i).alias(k) for i, k in zip(ids, key)], "blocked_by", "n_blocking"), "tables": out}
