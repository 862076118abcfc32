"""Tables in buckets, upserts and status folds that touch only their own buckets, order tables by month."""

import datetime as dt
import random

import pytest

from mercato.operators import changes, orders, status_state
from mercato.session import scratch_path
from mercato.sources import bucketed, files, monthly

AS_OF = "2024-01-20 00:00:00"


def files_by_bucket(spark, path):
    return {n: {f for f in files.names(spark, f"{path}/{n}") if f.endswith(".parquet")} for n in files.names(spark, path) if n.startswith("bucket=")}


def test_upsert_leaves_other_buckets_alone(spark):
    path = scratch_path(spark, "t")
    target = spark.range(200).selectExpr("id AS product_id", "id % 3 AS branch_id", "CAST(id AS INT) AS quantity", "TIMESTAMP '2024-01-01 00:00:00' AS updated_at")
    bucketed.create(target, path, ["product_id", "branch_id"], 16)
    before = files_by_bucket(spark, path)
    batch = spark.createDataFrame([(5, 2, 1, 1), (5, 2, 77, 2), (900, 0, 9, 1)], "product_id long, branch_id long, quantity int, seq long")
    for _ in range(2):  # a batch applied again gives the same table
        got = {tuple(r) for r in changes.upsert_into(spark, path, "product_inventory", batch, "seq", AS_OF).collect()}
        now = {(r.product_id, r.branch_id, r.quantity, r.updated_at) for r in bucketed.read(spark, path).collect()}
        full = changes.upsert(target, batch, ["product_id", "branch_id"], ["quantity"], "seq", touch_col="updated_at", as_of=AS_OF).drop("action")
        assert now == {tuple(r) for r in full.collect()} and len(now) == 201
    assert got == {(5, 2, "updated"), (900, 0, "updated")}
    after = files_by_bucket(spark, path)
    hit = set(bucketed.touched(bucketed.with_bucket(spark, path, batch)))
    same = {b for b in before if after[b] == before[b]}
    assert same == {b for b in before if int(b.split("=")[1]) not in hit}


def test_empty_batch_changes_nothing(spark):
    path = scratch_path(spark, "t")
    bucketed.create(spark.range(5).selectExpr("id AS product_id", "id AS branch_id", "1 AS quantity"), path, ["product_id", "branch_id"], 4)
    before = files_by_bucket(spark, path)
    none = spark.createDataFrame([], "product_id long, branch_id long, quantity int, seq long")
    assert changes.upsert_into(spark, path, "product_inventory", none, "seq", AS_OF).count() == 0
    assert files_by_bucket(spark, path) == before and bucketed.read(spark, path).count() == 5


@pytest.mark.parametrize("table", sorted(changes.CONFLICTS))
def test_every_conflict_key(spark, table):
    rule = changes.CONFLICTS[table]
    plain = [*rule["keys"], *rule["set_cols"]]
    extra = [c for c in (rule.get("id_col"), rule.get("created_col"), rule.get("touch_col")) if c]
    types = ", ".join([f"{c} string" for c in plain] + [f"{c} {'long' if c == 'id' else 'timestamp'}" for c in extra])
    first = dt.datetime(2024, 1, 1)
    old = [tuple([k] * len(rule["keys"]) + ["old"] * len(rule["set_cols"]) + [7 if c == "id" else first for c in extra]) for k in "ab"]
    path = scratch_path(spark, "t")
    bucketed.create(spark.createDataFrame(old, types), path, rule["keys"], 4)
    batch = spark.createDataFrame([tuple([k] * len(rule["keys"]) + [v] * len(rule["set_cols"]) + [n]) for n, (k, v) in enumerate([("b", "x"), ("b", "new"), ("c", "new")])],
                                  ", ".join([f"{c} string" for c in plain] + ["seq int"]))
    actions = {r[0]: r.action for r in changes.upsert_into(spark, path, table, batch, "seq", AS_OF).collect()}
    assert actions == {"b": "updated", "c": "inserted"}
    rows = {r[0]: r for r in bucketed.read(spark, path).collect()}
    assert {k: r[rule["set_cols"][0]] for k, r in rows.items()} == {"a": "old", "b": "new", "c": "new"}
    later = dt.datetime(2024, 1, 20)
    if "touch_col" in rule:
        assert [rows[k][rule["touch_col"]] for k in "abc"] == [first, later, later]
    if "id_col" in rule:
        assert [rows[k].created_at for k in "abc"] == [first, first, later] and rows["b"].id == 7 and rows["c"].id is not None


def test_incremental_fold_equals_batch(spark):
    rng = random.Random(11)
    rows = []
    for e in range(400):
        at = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.choice([rng.randint(0, 90), rng.randint(0, 3600 * 5), rng.randint(0, 86400 * 3)]))
        rows.append((f"o{rng.randint(0, 25)}", at, e, rng.choice(orders.STATUSES)))
    types = "order_ref string, ts timestamp, event_id long, requested_status string"
    path = scratch_path(spark, "s")
    status_state.create(spark.createDataFrame(rows[:250], types), path, 8)
    minutes = files_by_bucket(spark, f"{path}/minute")
    status_state.add(spark, path, spark.createDataFrame(rows[250:251], types))
    after = files_by_bucket(spark, f"{path}/minute")
    assert sum(after.get(b) != f for b, f in minutes.items()) <= 1  # one request, one bucket
    for part in (rows[251:], rows[300:320], []):  # the second one is delivered again
        status_state.add(spark, path, spark.createDataFrame(part, types))
    want = {tuple(r) for r in orders.apply_status_changes(spark.createDataFrame(rows, types)).collect()}
    assert {tuple(r) for r in status_state.states(spark, path).collect()} == want


def test_a_period_reads_its_month_only(spark):
    o = spark.range(300).selectExpr("id", "id % 4 AS merchant_id", "'delivered' AS status",
                                    "TIMESTAMP '2000-01-15 00:00:00' + make_interval(0, CAST(id % 24 AS INT)) AS created_at").union(
        spark.sql("SELECT 999L, 1L, 'delivered', CAST(NULL AS TIMESTAMP)"))
    i = o.selectExpr("id AS order_id", "2 AS quantity")
    path = scratch_path(spark, "m")
    monthly.write(o, i, path)
    got = monthly.read(spark, path, "order_items", 3, 2000)
    assert {r.order_id for r in got.collect()} == {n for n in range(300) if n % 24 == 2}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(order_month" in plan and "= 200003)]" in plan
    assert spark.read.parquet(f"{path}/orders").count() == 301
