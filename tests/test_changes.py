"""Batch change operators on small frames (S4-S9) and quality checks (Q1-Q3)."""

import datetime as dt

from pyspark.sql import functions as F

from mercato.operators import changes, quality

AS_OF = "2024-01-20 00:00:00"


def test_append_rows_fills_defaults(spark):
    target = spark.createDataFrame([(1, "a", "pending", dt.datetime(2024, 1, 1))], "id long, name string, status string, created_at timestamp")
    batch = spark.createDataFrame([("b",), ("c",)], "name string")
    out = changes.append_rows(target, batch, AS_OF, defaults={"status": "pending"}, id_from=["name"])
    rows = {r.name: r for r in out.collect()}
    assert set(rows) == {"a", "b", "c"}
    assert rows["b"].status == "pending" and rows["b"].created_at == dt.datetime(2024, 1, 20)
    again = {r.name: r.id for r in changes.append_rows(target, batch, AS_OF, id_from=["name"]).collect()}
    assert again["b"] == rows["b"].id  # deterministic ids


def test_upsert_last_row_wins(spark):
    target = spark.createDataFrame([(1, 1, 5, 100), (1, 2, 7, 101)], "product_id long, branch_id long, quantity int, id long")
    batch = spark.createDataFrame([(1, 1, 9, 1), (1, 1, 3, 2), (2, 1, 4, 1)], "product_id long, branch_id long, quantity int, seq long")
    got = {(r.product_id, r.branch_id): (r.quantity, r.id, r.action)
           for r in changes.upsert(target, batch, ["product_id", "branch_id"], ["quantity"], "seq").collect()}
    assert got == {(1, 1): (3, 100, "updated"), (1, 2): (7, 101, "unchanged"), (2, 1): (4, None, "inserted")}


def test_update_and_delete_by_key(spark):
    t = spark.createDataFrame([(1, "pending"), (2, "pending")], "id long, status string")
    b = spark.createDataFrame([(2, "accepted"), (9, "accepted")], "id long, status string")
    upd, nf = changes.update_by_key(t, b, ["id"])
    assert {r.id: (r.status, r.updated) for r in upd.collect()} == {1: ("pending", False), 2: ("accepted", True)}
    assert [r.id for r in nf.collect()] == [9]
    rem, dele, nf2 = changes.delete_by_key(t, b.select("id"), ["id"])
    assert [r.id for r in rem.collect()] == [1] and [r.id for r in dele.collect()] == [2] and [r.id for r in nf2.collect()] == [9]


def test_cascade_rules(spark):
    """Shops own branches and stock; stock hangs on both (a diamond); zones lose their branch; an open bill keeps a clerk's shop."""
    shops = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    branches = spark.createDataFrame([(10, 1), (11, 2), (12, 3)], "id long, shop_id long")
    stock = spark.createDataFrame([(1, 10, 5), (2, 11, 5), (3, 10, 6), (4, 12, 7)], "id long, branch_id long, n long").withColumn("shop_id", F.col("id") % 2 + 1)
    clerks = spark.createDataFrame([(20, 1), (21, 2), (22, 4)], "id long, shop_id long")
    zones = spark.createDataFrame([(100, 2, 10), (101, 3, 11), (102, 3, None), (103, 1, 12)], "id long, shop_id long, branch_id long")
    bills = spark.createDataFrame([(1000, 21, 2), (1001, 21, 2), (1002, None, 1)], "id long, clerk_id long, shop_id long")
    edges = [dict(zip(("child", "child_cols", "parent", "parent_cols", "rule"), e)) for e in [
        ("branches", ["shop_id"], "shops", ["id"], "cascade"), ("clerks", ["shop_id"], "shops", ["id"], "cascade"),
        ("stock", ["shop_id"], "shops", ["id"], "cascade"), ("stock", ["branch_id"], "branches", ["id"], "cascade"),
        ("zones", ["shop_id"], "shops", ["id"], "cascade"), ("zones", ["branch_id"], "branches", ["id"], "set_null"),
        ("bills", ["shop_id"], "shops", ["id"], "cascade"), ("bills", ["clerk_id"], "clerks", ["id"], "restrict")]]
    tables = {"shops": shops, "branches": branches, "clerks": clerks, "stock": stock, "zones": zones, "bills": bills}
    asked = spark.createDataFrame([(1,), (2,), (2,), (4,), (9,)], "id long")  # shop 3 stays, 9 is unknown
    out = changes.cascade_delete("shops", asked, {n: (df, ["id"]) for n, df in tables.items()}, edges)
    # two bills name a clerk of shop 2, so that shop 2 stays with all it has, although those bills would go with it
    assert [tuple(r) for r in out["rejected"].collect()] == [(2, "bills", 2)]
    ids = {n: {o: sorted(r.id for r in t[o].collect()) for o in t} for n, t in out["tables"].items()}
    assert ids["shops"] == {"deleted": [1, 4], "cleared": [], "remaining": [2, 3]}
    assert ids["branches"]["deleted"] == [10] and ids["clerks"]["deleted"] == [20, 22]
    # stock 1 and 3 hang on branch 10, stock 2 and 4 on shop 1
    assert ids["stock"] == {"deleted": [1, 2, 3, 4], "cleared": [], "remaining": []}
    assert ids["zones"] == {"deleted": [103], "cleared": [100], "remaining": [100, 101, 102]}
    assert {r.id: r.branch_id for r in out["tables"]["zones"]["remaining"].collect()} == {100: None, 101: 11, 102: None}
    assert ids["bills"] == {"deleted": [1002], "cleared": [], "remaining": [1000, 1001]}
    for n, df in tables.items():
        assert out["tables"][n]["remaining"].columns == df.columns
        assert len(ids[n]["deleted"]) + len(ids[n]["remaining"]) == df.count()


def test_cascade_of_no_requests(spark):
    t = spark.createDataFrame([(1, None)], "id long, up long")
    out = changes.cascade_delete("a", t.limit(0), {"a": (t, ["id"]), "b": (t, ["id"])}, [{"child": "b", "child_cols": ["up"], "parent": "a", "parent_cols": ["id"], "rule": "restrict"}])
    assert out["rejected"].count() == 0 and out["tables"]["a"]["remaining"].count() == 1 and out["tables"]["b"]["deleted"].count() == 0


def test_quality_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None)], "k long, v string")
    dups = quality.check_unique(df, ["k", "v"], "uk").collect()
    assert [(r.key, r.n_rows) for r in dups] == [("1|a", 2)]  # NULLs never clash
    parent = spark.createDataFrame([(1,)], "id long")
    orphans = quality.check_fk(df, parent, ["k"], ["id"], "fk").collect()
    assert [r.key for r in orphans] == ["2", "2"]
    checked = quality.check_rules(df, [("k_small", F.col("k") < 2), ("v_set", F.col("v").isNotNull())])
    acc, rej = quality.split_accepted_rejected(checked)
    assert acc.count() == 2 and rej.count() == 2
    assert sorted(r.violations for r in rej.collect()) == [["k_small", "v_set"], ["k_small", "v_set"]]


def test_update_by_key_keeps_target_rows_single(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    b = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (9, "z", 1), (9, "w", 2)], "id long, v string, seq int")
    upd, nf = changes.update_by_key(t, b, ["id"], seq_col="seq")
    assert sorted(map(tuple, upd.collect())) == [(1, "x", True), (2, "b", False)]
    assert [tuple(r) for r in nf.collect()] == [(9, "w")]
    upd, _ = changes.update_by_key(t, b.drop("seq"), ["id"])
    assert sorted(map(tuple, upd.collect())) == [(1, "y", True), (2, "b", False)]


def test_insert_then_enrich_is_an_inner_join(spark):
    target = spark.createDataFrame([], "id long, actor_id long, created_at timestamp")
    batch = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id long, actor_id long")
    mails = spark.createDataFrame([(5, "a@b.c")], "actor_id long, email string")
    out = changes.insert_then_enrich(target, batch, "2024-01-01 00:00:00", mails, ["actor_id"], ["id"]).collect()
    assert [(r.id, r.email) for r in out] == [(1, "a@b.c")]
