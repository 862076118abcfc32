"""Snapshot publishing and JSON command files."""

import json
import tempfile

from pyspark.sql import types as T

from conftest import SF_SMALL
from mercato.plans import queries as Q
from mercato.sources import documents, snapshots
from mercato.sources.fixtures import fixtures


def test_snapshot_versions(spark):
    base = tempfile.mkdtemp(prefix="mercato-snap-")
    placed = Q._placed(fixtures(spark, SF_SMALL))
    v1 = snapshots.write_snapshot({"bills": placed["bills"], "inventory": placed["inventory"]}, base)
    v2 = snapshots.write_snapshot({"bills": placed["bills"].limit(0), "inventory": placed["inventory"]}, base)
    assert (v1, v2) == (1, 2)
    assert snapshots.read_snapshot(spark, base, "bills").count() == 0
    assert snapshots.read_snapshot(spark, base, "bills", version=1).count() == placed["bills"].count()


def test_read_commands_keeps_bad_lines(spark):
    d = tempfile.mkdtemp(prefix="mercato-cmd-")
    with open(f"{d}/part-0.json", "w") as fh:
        fh.write(json.dumps({"cart_id": "12", "payment_type": "card"}) + "\n")
        fh.write('{"cart_id": "13", "payment_type": \n')
    schema = T.StructType([T.StructField("cart_id", T.StringType()), T.StructField("payment_type", T.StringType())])
    rows = documents.read_commands(spark, d, schema).collect()
    assert len(rows) == 2
    good = [r for r in rows if r[documents.CORRUPT_COL] is None]
    assert len(good) == 1 and good[0].cart_id == "12"


def test_documents_round_trip(spark):
    import os

    placed = Q._placed(fixtures(spark, SF_SMALL))
    from mercato.operators import orders

    docs = documents.to_documents(orders.order_detail(placed["bills"], placed["lines"], placed["addons"]), "order_id")
    out = os.path.join(tempfile.mkdtemp(prefix="mercato-docs-"), "docs")
    documents.write_documents(docs, out)
    back = spark.read.json(out)
    assert back.count() == placed["bills"].count()
    one = json.loads(back.first().document)
    assert {"order_id", "subtotal", "total", "items"} <= set(one)
    assert all("addons" in it for it in one["items"])


T0 = "2024-01-01 10:00:00"


def _feed_of(spark, files, watermark="1 hour", idle=None, **more):
    """Feed of a stream that reads one file of (event_id, order_ref, minutes after T0, wanted) per micro-batch."""
    import datetime as dt

    from mercato.streaming import status_stream

    base = tempfile.mkdtemp(prefix="mercato-feed-")
    start = dt.datetime.fromisoformat(T0)
    schema = "event_id long, order_ref string, ts timestamp, requested_status string"
    for i, rows in enumerate(files):
        at = [(e, o, None if m is None else start + dt.timedelta(minutes=m), s) for e, o, m, s in rows]
        spark.createDataFrame(at, schema).coalesce(1).write.parquet(f"{base}/src/f{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{base}/src")
    return status_stream.run_feed(stream, base, watermark, idle, **more).collect()


def test_status_feed_is_in_event_time(spark):
    """Requests out of order within the delay are applied in order; second deliveries have a row of their own."""
    feed = _feed_of(spark, [[(1, "a", 0, "accepted"), (3, "a", 20, "delivered"), (3, "a", 20, "delivered")],
                            [(2, "a", 10, "out_for_delivery"), (1, "a", 0, "accepted"), (4, "b", 30, "delivered")],
                            [(5, "b", 25, "cancelled")]])
    rows = sorted((r.event_id, r.from_status, r.to_status, r.applied, r.reason) for r in feed if r.reason is None)
    assert rows == [(1, "pending", "accepted", True, None), (2, "accepted", "out_for_delivery", True, None), (3, "out_for_delivery", "delivered", True, None),
                    (4, "cancelled", "delivered", False, None), (5, "pending", "cancelled", True, None)]
    assert sorted((r.event_id, r.applied, r.reason) for r in feed if r.reason) == [(1, False, "duplicate"), (3, False, "duplicate")]


def test_status_feed_keeps_late_and_incomplete_rows(spark):
    files = [[(1, "a", 0, "accepted"), (9, None, 0, "accepted"), (None, "a", 0, "accepted"), (10, "a", None, "accepted")],
             [(2, "a", 600, "out_for_delivery")],
             [(3, "a", 660, "delivered")],
             [(4, "a", -5, "cancelled"), (1, "a", 0, "accepted"), (5, "c", 1, "accepted")]]
    feed = _feed_of(spark, files)
    assert len(feed) == sum(map(len, files))
    reasons = sorted((r.event_id or 0, r.reason) for r in feed if r.reason)
    assert reasons[0] == (0, "incomplete") and (9, "incomplete") in reasons and (10, "incomplete") in reasons and (4, "late") in reasons
    assert [r for i, r in reasons if i == 1] in (["late"], ["duplicate"])
    assert {r.event_id: r.status_after for r in feed if r.applied} == {1: "accepted", 2: "out_for_delivery", 3: "delivered", 5: "accepted"}


def test_status_feed_drops_idle_state(spark):
    feed = _feed_of(spark, [[(1, "a", 0, "cancelled")], [(2, "b", 60 * 24, "accepted")], [(3, "b", 60 * 48, "cancelled")], [(4, "b", 60 * 72, "cancelled")],
                            [(5, "a", 60 * 72, "accepted")]], idle="1 hour")
    assert {r.event_id: r.from_status for r in feed}[5] == "pending"  # the state of order a was gone


def test_status_feed_does_not_depend_on_the_buckets(spark):
    """One call takes many orders; they share lists and a timer, and each has its own status, late rows and idle time."""
    files = [[(1, "a", 0, "accepted"), (11, "b", 5, "accepted"), (12, "b", 5, "accepted"), (9, None, 0, "accepted"), (11, "b", 5, "accepted")],
             [(2, "a", 600, "out_for_delivery"), (21, "c", 590, None)],
             [(3, "a", 660, "delivered"), (13, "b", 640, "cancelled"), (11, "a", 600, "refunded")],
             [(4, "a", -5, "cancelled"), (5, "d", 1, "accepted"), (1, "b", 650, "accepted")],
             [(6, "a", 2000, "refunded"), (14, "b", 1990, "accepted"), (22, "c", 1980, "accepted")]]
    for idle in (None, "2 hours"):
        one, many = (sorted(map(str, _feed_of(spark, files, idle=idle, buckets=n))) for n in (1, 1000))
        assert one == many and len(one) == sum(map(len, files))


def test_status_stream_split_by_key_equals_the_batch_fold(spark):
    """Events dealt to four files by a hash of their id, not by time; a delay that spans them gives the batch result."""
    import os

    from pyspark.sql import functions as F

    from mercato.operators import orders
    from mercato.sources.tables import SCHEMAS
    from mercato.streaming import status_stream

    events = spark.read.schema(SCHEMAS["events"]).parquet(os.path.join(SF_SMALL, "events.parquet"))
    base = tempfile.mkdtemp(prefix="mercato-events4-")
    for i in range(4):
        events.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == i).coalesce(1).write.parquet(os.path.join(base, "src", f"part{i}"))
    stream = (spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(os.path.join(base, "src")))
    feed = status_stream.run_feed(status_stream.requests_from_events(stream), base, watermark="400 days")
    assert feed.count() == events.count() and feed.where("reason IS NOT NULL").count() == 0
    last = feed.groupBy("order_ref").agg(F.max_by("status_after", F.struct("ts", "event_id")).alias("s"), F.sum(F.col("applied").cast("int")).alias("n"))
    batch = orders.apply_status_changes(status_stream.requests_from_events(events)).select("order_ref", "final_status", "n_applied")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, batch.collect()))
    # with a short delay rows come late, and every one of them is in the feed
    short = status_stream.run_feed(status_stream.requests_from_events(stream), tempfile.mkdtemp(prefix="mercato-short-"), watermark="1 hour")
    assert short.count() == events.count()


def test_sales_stream_split_by_key_equals_the_batch(spark):
    """Orders dealt to four files by a hash, so that every day is in every file; retries, compaction and vacuum change nothing."""
    import os

    from pyspark.sql import functions as F

    from mercato.sources import files
    from mercato.sources.fixtures import fixtures
    from mercato.sources.tables import SCHEMAS
    from mercato.streaming import sales_stream

    orders_ = spark.read.schema(SCHEMAS["orders"]).parquet(os.path.join(SF_SMALL, "orders.parquet"))
    base = tempfile.mkdtemp(prefix="mercato-orders4-")
    for i in range(3):
        orders_.filter(F.pmod(F.xxhash64("o_orderkey"), F.lit(4)) == i).coalesce(1).write.parquet(f"{base}/src/part{i}")

    def run():
        stream = (spark.readStream.schema(SCHEMAS["orders"]).option("maxFilesPerTrigger", 1)
                  .option("recursiveFileLookup", "true").parquet(f"{base}/src"))
        return sales_stream.run_sales_stream(spark, SF_SMALL, source=stream, base=f"{base}/sales")

    def rows(df):
        return sorted(map(tuple, df.select("merchant_id", "day", *[F.col(c).cast("decimal(20,2)").alias(c) for c in sales_stream.SUMS], "n_items").collect()))

    fx = fixtures(spark, SF_SMALL)
    first_run = rows(run())
    sales_stream.compact(spark, f"{base}/sales", 1)
    assert rows(sales_stream.read_sales(spark, f"{base}/sales")) == first_run
    sales_stream.vacuum(spark, f"{base}/sales")
    assert files.names(spark, f"{base}/sales/log") == ["b=2"] and rows(sales_stream.read_sales(spark, f"{base}/sales")) == first_run
    # the oldest orders of all come in a later run: nothing is too late
    orders_.filter(F.pmod(F.xxhash64("o_orderkey"), F.lit(4)) == 3).coalesce(1).write.parquet(f"{base}/src/part3")
    want = rows(sales_stream.daily_sales(fx.v_orders, fx.v_order_items))
    assert rows(run()) == want
    # a retried batch replaces its part, and one inside the compacted part is not counted again
    part = spark.read.parquet(f"{base}/sales/log/b=3").collect()
    schema = spark.read.parquet(f"{base}/sales/log/b=3").schema
    for batch_id in (3, 1):
        sales_stream.write_batch(spark.createDataFrame(part, schema), f"{base}/sales", batch_id)
        assert rows(sales_stream.read_sales(spark, f"{base}/sales")) == want


def test_unfinished_parts_are_not_read(spark):
    from mercato.sources import files
    from mercato.streaming import sales_stream

    base = tempfile.mkdtemp(prefix="mercato-parts-")
    part = spark.createDataFrame([(1, "2024-01-01", 1.0, 0.5, 0.0, 2)], "merchant_id long, day string, total_sales double, total_tax double, total_discount double, n_items long")
    for n in range(3):
        sales_stream.write_batch(part, base, n)
    sales_stream.compact(spark, base, 1)
    files.remove(spark, f"{base}/compacted/upto=1/_SUCCESS")
    assert [r.n_items for r in sales_stream.read_sales(spark, base).collect()] == [6]
    files.remove(spark, f"{base}/log/b=2/_SUCCESS")
    assert sales_stream.parts(spark, base) == [f"{base}/log/b=0", f"{base}/log/b=1"]


def test_small_files(spark):
    from mercato.sources import files

    base = tempfile.mkdtemp(prefix="mercato-files-")
    assert files.names(spark, f"{base}/none") == [] and files.read_text(spark, f"{base}/x") is None
    files.replace_text(spark, f"{base}/x", "old é")
    files.replace_text(spark, f"{base}/x", "new é")
    assert files.read_text(spark, f"{base}/x") == "new é" and files.names(spark, base) == ["x"]
    files.remove(spark, f"{base}/x")
    assert not files.exists(spark, f"{base}/x")


def test_settle_removes_what_was_written_on_the_way(spark):
    from mercato.session import materialize, settle
    from mercato.sources import files

    written = []

    def build():
        a = materialize(spark.range(10).selectExpr("id % 3 AS k").groupBy("k").count())
        written.append(a.inputFiles()[0].rsplit("/", 1)[0])
        return a.join(materialize(spark.range(2).withColumnRenamed("id", "k")), "k")

    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    inner = []
    out = settle(lambda: inner.append(settle(build)) or inner[0].where("count > 3"))
    assert [(r.k, r["count"]) for r in out.collect()] == [(0, 4)]
    assert not files.exists(spark, written[0])
    assert not files.exists(spark, inner[0].select("k")._jdf.queryExecution().analyzed().collectLeaves().head().relation().location().rootPaths().head().toString())
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == before
