"""Live order-status feed (T1, roadmap in the reference) on Structured Streaming, in event time.

Status-change requests arrive as a stream in any order.  A request waits in its
order's list state until the watermark has passed its time; an event-time timer
then applies what is due in (ts, event_id) order.  So the feed does not depend on how
the requests were split over micro-batches or files, and equals the batch fold
(``orders.apply_status_changes``).

Nothing is lost: every arriving row gives one row of the feed.  A request that comes
when later ones of its order were already applied has the reason ``late``, a second
delivery of an event the reason ``duplicate``; neither changes the status.  Spark
itself drops rows behind the watermark before a stateful operator sees them, so the
operator gets the time as a plain number and looks at the watermark itself.

State per order: the open requests, the status with the time up to which it is
settled, and the ids applied within the last watermark delay, which
tell a second delivery from a late request.  With ``idle`` an order's state is
dropped when no request came for that long (event time); a later one starts at
``pending`` again.

Most orders have few requests, and a call into Python with its state reads costs
milliseconds.  So orders are dealt to a fixed number of buckets by a hash, and one call
takes a bucket: lists of blocks hold the state of all its orders, and its one timer is
the earliest of theirs.

A run over stored files ends before the watermark passes the last requests.
``close_feed`` writes a closing mark to a second source: the next run reads it, the
watermark passes everything and the timers apply what waits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ListState

from mercato.operators.orders import ALLOWED_TRANSITIONS, INITIAL_STATUS
from mercato.session import checkpoint_dir
from mercato.sources.tables import table_stream

OUTPUT_SCHEMA = T.StructType([
    T.StructField("order_ref", T.StringType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("from_status", T.StringType()),
    T.StructField("to_status", T.StringType()),
    T.StructField("applied", T.BooleanType()),
    T.StructField("status_after", T.StringType()),
    T.StructField("reason", T.StringType()),
])
_NO_VALUE = -(1 << 62)  # a missing id or time on its way through pandas
BUCKETS = 2048
CLOSING_KEY = ""
CLOSING_TIME = "2200-01-01 00:00:00"
_BLOCK = 10_000  # rows of one entry of a state list
_COLUMNS = ["order_ref", "event_id", "at", "from_status", "to_status", "applied", "status_after", "reason"]
_FEED = "order_ref string, event_id long, at long, from_status string, to_status string, applied boolean, status_after string, reason string"
CLOSING = "order_ref string, event_id long, ts timestamp, requested_status string"

#: State store that the timers and list states need.
STATE_CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

# Event type -> requested status (same mapping as the fixture request view).
EVENT_TO_STATUS = {"signup": "accepted", "view": "out_for_delivery", "purchase": "delivered",
                   "click": "cancelled"}
OTHER_STATUS = "refunded"


def requests_from_events(events: DataFrame) -> DataFrame:
    """Status-change requests derived from the events stream (or table)."""
    status = None
    for k, v in EVENT_TO_STATUS.items():
        status = F.when(F.col("event_type") == k, F.lit(v)) if status is None else status.when(F.col("event_type") == k, F.lit(v))
    status = status.otherwise(F.lit(OTHER_STATUS))
    return events.select(
        "event_id",
        F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("ts").cast("date").cast("string")).alias("order_ref"),
        F.col("ts").cast("timestamp").alias("ts"),
        status.alias("requested_status"),
    )


class StatusProcessor(StatefulProcessor):
    """Requests of the orders of one bucket -> feed rows; times are microseconds, timers milliseconds."""

    def __init__(self, delay_us: int, idle_us: int | None):
        self.delay_us, self.idle_us = delay_us, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "order_ref array<string>, event_id array<long>, at array<long>, requested_status array<string>")
        self.status = handle.getListState("status", "order_ref array<string>, status array<string>, until array<long>, last array<long>")
        self.done = handle.getListState("done", "order_ref array<string>, event_id array<long>, at array<long>")

    @staticmethod
    def _rows(state: ListState) -> Iterator[tuple]:
        """Rows of a state whose list holds blocks of rows, column by column."""
        return chain.from_iterable(zip(*block) for block in state.get())

    @staticmethod
    def _blocks(rows: list[tuple]) -> list[tuple]:
        return [tuple(map(list, zip(*rows[i:i + _BLOCK]))) for i in range(0, len(rows), _BLOCK)]

    def _keep(self, state: ListState, rows: list[tuple]) -> None:
        state.put(self._blocks(rows)) if rows else state.clear()

    def _known(self) -> dict[str, tuple]:
        return {order: tuple(rest) for order, *rest in self._rows(self.status)}

    def _wake(self, at_ms: int) -> None:
        """One timer per bucket: the earliest."""
        timers = list(self.handle.listTimers())
        if any(t <= at_ms for t in timers):
            return
        for t in timers:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [r for pdf in rows for r in zip(pdf["at"].tolist(), pdf["event_id"].tolist(), pdf["requested_status"].tolist(), pdf["order_ref"].tolist())]
        new.sort(key=lambda r: (r[0], r[1], r[2] or ""))
        known = self._known()
        before = dict(known)
        seen = {(r[0], r[1]) for state in (self.open, self.done) for r in self._rows(state)} if known else set()
        refused, accepted = [], []
        for at, event, wanted, order in new:
            status, until, last = known.get(order, (INITIAL_STATUS, None, _NO_VALUE))
            reason = None
            if order is None or _NO_VALUE in (at, event):
                reason = "incomplete"
            elif (order, event) in seen:
                reason = "duplicate"
            elif until is not None and at <= until:
                reason = "late"
            if reason:
                refused.append((order, event, at, status, wanted, False, status, reason))
            else:
                seen.add((order, event))
                accepted.append((order, event, at, wanted))
                known[order] = (status, until, max(last, at))
        if accepted:
            self.open.appendList(self._blocks(accepted))
            self._wake(accepted[0][2] // 1000 + 1)
            if any(known[order] != rest for order, rest in before.items()):
                self._keep(self.status, [(order, *rest) for order, rest in known.items()])
            elif len(known) > len(before):
                self.status.appendList(self._blocks([(order, *rest) for order, rest in known.items() if order not in before]))
        if refused:
            yield pd.DataFrame(refused, columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        passed = now * 1000
        waiting: dict[str, list[tuple]] = {}
        for order, event, at, wanted in sorted(self._rows(self.open), key=lambda r: (r[2], r[1], r[3] or "")):
            waiting.setdefault(order, []).append((at, event, wanted))
        known, rows, applied, left, wake = {}, [], {}, [], []
        orders = self._known()
        for order, (status, until, last) in orders.items():
            open_ = waiting.get(order, [])
            if open_ and open_[0][0] // 1000 < now:
                due = [r for r in open_ if r[0] <= passed]
                open_ = open_[len(due):]
                for at, event, wanted in due:
                    ok = wanted in ALLOWED_TRANSITIONS.get(status, ())
                    rows.append((order, event, at, status, wanted, ok, wanted if ok else status, None))
                    status = rows[-1][6]
                until = due[-1][0]
                applied[order] = due
            left += [(order, event, at, wanted) for at, event, wanted in open_]
            if open_:
                wake.append(open_[0][0] // 1000 + 1)
            elif self.idle_us and (last + self.idle_us <= passed if order in applied else (last + self.idle_us) // 1000 < now):
                continue  # idle: its state goes
            elif self.idle_us:
                wake.append((last + self.idle_us) // 1000 + 1)
            known[order] = (status, until, last)
        if applied or len(known) < len(orders):
            self._keep(self.open, left)
            self._keep(self.status, [(order, *rest) for order, rest in known.items()])
            # an event is known as long as its time is within the delay of the latest one applied
            done = [*self._rows(self.done), *((order, event, at) for order, due in applied.items() for at, event, _ in due)]
            self._keep(self.done, [r for r in done if r[0] in known and (r[0] not in applied or r[2] > known[r[0]][1] - self.delay_us)])
        if wake:
            self.handle.registerTimer(min(wake))
        if rows:
            yield pd.DataFrame(rows, columns=_COLUMNS)

    def close(self) -> None:
        pass


def status_feed(requests: DataFrame, watermark: str = "1 hour", idle: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """T1 transformation on a streaming DataFrame of requests (event_id, order_ref, ts, requested_status).

    A request without order, id or time has the reason ``incomplete``.  Closing
    marks give no row.  The session needs ``STATE_CONF``.  A batch reads the state of
    the buckets that it reaches; ``buckets`` does not change the feed, and a checkpoint keeps its own.
    """
    def us(text: str) -> int:
        return int(pd.Timedelta(text).total_seconds() * 1_000_000)

    def whole(c) -> Column:
        return F.coalesce(c, F.lit(_NO_VALUE))

    plain = requests.withWatermark("ts", watermark).select(
        "order_ref", whole(F.col("event_id")).alias("event_id"), whole(F.unix_micros("ts")).alias("at"), "requested_status")
    spread = F.xxhash64("order_ref", F.when(F.col("order_ref").isNull(), F.col("event_id")))  # requests without an order have no state
    feed = plain.withColumn("bucket", F.pmod(spread, F.lit(buckets))).groupBy("bucket").transformWithStateInPandas(
        StatusProcessor(us(watermark), us(idle) if idle else None), _FEED, "append", "eventtime")
    feed = feed.where(~F.col("order_ref").eqNullSafe(F.lit(CLOSING_KEY)))
    return feed.select("order_ref", F.nullif("event_id", F.lit(_NO_VALUE)).alias("event_id"),
                       F.timestamp_micros(F.nullif("at", F.lit(_NO_VALUE))).alias("ts"), *[f.name for f in OUTPUT_SCHEMA.fields[3:]])


def close_feed(spark: SparkSession, path: str, upto) -> None:
    """Write a closing mark to the source ``path``: once a run has read it, all requests up to ``upto`` are applied."""
    row = spark.createDataFrame([(CLOSING_KEY, 0)], "order_ref string, event_id long")
    row.select("order_ref", "event_id", F.lit(upto).cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("requested_status")).write.mode("append").parquet(path)


def run_feed(requests: DataFrame, base: str, watermark: str = "1 hour", idle: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Drain a stream of requests under the folder ``base``, close it, and return the feed table.

    Runs again with the same ``base`` go on where the last one ended.
    """
    spark = requests.sparkSession
    closing = f"{base}/closing"
    spark.createDataFrame([], CLOSING).write.mode("ignore").parquet(closing)
    marks = spark.readStream.schema(CLOSING).parquet(closing)
    names = [f.name for f in marks.schema]
    feed = status_feed(requests.select(*names).unionByName(marks), watermark, idle, buckets)

    def drain() -> None:
        before = {k: spark.conf.get(k, None) for k in STATE_CONF}
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        try:
            (feed.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/chk")
             .outputMode("append").trigger(availableNow=True).start().awaitTermination())
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    drain()
    close_feed(spark, closing, CLOSING_TIME)
    drain()
    return spark.read.schema(OUTPUT_SCHEMA).parquet(f"{base}/out")


def run_status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run T1 over the events file as a stream until it is drained and closed; return the feed table."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/status-stream-{uuid.uuid4().hex}"
    return run_feed(requests_from_events(table_stream(spark, sf_dir, "events")), base)
