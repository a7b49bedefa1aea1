"""Structured Streaming versions of the polled views (kitchen queue, status
counts, daily sales, new-order detection).

Sources are files only (no sockets): a directory read with an explicit schema
and ``pathGlobFilter``; tests drain it with ``trigger(availableNow=True)``.
Sinks use ``foreachBatch`` writing under their batch id, so a retried batch overwrites
its own output (idempotent) and survives executor loss. What a stream remembers is a
:class:`~shopflow.streaming.state.KeyedState`: a batch reads and rewrites only the buckets
of its keys. All of it lies under the session's shared ``spark.checkpoint.dir``. No Python
function runs on executors.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopflow.session import scratch_path
from shopflow.sources.driver import status_events_from
from shopflow.streaming.state import KeyedState

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def event_stream(spark: SparkSession, directory: str, glob: str = "events.parquet",
                 max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(EVENTS).option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(directory)


# ------------------------------------------------------------ status state
def latest_status(updates: DataFrame) -> DataFrame:
    """Current status per order: the update with the greatest (ts, event_id).
    Works on a batch or a stream (state = one row per order; any status may
    follow any other, so no order ever leaves the state)."""
    return updates.groupBy("orderID").agg(
        F.max(F.struct("ts", "event_id", "status")).alias("_last")).select(
        "orderID", F.col("_last.status").alias("status"), F.col("_last.ts").alias("ts"),
        F.col("_last.event_id").alias("event_id"))


# ------------------------------------------------------------ keyed state
STATUS = ("orderID long, status string, raw_status string, ts timestamp_ntz, event_id long, order_type string, "
          "stored string, amount decimal(10,2), day date")
DAYS = "day date, orders long, sales decimal(22,2)"


def status_state(spark: SparkSession, path: str) -> KeyedState:
    """The latest status per order, with what the streams need to know of the order."""
    return KeyedState(spark, path, "orderID", STATUS)


def run_live_status(spark: SparkSession, events: DataFrame, orders: DataFrame, name: str,
                    trigger: dict | None = None) -> str:
    """Run the live status stream into a keyed state; returns its path.

    The stream keeps the latest (ts, event_id, status) per order as state, combined per
    task before the shuffle, so one hot order is one row a task. Each micro-batch's
    changed orders get the walk-in rule and are written under their batch id.
    ``trigger`` defaults to availableNow (drain and stop); the kitchen runs it
    with ``{"processingTime": "5 seconds"}``.
    """
    path = scratch_path(spark, f"{name}/status")

    def step(batch: DataFrame, batch_id: int) -> None:
        log = status_state(batch.sparkSession, path)
        log.write(status_moves(batch, log.read(batch, batch_id), orders), batch_id)

    _run(latest_status(_updates(events)), step, name, spark, trigger)
    return path


def _updates(events: DataFrame) -> DataFrame:
    return status_events_from(events).select("orderID", "status", "ts", "event_id")


def _run(stream: DataFrame, step, name: str, spark: SparkSession, trigger: dict | None, mode: str = "update",
         keep: bool = True) -> None:
    """``keep``: hold the batch while ``step`` runs; without it ``step`` must read it once."""
    def held(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            step(batch, batch_id)
        finally:
            batch.unpersist()

    q = (stream.writeStream.queryName(_qname(name)).outputMode(mode).foreachBatch(held if keep else step)
         .option("checkpointLocation", scratch_path(spark, f"{name}/checkpoint"))
         .trigger(**(trigger or {"availableNow": True})).start())
    if not trigger:
        q.awaitTermination()


def status_moves(batch: DataFrame, known: DataFrame, orders: DataFrame | None) -> DataFrame:
    """The orders of a micro-batch whose latest update is new: ``prev_status`` (null the first
    time) and ``status``, both after the walk-in rule, and the columns of ``STATUS``.

    ``known`` holds what the state has of the batch's orders (order type, stored status,
    amount and day, too); ``orders`` is read only for orders that it lacks, and unknown
    ones are dropped. Without ``orders`` there is no rule and no order is dropped."""
    from shopflow.operators.changes import walkin_rule

    of_order = ["order_type", "stored", "amount", "day"]
    k = known.select("orderID", *of_order, F.col("status").alias("prev_status"),
                     F.col("ts").alias("_ts"), F.col("event_id").alias("_id"))
    j = batch.select("orderID", F.col("status").alias("raw_status"), "ts", "event_id").join(k, "orderID", "left")
    seen, fresh = j.filter(F.col("_id").isNotNull()), j.filter(F.col("_id").isNull())
    if orders is not None and not fresh.isEmpty():
        kinds = orders.select("orderID", "order_type", F.col("status").alias("stored"),
                              F.col("totalAmount").alias("amount"), F.to_date("orderDateTime").alias("day"))
        fresh = fresh.drop(*of_order).join(kinds, "orderID", "inner")
    newer = F.col("_id").isNull() | (F.struct("ts", "event_id") > F.struct(F.col("_ts").alias("ts"), F.col("_id").alias("event_id")))
    status = F.col("raw_status") if orders is None else walkin_rule(F.col("raw_status"), F.col("order_type"))
    return seen.unionByName(fresh).filter(newer).withColumn("status", status).drop("_ts", "_id")


def current_from_changelog(spark: SparkSession, path: str) -> DataFrame:
    """The stream's latest status per order."""
    return status_state(spark, path).rows().select("orderID", "status")


def orders_with_live_status(orders: DataFrame, current: DataFrame) -> DataFrame:
    c = current.select("orderID", F.col("status").alias("_live"))
    return orders.join(c, "orderID", "left").withColumn(
        "status", F.coalesce(F.col("_live"), F.col("status"))).drop("_live")


def live_kitchen_queue(orders: DataFrame, current: DataFrame) -> DataFrame:
    """Pending/preparing orders under the live status, oldest first."""
    o = orders_with_live_status(orders, current)
    return (o.filter(F.col("status").isin("pending", "preparing"))
            .select("orderID", "customer_name", "order_type", "orderDateTime", "status")
            .orderBy("orderDateTime", "orderID"))


def live_status_counts(orders: DataFrame, current: DataFrame) -> DataFrame:
    o = orders_with_live_status(orders, current)
    return o.groupBy("status").agg(F.count(F.lit(1)).alias("cnt"))


# ------------------------------------------------------------ daily sales
def daily_sales_stream(events: DataFrame) -> DataFrame:
    """Purchase amounts per UTC day. The state is one row per calendar day, so no
    watermark bounds it and late purchases count however the files arrive."""
    p = events.filter(F.col("event_type") == "purchase")
    return p.groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum(F.col("value").cast("decimal(12,2)")).alias("sales"))


def run_daily_sales(spark: SparkSession, events: DataFrame, name: str) -> str:
    path = scratch_path(spark, f"{name}/days")
    _run(daily_sales_stream(events),
         lambda batch, n: KeyedState(batch.sparkSession, path, "day", DAYS).write(batch, n), name, spark, None)
    return path


def daily_sales_from_changelog(spark: SparkSession, path: str) -> DataFrame:
    return KeyedState(spark, path, "day", DAYS).rows()


# ------------------------------------------------------------ new orders
def queue_snapshot(updates: DataFrame, at) -> DataFrame:
    """Order ids in the queue (latest status pending/preparing) as of ``at``."""
    u = updates.filter(F.col("ts") <= F.lit(str(at)).cast("timestamp_ntz"))
    return latest_status(u).filter(F.col("status").isin("pending", "preparing")).select("orderID")


def new_order_diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Ids in the current snapshot and not in the previous one; nothing when the
    previous snapshot is empty (the first orders after an empty queue are not
    announced). One plan, no job while it is built: whether anything was queued before
    is a semi join with a frame of at most one row."""
    some = F.broadcast(previous.limit(1).select(F.lit(0).alias("_k")))
    return (current.join(previous, "orderID", "left_anti").withColumn("_k", F.lit(0))
            .join(some, "_k", "left_semi").drop("_k"))


QUEUE = ("pending", "preparing")


def run_new_order_stream(spark: SparkSession, events: DataFrame, name: str,
                         trigger: dict | None = None) -> str:
    """Streaming new-order detection: per micro-batch, the orders that entered
    the queue (pending/preparing) since the previous batch, announced only when
    the queue was not empty before the batch.

    Each batch sees only the orders whose status changed, with their previous status
    from the state; the queue size before it is carried in a one-row table per
    batch. Output per batch id under ``{base}/new``."""
    base = scratch_path(spark, name)

    def step(batch: DataFrame, batch_id: int) -> None:
        sess = batch.sparkSession
        log = status_state(sess, f"{base}/status")
        size = KeyedState(sess, f"{base}/queue", "k", "k int, n long", buckets=1)
        moves = status_moves(batch, log.read(batch, batch_id), None).persist()
        was = F.coalesce(F.col("prev_status").isin(*QUEUE), F.lit(False))
        now = F.col("status").isin(*QUEUE)
        held = size.rows(batch_id).first()
        before = held["n"] if held else 0
        delta = moves.agg(F.coalesce(F.sum(now.cast("long") - was.cast("long")), F.lit(0)).alias("d"))
        size.write(delta.select(F.lit(0).alias("k"), (F.col("d") + before).alias("n")), batch_id)
        entered = moves.filter(now & ~was).select("orderID")
        (entered if before > 0 else entered.limit(0)).write.mode("overwrite").parquet(f"{base}/new/batch_id={batch_id}")
        log.write(moves, batch_id)
        moves.unpersist()

    _run(latest_status(_updates(events)), step, name, spark, trigger)
    return base


def _qname(name: str) -> str:
    """Streams are named after their output folder, so a long-running one can be
    found in ``spark.streams.active`` and stopped."""
    return "shopflow_" + re.sub(r"[^0-9A-Za-z_]", "_", name)
