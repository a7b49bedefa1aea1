"""The dashboard kept current by retraction: sums follow every status change.

The sums of the orders as stored are taken once, when a stream starts. After that, each
micro-batch holds only the orders whose status changed: an order that leaves a status takes
out what it had put in, one that enters adds it. Nothing is scanned again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.schema import TOP_PRODUCTS
from shopflow.session import scratch_path
from shopflow.streaming.live import _run, _updates, latest_status, status_moves, status_state
from shopflow.streaming.state import KeyedState

COUNTS = "status string, cnt long"
SUMS = "day date, open_orders long, completed long, sales decimal(22,2)"
TOTALS = "productID long, lines long, total_sold long, revenue decimal(38,2)"
ITEMS = "orderID long, productID long, lines long, units long, revenue decimal(38,2)"
CANDIDATES = "k int, is_bound boolean, " + TOTALS  # all of one key: a write replaces them all
BEFORE = -1  # batch id of what is stored when a stream starts


# ----------------------------------------------------------------- counts and days
def _counts(spark: SparkSession, base: str) -> KeyedState:
    return KeyedState(spark, f"{base}/counts", "status", COUNTS, buckets=1)


def _sums(spark: SparkSession, base: str) -> KeyedState:
    return KeyedState(spark, f"{base}/days", "day", SUMS)


def _by_status(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.sum("sign").alias("cnt"))


def _by_day(rows: DataFrame) -> DataFrame:
    """What orders put into their days: ``sign`` is 1 for what comes in, -1 for what goes."""
    done, sign = F.col("status") == "completed", F.col("sign")
    return rows.groupBy("day").agg(
        F.sum(F.when(F.col("status") != "cancelled", sign).otherwise(0)).alias("open_orders"),
        F.sum(F.when(done, sign).otherwise(0)).alias("completed"),
        F.sum(F.when(done, F.col("amount") * sign).otherwise(0)).alias("sales"))


def _add(state: KeyedState, delta: DataFrame, batch_id: int) -> None:
    """Add a batch's sums to those held for its keys."""
    key, cols = state.key, [f.name for f in state.schema if f.name != state.key]
    delta = delta.persist()
    held = state.read(delta, batch_id).join(delta.select(key).distinct().withColumnRenamed(key, "_k"),
                                            F.col(key).eqNullSafe(F.col("_k")), "left_semi")
    state.write(held.unionByName(delta.select(key, *cols)).groupBy(key).agg(*[F.sum(c).alias(c) for c in cols]), batch_id)
    delta.unpersist()


def _signed(moves: DataFrame) -> DataFrame:
    """Each move as two rows: out of the old status, into the new one."""
    old = F.coalesce("prev_status", "stored")
    return moves.select("orderID", "day", "amount", F.explode(F.array(
        F.struct(old.alias("status"), F.lit(-1).cast("long").alias("sign")),
        F.struct(F.col("status"), F.lit(1).cast("long").alias("sign")))).alias("m")).select(
        "orderID", "day", "amount", "m.*")


def run_live_dashboard(spark: SparkSession, events: DataFrame, orders: DataFrame, name: str,
                       trigger: dict | None = None) -> str:
    """Keep the dashboard's sums while statuses change (it polls every 30 s: pass
    ``{"processingTime": "30 seconds"}``); returns the folder to read them from.

    Statuses are counted after the walk-in rule; updates of unknown orders are dropped."""
    base = scratch_path(spark, name)
    if not _counts(spark, base).started():
        stored = orders.select("status", F.to_date("orderDateTime").alias("day"), F.col("totalAmount").alias("amount"),
                               F.lit(1).cast("long").alias("sign"))
        _sums(spark, base).write(_by_day(stored), BEFORE)
        _counts(spark, base).write(_by_status(stored), BEFORE)

    def step(batch: DataFrame, batch_id: int) -> None:
        sess = batch.sparkSession
        log = status_state(sess, f"{base}/status")
        moves = status_moves(batch, log.read(batch, batch_id), orders).persist()
        signed = _signed(moves)
        _add(_counts(sess, base), _by_status(signed), batch_id)
        _add(_sums(sess, base), _by_day(signed), batch_id)
        log.write(moves, batch_id)
        moves.unpersist()

    _run(latest_status(_updates(events)), step, name, spark, trigger)
    return base


def status_counts(spark: SparkSession, base: str) -> DataFrame:
    """Orders by live status (statuses that no order has are absent)."""
    return _counts(spark, base).rows().filter(F.col("cnt") != 0)


def dashboard_stats(spark: SparkSession, base: str, products: DataFrame, as_of) -> DataFrame:
    """The five figures under the live status, from one row a day and one a status."""
    today = F.col("day") == F.to_date(F.lit(str(as_of)))

    def money(c):
        return F.coalesce(F.sum(c), F.lit(0)).cast("decimal(22,2)")

    rows = (_sums(spark, base).rows()
            .unionByName(_counts(spark, base).rows().filter("status = 'pending'"), allowMissingColumns=True)
            .unionByName(products.filter("is_available = 1").agg(F.count(F.lit(1)).alias("products")), allowMissingColumns=True))
    return rows.agg(F.coalesce(F.sum(F.when(today, F.col("open_orders"))), F.lit(0)).alias("today_orders"),
                    money(F.when(today, F.col("sales"))).alias("today_sales"), money("sales").alias("total_sales"),
                    F.coalesce(F.sum("cnt"), F.lit(0)).alias("pending_orders"),
                    F.coalesce(F.sum("products"), F.lit(0)).alias("product_count"))


def sales_by_day(spark: SparkSession, base: str, as_of, days: int = 7) -> DataFrame:
    """Completed revenue per date since ``as_of - days``; days without sales are absent."""
    return (_sums(spark, base).rows()
            .filter((F.col("day") >= F.date_sub(F.to_date(F.lit(str(as_of))), days)) & (F.col("completed") > 0))
            .select(F.col("day").alias("date"), F.col("sales").alias("total")))


# ----------------------------------------------------------------- top products
def _totals(spark: SparkSession, base: str) -> KeyedState:
    return KeyedState(spark, f"{base}/totals", "productID", TOTALS)


def _items(spark: SparkSession, base: str) -> KeyedState:
    return KeyedState(spark, f"{base}/items", "orderID", ITEMS)


def _candidates(spark: SparkSession, base: str) -> KeyedState:
    return KeyedState(spark, f"{base}/top", "k", CANDIDATES, buckets=1)


def _best(df: DataFrame, k: int) -> DataFrame:
    return df.orderBy(F.desc("total_sold"), "productID").limit(k)


Placed = tuple[int, int, int, object]  # productID, lines, total_sold, revenue
Bound = tuple[int, int] | None  # total_sold, productID of the last place kept


def _place(r: Placed) -> tuple[int, int]:
    return -r[2], r[0]


def _refill(totals: DataFrame, size: int) -> tuple[list[Placed], Bound]:
    """The best ``size`` products, and the last of them as the bound (None: these are all)."""
    best = [tuple(r) for r in _best(totals.filter("lines > 0"), size + 1).collect()]
    return best[:size], (best[size - 1][2], best[size - 1][0]) if len(best) > size else None


def follow_top(held: list[Placed], bound: Bound, changed: DataFrame, totals: Callable[[], DataFrame],
               k: int, size: int) -> tuple[list[Placed], Bound]:
    """The candidates and the bound after ``changed`` products (columns of TOTALS) got new totals.

    Candidates (at most twice ``size``) stand at or before the bound, every other product
    after it. Changed products are placed by their new totals, so the rule holds on, and
    the best ``k`` candidates are the best products while there are ``k``. When they get
    fewer, and only then, ``totals`` (one row a product) is read; beyond twice ``size``
    the bound moves up to the ``size``-th."""
    moved = {r.productID for r in changed.filter(F.col("productID").isin([r[0] for r in held])).select("productID").collect()}
    inside = changed.filter("lines > 0")
    if bound is not None:
        units, product = bound
        inside = inside.filter((F.col("total_sold") > units) | ((F.col("total_sold") == units) & (F.col("productID") <= product)))
    fresh = [tuple(r) for r in _best(inside, 2 * size + 1).collect()]
    now = sorted([r for r in held if r[0] not in moved] + fresh, key=_place)
    if bound is not None and len(now) < k:
        return _refill(totals(), size)
    if len(now) > 2 * size:
        now = now[:size]
        bound = now[-1][2], now[-1][0]
    return now, bound


def _candidate_rows(spark: SparkSession, rows: list[Placed], bound: Bound) -> DataFrame:
    units, product = bound or (None, None)
    return spark.createDataFrame([(0, False, *r) for r in rows] + [(0, True, product, None, units, None)], CANDIDATES)


def run_live_top_products(spark: SparkSession, events: DataFrame, tables, name: str, k: int = TOP_PRODUCTS,
                          size: int | None = None, trigger: dict | None = None) -> str:
    """Keep the best-selling ``k`` products (completed orders, all time) while statuses change.

    When the stream starts, items are summed by order and product and dealt by order, and
    totals by product. A batch then reads the items of the orders that entered or left
    'completed', the totals of their products, and the ``size`` (4 ``k``) candidates."""
    base, size = scratch_path(spark, name), size or 4 * k
    if not _candidates(spark, base).started():
        lines = tables.order_items.join(tables.products.select("productID"), "productID", "left_semi").groupBy(
            "orderID", "productID").agg(F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("units"),
                                        F.sum(F.col("quantity") * F.col("price")).alias("revenue"))
        _items(spark, base).write(lines, BEFORE)
        done = tables.orders.filter("status = 'completed'").select("orderID")
        sold = _items(spark, base).rows().join(done, "orderID", "left_semi").groupBy("productID").agg(
            F.sum("lines").alias("lines"), F.sum("units").alias("total_sold"), F.sum("revenue").alias("revenue"))
        _totals(spark, base).write(sold, BEFORE)
        _candidates(spark, base).write(_candidate_rows(spark, *_refill(_totals(spark, base).rows(), size)), BEFORE)

    def step(batch: DataFrame, batch_id: int) -> None:
        sess = batch.sparkSession
        log, totals, top = status_state(sess, f"{base}/status"), _totals(sess, base), _candidates(sess, base)
        moves = status_moves(batch, log.read(batch, batch_id), tables.orders).persist()
        turned = (_signed(moves).filter("status = 'completed'").groupBy("orderID").agg(F.sum("sign").alias("sign"))
                  .filter("sign <> 0")).persist()
        delta = _items(sess, base).read(turned, batch_id).join(turned, "orderID").groupBy("productID").agg(
            F.sum(F.col("lines") * F.col("sign")).alias("lines"),
            F.sum(F.col("units") * F.col("sign")).alias("total_sold"),
            F.sum(F.col("revenue") * F.col("sign")).alias("revenue")).persist()
        _add(totals, delta, batch_id)
        now = totals.read(delta, batch_id + 1).join(delta.select("productID"), "productID", "left_semi")
        held = top.rows(batch_id).collect()
        edge = next((r.total_sold, r.productID) for r in held if r.is_bound)
        rows, bound = follow_top([tuple(r)[2:] for r in held if not r.is_bound], edge if edge[1] is not None else None,
                                 now, lambda: totals.rows(batch_id + 1), k, size)
        top.write(_candidate_rows(sess, rows, bound), batch_id)
        log.write(moves, batch_id)
        for df in (moves, turned, delta):
            df.unpersist()

    _run(latest_status(_updates(events)), step, name, spark, trigger)
    return base


def top_products(spark: SparkSession, base: str, products: DataFrame, k: int = TOP_PRODUCTS) -> DataFrame:
    """The best ``k`` products now: name, units and revenue."""
    best = _best(_candidates(spark, base).rows().filter("not is_bound"), k)
    return best.join(products.select("productID", "name"), "productID").select(
        "productID", "name", "total_sold", "revenue").orderBy(F.desc("total_sold"), "productID")
