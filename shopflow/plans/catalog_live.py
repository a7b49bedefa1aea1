"""Registered queries of the stream jobs that keep state, the stock ledger and cart logs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shopflow.operators import insert_checks, reports, sketches
from shopflow.operators.cart_log import cart_actions
from shopflow.operators.ledger import stock_ledger
from shopflow.plans.catalog import AS_OF, DATE_FROM, DATE_TO, ORACLES, _t, register
from shopflow.plans.catalog_changes import _ALLOC_STOCK, _LIVE_STATE, _alloc_stock, _intake_inputs
from shopflow.plans.views import with_views
from shopflow.session import scratch_path
from shopflow.sources import driver
from shopflow.streaming import dashboard, intake, live

# ======================================================================= intake
CUTS = (0.2, 0.55)  # where the payload files are cut into three deliveries


def _live_intake(spark, sf_dir):
    """Orders and their lines as JSON bodies, delivered in three parts; the stream is run
    after each delivery and goes on from the stock that it left."""
    h, ln = _intake_inputs(spark, sf_dir)
    items = ln.groupBy("order_seq").agg(F.sort_array(F.collect_list(F.struct("line_pos", "productID", "quantity"))).alias("items"))
    bodies = h.join(items, "order_seq").select("order_seq", F.to_json(F.struct(
        "order_seq", "EmployeeID", "customer_name", "table_number", "items")).alias("value"))
    name = f"live-intake-{uuid.uuid4().hex}"
    folder = scratch_path(spark, f"{name}-in")
    bounds = driver.read_raw(spark, sf_dir, "orders").approxQuantile("o_orderkey", list(CUTS), 0.01)
    edges = [float("-inf"), *bounds, float("inf")]
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        part = bodies.filter((F.col("order_seq") > a) & (F.col("order_seq") <= b))
        part.select("value").write.text(f"{folder}/{i}")
        stream = intake.payload_stream(spark, folder, "part-*")
        base = intake.run_live_intake(spark, stream, _alloc_stock(spark, sf_dir), name)
    return base


@register("live_orders_intake", ORACLES["orders_intake"])
def q_live_orders_intake(spark, sf_dir):
    return intake.taken(spark, _live_intake(spark, sf_dir), "orders").drop("batch_id")


@register("live_intake_stock", ORACLES["intake_stock"])
def q_live_intake_stock(spark, sf_dir):
    return intake.stock_now(spark, _live_intake(spark, sf_dir), _alloc_stock(spark, sf_dir))


# ======================================================================= dashboard
_NOW = """now_orders AS (
  SELECT s.* EXCLUDE (status), COALESCE(l.status, s.status) AS status
  FROM shop_orders s LEFT JOIN live l ON s.orderID = l.orderID)"""
_FLOW = f"""flow AS (
  SELECT CAST(orderDateTime AS DATE) AS d, status, COUNT(*) AS n, SUM(totalAmount) AS amount
  FROM now_orders GROUP BY 1, 2), today AS (SELECT * FROM flow WHERE d = DATE '{AS_OF}')"""


def _dashboard(spark, sf_dir):
    return dashboard.run_live_dashboard(spark, live.event_stream(spark, sf_dir), _t(spark, sf_dir).orders,
                                        f"live-sums-{uuid.uuid4().hex}")


@register("live_dashboard_stats", with_views("""
SELECT CAST(COALESCE((SELECT SUM(n) FROM today WHERE status <> 'cancelled'), 0) AS BIGINT) AS today_orders,
       COALESCE((SELECT SUM(amount) FROM today WHERE status = 'completed'), 0) AS today_sales,
       COALESCE(SUM(amount) FILTER (status = 'completed'), 0) AS total_sales,
       CAST(COALESCE(SUM(n) FILTER (status = 'pending'), 0) AS BIGINT) AS pending_orders,
       (SELECT COUNT(*) FROM products WHERE is_available = 1) AS product_count
FROM flow""", "shop_orders", "products", "status_events", extra=[_LIVE_STATE, _NOW, _FLOW]))
def q_live_dashboard_stats(spark, sf_dir):
    """The five figures after all status events, kept by retraction."""
    return dashboard.dashboard_stats(spark, _dashboard(spark, sf_dir), _t(spark, sf_dir).products, AS_OF)


@register("live_sales_by_day", with_views(f"""
SELECT d AS date, amount AS total FROM flow WHERE status = 'completed' AND d >= DATE '{AS_OF}' - INTERVAL 900 DAY""",
                                          "shop_orders", "status_events", extra=[_LIVE_STATE, _NOW, _FLOW]))
def q_live_sales_by_day(spark, sf_dir):
    return dashboard.sales_by_day(spark, _dashboard(spark, sf_dir), AS_OF, 900)


@register("live_top_products", with_views("""
SELECT p.productID, p.name, CAST(SUM(i.quantity) AS BIGINT) AS total_sold, SUM(i.quantity * i.price) AS revenue
FROM now_orders o JOIN order_items i USING (orderID) JOIN products p USING (productID)
WHERE o.status = 'completed' GROUP BY p.productID, p.name
ORDER BY total_sold DESC, p.productID LIMIT 8""", "shop_orders", "products", "order_items", "status_events",
                                          extra=[_LIVE_STATE, _NOW]))
def q_live_top_products(spark, sf_dir):
    t = _t(spark, sf_dir)
    base = dashboard.run_live_top_products(spark, live.event_stream(spark, sf_dir), t, f"live-top-{uuid.uuid4().hex}")
    return dashboard.top_products(spark, base, t.products)


# ======================================================================= stock ledger
# Between the orders, views set a product's stock and clicks switch one on or off.
_CHANGES = """stock_sets AS (
  SELECT event_id * 5 AS seq, event_id % 211 + 1 AS productID, user_id % 90 AS quantity FROM events WHERE event_type = 'view'),
switches AS (
  SELECT event_id * 5 AS seq, event_id % 173 + 1 AS productID, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS is_available
  FROM events WHERE event_type = 'click')"""
_LEDGER = """placed AS (
  SELECT l.l_orderkey AS order_seq, l.l_linenumber AS line_pos, l.l_partkey AS productID, CAST(l.l_quantity AS INT) AS quantity,
         s.seq AS set_seq, COALESCE(s.quantity, p.quantity) AS base, COALESCE(w.is_available, p.is_available) = 1 AS sale
  FROM lineitem l JOIN alloc_stock p ON p.productID = l.l_partkey
  ASOF LEFT JOIN stock_sets s ON s.productID = l.l_partkey AND l.l_orderkey >= s.seq
  ASOF LEFT JOIN switches w ON w.productID = l.l_partkey AND l.l_orderkey >= w.seq),
judged AS (
  SELECT *, base - COALESCE(SUM(CASE WHEN sale THEN quantity ELSE 0 END) OVER (
    PARTITION BY productID, set_seq ORDER BY order_seq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stock_before
  FROM placed)"""


def _ledger(spark, sf_dir):
    li, ev = driver.read_raw(spark, sf_dir, "lineitem"), driver.read_raw(spark, sf_dir, "events")
    lines = li.select(F.col("l_orderkey").alias("order_seq"), F.col("l_linenumber").alias("line_pos"),
                      F.col("l_partkey").alias("productID"), F.col("l_quantity").cast("int").alias("quantity"))
    seq = (F.col("event_id") * 5).alias("order_seq")
    sets = ev.filter("event_type = 'view'").select(seq, (F.col("event_id") % 211 + 1).alias("productID"), (F.col("user_id") % 90).alias("quantity"))
    switches = ev.filter("event_type = 'click'").select(seq, (F.col("event_id") % 173 + 1).alias("productID"),
                                                        F.when(F.col("event_id") % 3 == 0, 0).otherwise(1).alias("is_available"))
    return stock_ledger(lines, sets, switches, _alloc_stock(spark, sf_dir))


@register("stock_ledger", with_views("""
SELECT order_seq, line_pos, productID, quantity, CAST(stock_before AS BIGINT) AS stock_before, sale AND stock_before > 0 AS accepted
FROM judged""", extra=[_ALLOC_STOCK, _CHANGES, _LEDGER]))
def q_stock_ledger(spark, sf_dir):
    return _ledger(spark, sf_dir)["lines"]


@register("stock_ledger_left", with_views("""
SELECT p.productID, CAST(COALESCE(e.quantity, p.quantity) - COALESCE(t.sold, 0) AS BIGINT) AS quantity,
       COALESCE(w.is_available, p.is_available) AS is_available, p.price
FROM alloc_stock p
LEFT JOIN (SELECT productID, MAX(seq) AS seq, arg_max(quantity, seq) AS quantity FROM stock_sets GROUP BY productID) e USING (productID)
LEFT JOIN (SELECT productID, arg_max(is_available, seq) AS is_available FROM switches GROUP BY productID) w USING (productID)
LEFT JOIN (SELECT productID, set_seq, SUM(quantity) AS sold FROM judged WHERE sale AND stock_before > 0 GROUP BY ALL) t
  ON t.productID = p.productID AND t.set_seq IS NOT DISTINCT FROM e.seq""", extra=[_ALLOC_STOCK, _CHANGES, _LEDGER]))
def q_stock_ledger_left(spark, sf_dir):
    return _ledger(spark, sf_dir)["stock"]


# ======================================================================= carts
@register("cart_actions", """
WITH RECURSIVE act AS (
  SELECT user_id % 5 AS cart, event_id % 13 + 1 AS productID, GREATEST(p_size - 3, 0) AS s, event_id % 9 AS v,
         CASE event_type WHEN 'signup' THEN 'add' WHEN 'view' THEN 'add' WHEN 'click' THEN 'plus' WHEN 'purchase' THEN 'minus'
              ELSE CASE WHEN event_id % 4 = 0 THEN 'remove' ELSE 'set' END END AS kind,
         ROW_NUMBER() OVER (PARTITION BY user_id % 5, event_id % 13 ORDER BY event_id) AS i
  FROM events JOIN part ON p_partkey = event_id % 13 + 1),
walk AS (
  SELECT DISTINCT cart, productID, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS q, CAST(0 AS BIGINT) AS refused FROM act
  UNION ALL
  SELECT w.cart, w.productID, a.i,
         CASE kind WHEN 'add' THEN CASE WHEN q < s THEN q + 1 ELSE q END
                   WHEN 'plus' THEN CASE WHEN q > 0 AND q < s THEN q + 1 ELSE q END
                   WHEN 'minus' THEN GREATEST(q - 1, 0) WHEN 'remove' THEN 0
                   ELSE CASE WHEN q > 0 AND v BETWEEN 1 AND s THEN v ELSE q END END,
         refused + CASE WHEN kind = 'add' AND q >= s OR kind = 'plus' AND q > 0 AND q >= s
                          OR kind = 'set' AND q > 0 AND v NOT BETWEEN 1 AND s THEN 1 ELSE 0 END
  FROM walk w JOIN act a ON a.cart = w.cart AND a.productID = w.productID AND a.i = w.i + 1)
SELECT cart, productID, arg_max(q, i) AS quantity, MAX(i) AS actions, arg_max(refused, i) AS refused
FROM walk GROUP BY cart, productID""")
def q_cart_actions(spark, sf_dir):
    """The events as actions in five carts."""
    ev, n, kind = driver.read_raw(spark, sf_dir, "events"), F.col("event_id"), F.col("event_type")
    acts = ev.select((F.col("user_id") % 5).alias("cart"), n.alias("seq"), (n % 13 + 1).alias("productID"), (n % 9).alias("value"),
                     F.when(kind.isin("signup", "view"), "add").when(kind == "click", "plus").when(kind == "purchase", "minus")
                     .when(n % 4 == 0, "remove").otherwise("set").alias("kind"))
    return cart_actions(acts, driver.products(spark, sf_dir))


# ======================================================================= daily sketches
@register("category_sketches", with_views(f"""
SELECT p.category, CAST(SUM(i.quantity) AS BIGINT) AS total_sold, SUM(i.quantity * i.price) AS revenue, TRUE AS close
FROM order_items i JOIN products p USING (productID)
WHERE i.orderID IN (SELECT orderID FROM shop_orders WHERE status = 'completed'
                    AND CAST(orderDateTime AS DATE) BETWEEN DATE '{DATE_FROM}' AND DATE '{DATE_TO}')
GROUP BY p.category""", "shop_orders", "products", "order_items"))
def q_category_sketches(spark, sf_dir):
    """The year's report as a union of daily sketches; ``close`` tells that its distinct
    orders are within 3 % of the exact ones."""
    t = _t(spark, sf_dir)
    some = sketches.category_performance(sketches.daily_sketches(t), DATE_FROM, DATE_TO)
    exact = reports.category_performance(t, DATE_FROM, DATE_TO).select("category", F.col("order_count").alias("n"))
    return some.join(exact, "category").select("category", "total_sold", "revenue", (
        F.abs(F.col("order_count") - F.col("n")) <= F.greatest(F.lit(1.0), 0.03 * F.col("n"))).alias("close"))


# ======================================================================= checks at insert time
_NEW = """new_orders AS (SELECT o_orderkey * 3 AS orderID FROM orders WHERE o_orderkey % 20 = 0
  UNION ALL SELECT o_orderkey * 3 FROM orders WHERE o_orderkey % 300 = 0),
new_items AS (SELECT l_orderkey * 2 AS orderID, l_partkey + CASE WHEN l_partkey % 3 = 0 THEN 1000000 ELSE 0 END AS productID
              FROM lineitem WHERE l_orderkey % 10 = 0)"""


def _new(spark, sf_dir):
    key = F.col("o_orderkey")
    o = driver.read_raw(spark, sf_dir, "orders").select("o_orderkey")
    orders = o.filter(key % 20 == 0).unionAll(o.filter(key % 300 == 0)).select((key * 3).alias("orderID"))
    part = F.col("l_partkey")
    items = driver.read_raw(spark, sf_dir, "lineitem").filter(F.col("l_orderkey") % 10 == 0).select(
        (F.col("l_orderkey") * 2).alias("orderID"), F.when(part % 3 == 0, part + 1000000).otherwise(part).alias("productID"))
    return orders, items


FILTER_BITS = 1 << 24


@register("insert_key_checks", with_views("""
SELECT 'orders' AS table_name, 'orderID' AS key_column, CAST(orderID AS VARCHAR) AS key_value, COUNT(*) AS rows
FROM (SELECT orderID FROM new_orders UNION ALL SELECT orderID FROM shop_orders) u
WHERE orderID IN (SELECT orderID FROM new_orders) GROUP BY orderID HAVING COUNT(*) > 1""", "shop_orders", extra=[_NEW]))
def q_insert_key_checks(spark, sf_dir):
    held = driver.read_raw(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderID"))
    return insert_checks.clashing_keys(_new(spark, sf_dir)[0], held, "orderID", "orders",
                                       insert_checks.key_filter(held, "orderID", FILTER_BITS))


@register("insert_reference_checks", with_views("""
SELECT 'order_items.orderID' AS reference, CAST(orderID AS VARCHAR) AS key_value, COUNT(*) AS rows
FROM new_items WHERE orderID NOT IN (SELECT orderID FROM shop_orders) GROUP BY orderID
UNION ALL
SELECT 'order_items.productID', CAST(productID AS VARCHAR), COUNT(*)
FROM new_items WHERE productID NOT IN (SELECT productID FROM products) GROUP BY productID""", "shop_orders", "products", extra=[_NEW]))
def q_insert_reference_checks(spark, sf_dir):
    items = _new(spark, sf_dir)[1]
    parents = (("orderID", driver.read_raw(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderID"))),
               ("productID", driver.products(spark, sf_dir).select("productID")))
    one, two = (insert_checks.dangling_keys(items, p, k, f"order_items.{k}", insert_checks.key_filter(p, k, FILTER_BITS))
                for k, p in parents)
    return one.unionByName(two)
