"""Registered change jobs, streaming views and sinks.

Stand-in inputs are built from the driver tables only as rows in the schema a
job expects (cart lines from lineitem, status changes from events, ...); the
jobs themselves do all the work.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shopflow.operators import changes, joins
from shopflow.operators.allocation import stock_allocation
from shopflow.plans.catalog import DATE_FROM, DATE_TO, _t, register
from shopflow.plans.views import with_views
from shopflow.session import scratch_path
from shopflow.sources import driver, export, payloads
from shopflow.streaming import dashboard, live

# ----------------------------------------------------------------- stand-in inputs
# Stock for allocation (FIXTURES): p_size * 20, availability as in products.
_ALLOC_STOCK = """alloc_stock AS (
  SELECT p_partkey AS productID, p_size * 20 AS quantity,
         CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 1 END AS is_available,
         CAST(p_retailprice AS DECIMAL(10,2)) AS price
  FROM part)"""


def _alloc_stock(spark, sf_dir):
    p = driver.read_raw(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("productID"),
                    (F.col("p_size") * 20).alias("quantity"),
                    F.when(F.col("p_partkey") % 7 == 0, 0).otherwise(1).alias("is_available"),
                    F.col("p_retailprice").cast("decimal(10,2)").alias("price"))


def _intake_inputs(spark, sf_dir):
    """Headers from orders (table number from the customer key, employee from
    the mapped employees), text lines from lineitem."""
    o = driver.read_raw(spark, sf_dir, "orders")
    emp = driver.employees(spark, sf_dir).select("EmployeeID")
    h = o.join(emp, o["o_custkey"] == emp["EmployeeID"], "left").select(
        F.col("o_orderkey").alias("order_seq"),
        F.concat(F.lit(" Guest "), F.col("o_custkey").cast("string"), F.lit("\t")).alias("customer_name"),
        (F.col("o_custkey") % 25).cast("string").alias("table_number"),
        "EmployeeID", F.lit(True).alias("has_items"))
    li = driver.read_raw(spark, sf_dir, "lineitem")
    ln = li.select(F.col("l_orderkey").alias("order_seq"), F.col("l_linenumber").alias("line_pos"),
                   F.col("l_partkey").cast("string").alias("productID"),
                   F.col("l_quantity").cast("int").cast("string").alias("quantity"))
    return h, ln


_INTAKE_CTES = [_ALLOC_STOCK, """hdr AS (
  SELECT o.o_orderkey AS order_seq, e.EmployeeID,
         CASE WHEN o.o_custkey % 25 <> 0
              THEN concat('[Table ', CAST(o.o_custkey % 25 AS VARCHAR), '] Guest ', CAST(o.o_custkey AS VARCHAR))
              ELSE concat('Guest ', CAST(o.o_custkey AS VARCHAR)) END AS customer_name,
         CASE WHEN o.o_custkey % 25 <> 0 THEN 'online'
              WHEN e.EmployeeID IS NOT NULL THEN 'walk-in' ELSE 'online' END AS order_type
  FROM orders o LEFT JOIN employees e ON o.o_custkey = e.EmployeeID)""", """req AS (
  SELECT l_orderkey AS order_seq, l_partkey AS productID, SUM(GREATEST(1, CAST(l_quantity AS INT))) AS req
  FROM lineitem GROUP BY l_orderkey, l_partkey)""", """dec AS (
  SELECT r.order_seq, r.productID, r.req,
         s.quantity - COALESCE(SUM(r.req) OVER (PARTITION BY r.productID ORDER BY r.order_seq
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stock_before,
         s.is_available
  FROM req r JOIN alloc_stock s ON r.productID = s.productID)""", """acc AS (
  SELECT l.l_orderkey AS order_seq, l.l_linenumber AS line_pos, l.l_partkey AS productID,
         GREATEST(1, CAST(l.l_quantity AS INT)) AS quantity, s.price
  FROM lineitem l JOIN dec d ON l.l_orderkey = d.order_seq AND l.l_partkey = d.productID
  JOIN alloc_stock s ON s.productID = l.l_partkey
  WHERE d.is_available = 1 AND d.stock_before > 0)"""]


def _intake(spark, sf_dir):
    h, ln = _intake_inputs(spark, sf_dir)
    return changes.orders_intake(h, ln, _alloc_stock(spark, sf_dir))


@register("orders_intake", with_views("""
SELECT h.order_seq AS orderID, h.EmployeeID, h.customer_name, h.order_type,
       SUM(a.quantity * a.price) AS totalAmount, 'pending' AS status
FROM hdr h JOIN acc a ON a.order_seq = h.order_seq
GROUP BY h.order_seq, h.EmployeeID, h.customer_name, h.order_type""", "employees",
                                      extra=_INTAKE_CTES))
def q_orders_intake(spark, sf_dir):
    return _intake(spark, sf_dir)["orders"]


@register("intake_items", with_views(
    "SELECT order_seq, line_pos, productID, CAST(quantity AS BIGINT) AS quantity, price FROM acc", "employees", extra=_INTAKE_CTES))
def q_intake_items(spark, sf_dir):
    return _intake(spark, sf_dir)["items"]


@register("intake_stock", with_views("""
SELECT s.productID, CAST(s.quantity - COALESCE(t.sold, 0) AS BIGINT) AS quantity, s.is_available, s.price
FROM alloc_stock s LEFT JOIN (SELECT productID, SUM(quantity) AS sold FROM acc GROUP BY productID) t
  ON s.productID = t.productID""", "employees", extra=_INTAKE_CTES))
def q_intake_stock(spark, sf_dir):
    return _intake(spark, sf_dir)["stock"]


@register("intake_rejects", with_views("""
SELECT order_seq, 'No valid items in cart' AS reason FROM hdr
WHERE order_seq NOT IN (SELECT order_seq FROM acc)""", "employees", extra=_INTAKE_CTES))
def q_intake_rejects(spark, sf_dir):
    return _intake(spark, sf_dir)["rejects"]


@register("read_order_payloads", """
SELECT l_orderkey AS order_seq, k AS line_pos, CASE k WHEN 0 THEN CAST(l_partkey AS VARCHAR) END AS productID,
       CASE k WHEN 1 THEN 'x' ELSE CASE l_linenumber % 3 WHEN 0 THEN concat(CAST(CAST(l_quantity AS INT) AS VARCHAR), 'x')
              ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END END AS quantity
FROM lineitem, (VALUES (0), (1)) v(k)
WHERE l_linenumber % 5 < 3 AND (k = 0 OR l_linenumber % 2 = 0)""")
def q_read_order_payloads(spark, sf_dir):
    """JSON bodies from the lines: one or two items, numbers and text, empty carts, and
    text that is no JSON; parsed back into lines."""
    li = driver.read_raw(spark, sf_dir, "lineitem")
    n, qty = F.col("l_linenumber"), F.col("l_quantity").cast("int").cast("string")
    first = F.concat(F.lit('{"productID": '), "l_partkey", F.lit(', "quantity": '), F.when(
        n % 3 == 0, F.concat(F.lit('"'), qty, F.lit('x"'))).otherwise(qty), F.lit("}"))
    items = F.concat(F.lit("["), first, F.when(n % 2 == 0, ', {"quantity": "x"}').otherwise(""), F.lit("]"))
    body = (F.when(n % 5 == 3, F.concat(F.lit('{"items": '), F.substring(items, 1, 9)))
            .when(n % 5 == 4, F.lit('{"customer_name": "Guest", "items": []}'))
            .otherwise(F.concat(F.lit('{"customer_name": "Guest", "items": '), items, F.lit("}"))))
    p = li.select(F.col("l_orderkey").alias("order_seq"), body.alias("body"),
                  F.lit(None).cast("long").alias("EmployeeID"))
    return payloads.read_order_payloads(p)[1]


@register("stock_allocation", with_views("""
SELECT l.l_orderkey AS orderID, l.l_partkey AS productID, l.l_linenumber AS line_no,
       CAST(l.l_quantity AS INT) AS quantity, CAST(d.stock_before AS BIGINT) AS stock_before,
       (d.is_available = 1 AND d.stock_before > 0) AS accepted
FROM lineitem l JOIN dec d ON l.l_orderkey = d.order_seq AND l.l_partkey = d.productID""",
                                         "employees", extra=_INTAKE_CTES))
def q_stock_allocation(spark, sf_dir):
    it = _t(spark, sf_dir).order_items.select("orderID", "productID", "line_no", "quantity")
    return stock_allocation(it, _alloc_stock(spark, sf_dir), seq="orderID").select(
        "orderID", "productID", "line_no", "quantity", "stock_before", "accepted")


@register("order_type_rule", """
SELECT o.o_orderkey AS orderID,
  CASE WHEN o.o_custkey % 25 <> 0 THEN 'online'
       WHEN e.c_custkey IS NOT NULL THEN 'walk-in' ELSE 'online' END AS order_type
FROM orders o LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') e
  ON o.o_custkey = e.c_custkey""")
def q_order_type_rule(spark, sf_dir):
    h, _ = _intake_inputs(spark, sf_dir)
    from shopflow.functions.scalars import js_int
    return h.select(F.col("order_seq").alias("orderID"),
                    changes.order_type_rule(js_int("table_number"), F.col("EmployeeID")).alias("order_type"))


@register("customer_label", r"""
SELECT c_custkey AS customer_id,
  CASE WHEN c_nationkey <> 0 THEN concat('[Table ', CAST(c_nationkey AS VARCHAR), '] ', lbl) ELSE lbl END
    AS customer_name
FROM (SELECT c_custkey, c_nationkey,
        CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Customer'
             ELSE regexp_replace(regexp_replace(concat(chr(9), c_name, '<"''>', '  '),
                                                '^\s+|\s+$', '', 'g'), '[<>"'']', '', 'g') END AS lbl
      FROM customer) t""")
def q_customer_label(spark, sf_dir):
    c = driver.read_raw(spark, sf_dir, "customer")
    name = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("")).otherwise(
        F.concat(F.lit("\t"), "c_name", F.lit("<\"'>"), F.lit("  ")))
    return c.select(F.col("c_custkey").alias("customer_id"),
                    changes.customer_label(name, F.col("c_nationkey")).alias("customer_name"))


@register("cart_totals", with_views("""
SELECT orderID, SUM(price * quantity) AS total, CAST(SUM(quantity) AS BIGINT) AS item_count
FROM order_items GROUP BY orderID""", "order_items"))
def q_cart_totals(spark, sf_dir):
    return changes.cart_totals(_t(spark, sf_dir).order_items)


@register("cart_merge", with_views("""
SELECT a.orderID, a.productID, p.price, CAST(LEAST(a.want, p.quantity) AS BIGINT) AS quantity
FROM (SELECT orderID, productID, SUM(quantity) AS want FROM order_items GROUP BY orderID, productID) a
JOIN products p ON a.productID = p.productID WHERE p.quantity > 0 AND p.is_available = 1""",
                                   "order_items", "products"))
def q_cart_merge(spark, sf_dir):
    t = _t(spark, sf_dir)
    return changes.cart_merge(t.order_items.select("orderID", "productID", "quantity"), t.products)


@register("stock_decrement", with_views("""
SELECT p.productID, p.name, p.category, p.price,
       CAST(p.quantity - COALESCE(s.sold, 0) AS BIGINT) AS quantity, p.is_available
FROM products p LEFT JOIN (
  SELECT oi.productID, SUM(oi.quantity) AS sold FROM order_items oi
  JOIN shop_orders o ON oi.orderID = o.orderID WHERE o.status = 'pending' GROUP BY oi.productID) s
  ON p.productID = s.productID""", "products", "order_items", "shop_orders"))
def q_stock_decrement(spark, sf_dir):
    t = _t(spark, sf_dir)
    pend = t.orders.filter(F.col("status") == "pending").select("orderID")
    sold = t.order_items.join(pend, "orderID", "left_semi")
    return changes.stock_decrement(t.products, sold)


@register("stock_set", with_views("""
SELECT p.productID, p.name, p.category, p.price,
       CAST(COALESCE(u.q, p.quantity) AS BIGINT) AS quantity, p.is_available
FROM products p LEFT JOIN (
  SELECT productID, q FROM (
    SELECT l_partkey AS productID, CAST(l_quantity AS INT) * 250 - 500 AS q,
           ROW_NUMBER() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC,
                              CAST(l_quantity AS INT) * 250 - 500 DESC) AS rn
    FROM lineitem WHERE l_orderkey % 97 <> 0 AND CAST(l_quantity AS INT) * 250 - 500 BETWEEN 0 AND 9999) r
  WHERE rn = 1) u ON p.productID = u.productID""", "products"))
def q_stock_set(spark, sf_dir):
    return _stock_set(spark, sf_dir)[0]


def _stock_set(spark, sf_dir):
    """Updates from lineitem, some out of bounds; every 97th is of no known product."""
    t = _t(spark, sf_dir)
    li = driver.read_raw(spark, sf_dir, "lineitem")
    upd = li.select(F.when(F.col("l_orderkey") % 97 == 0, -1 - F.col("l_partkey")).otherwise(F.col("l_partkey")).alias("productID"),
                    F.col("l_orderkey").alias("seq"), (F.col("l_quantity").cast("int") * 250 - 500).alias("quantity"))
    return changes.stock_set(t.products, upd)


@register("stock_set_rejects", """
SELECT CASE WHEN l_orderkey % 97 = 0 THEN -1 - l_partkey ELSE l_partkey END AS productID, l_orderkey AS seq,
       CAST(l_quantity AS INT) * 250 - 500 AS quantity,
       CASE WHEN l_quantity * 250 - 500 < 0 THEN 'Quantity cannot be negative'
            WHEN l_quantity * 250 - 500 > 9999 THEN 'Quantity is too high' ELSE 'No such product' END AS reason
FROM lineitem WHERE l_orderkey % 97 = 0 OR l_quantity * 250 - 500 NOT BETWEEN 0 AND 9999""")
def q_stock_set_rejects(spark, sf_dir):
    return _stock_set(spark, sf_dir)[1]


@register("status_apply", with_views("""
SELECT o.orderID, o.EmployeeID, o.customer_name, o.order_type, o.totalAmount, o.orderDateTime,
       COALESCE(u.st, o.status) AS status
FROM shop_orders o LEFT JOIN (
  SELECT orderID, st FROM (
    SELECT e.orderID, CASE WHEN e.status = 'ready' AND s.order_type = 'walk-in' THEN 'completed'
                           ELSE e.status END AS st,
           ROW_NUMBER() OVER (PARTITION BY e.orderID ORDER BY e.ts DESC, e.event_id DESC) AS rn
    FROM status_events e JOIN shop_orders s ON e.orderID = s.orderID) r
  WHERE rn = 1) u ON o.orderID = u.orderID""", "shop_orders", "status_events"))
def q_status_apply(spark, sf_dir):
    t = _t(spark, sf_dir)
    return changes.status_apply(t.orders, driver.status_events(spark, sf_dir))


# Product changes: two per supplier, the second without a quantity where its key is even,
# with a bad price or quantity for some; half of them for products that exist.
_PRODUCT_CHANGES = """product_changes AS (
  SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE s_suppkey + 1000000 END AS productID, k AS seq,
         concat(s_name, ' v', CAST(k AS VARCHAR)) AS name,
         CASE WHEN s_suppkey % 11 = 0 AND k = 1 THEN NULL
              ELSE CAST(CAST(s_acctbal AS DECIMAL(10,2)) + 1000 + k AS DECIMAL(10,2)) END AS price,
         CASE WHEN s_suppkey % 4 < 2 AND k = 1 THEN NULL ELSE s_nationkey + k END AS quantity,
         s_suppkey % 13 = 0 AND k = 0 AS bad_quantity,
         CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END AS is_available
  FROM supplier, (VALUES (0), (1)) v(k))"""


def _product_changes(spark, sf_dir):
    s, key = driver.read_raw(spark, sf_dir, "supplier"), F.col("s_suppkey")
    s = s.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    k = F.col("k")
    price = (F.col("s_acctbal").cast("decimal(10,2)") + 1000 + k).cast("string")
    qty = (F.col("s_nationkey") + k).cast("string")
    return s.select(
        F.when(key % 2 == 0, key).otherwise(key + 1000000).alias("productID"), k.alias("seq"),
        F.concat(F.lit(" \u00a0"), "s_name", F.lit(" v"), k.cast("string"), F.lit("\n")).alias("name"),
        F.lit("PROMO").alias("category"),
        F.when((key % 11 == 0) & (k == 1), "free").otherwise(price).alias("price"),
        F.when((key % 13 == 0) & (k == 0), "some").when((key % 4 < 2) & (k == 1), F.lit(None)).otherwise(qty)
        .alias("quantity"),
        F.lit(None).cast("string").alias("image"),
        F.when(key % 3 == 0, "0").alias("is_available"))


@register("catalogue_upsert", with_views("""
SELECT COALESCE(p.productID, c.productID) AS productID, COALESCE(c.name, p.name) AS name,
       CASE WHEN c.productID IS NULL THEN p.category ELSE 'PROMO' END AS category,
       COALESCE(c.price, p.price) AS price,
       CAST(CASE WHEN c.quantity IS NOT NULL THEN c.quantity ELSE COALESCE(p.quantity, 0) END AS BIGINT) AS quantity,
       COALESCE(c.is_available, p.is_available) AS is_available
FROM products p FULL OUTER JOIN (
  SELECT * FROM product_changes WHERE price IS NOT NULL AND NOT bad_quantity
  QUALIFY ROW_NUMBER() OVER (PARTITION BY productID ORDER BY seq DESC) = 1) c ON p.productID = c.productID""",
                                         "products", extra=[_PRODUCT_CHANGES]))
def q_catalogue_upsert(spark, sf_dir):
    return changes.catalogue_upsert(_t(spark, sf_dir).products, _product_changes(spark, sf_dir))[0]


@register("catalogue_upsert_rejects", with_views("""
SELECT productID, seq, name,
       CASE WHEN price IS NULL THEN 'Price must be a number' ELSE 'Quantity cannot be negative' END AS reason
FROM product_changes WHERE price IS NULL OR bad_quantity""", "products", extra=[_PRODUCT_CHANGES]))
def q_catalogue_upsert_rejects(spark, sf_dir):
    return changes.catalogue_upsert(_t(spark, sf_dir).products, _product_changes(spark, sf_dir))[1]


# Deletes of products with little stock, where only this year's items still refer to products.
_RECENT_ITEMS = """recent_items AS (
  SELECT * FROM order_items WHERE orderID IN (
    SELECT orderID FROM shop_orders WHERE orderDateTime >= TIMESTAMP '2001-06-01 00:00:00')),
gone AS (SELECT productID FROM products WHERE quantity < 3)"""


def _catalogue_delete(spark, sf_dir):
    t = _t(spark, sf_dir)
    recent = t.orders.filter(F.col("orderDateTime") >= F.lit("2001-06-01").cast("timestamp_ntz")).select("orderID")
    items = t.order_items.join(recent, "orderID", "left_semi")
    deletes = t.products.filter(F.col("quantity") < 3).select("productID")
    return changes.catalogue_delete(t.products, items, deletes)


@register("catalogue_delete", with_views("""
SELECT p.* FROM products p LEFT JOIN gone g USING (productID)
WHERE g.productID IS NULL OR EXISTS (SELECT 1 FROM recent_items r WHERE r.productID = p.productID)""",
                                         "products", "order_items", "shop_orders", extra=[_RECENT_ITEMS]))
def q_catalogue_delete(spark, sf_dir):
    return _catalogue_delete(spark, sf_dir)[0]


@register("catalogue_delete_refused", with_views(
    "SELECT productID FROM gone INTERSECT SELECT productID FROM recent_items",
    "products", "order_items", "shop_orders", extra=[_RECENT_ITEMS]))
def q_catalogue_delete_refused(spark, sf_dir):
    return _catalogue_delete(spark, sf_dir)[1]


@register("employee_delete_set_null", with_views("""
SELECT o.orderID, CASE WHEN e.role = 'admin' THEN NULL ELSE o.EmployeeID END AS EmployeeID,
       o.customer_name, o.order_type, o.totalAmount, o.orderDateTime, o.status
FROM shop_orders o LEFT JOIN employees e ON o.EmployeeID = e.EmployeeID""", "shop_orders"))
def q_employee_delete_set_null(spark, sf_dir):
    t = _t(spark, sf_dir)
    removed = t.employees.filter(F.col("role") == "admin")
    return changes.employee_delete_set_null(t.orders, t.employees, removed)[0]


@register("order_delete_cascade", with_views("""
SELECT oi.* FROM order_items oi
WHERE oi.orderID NOT IN (SELECT orderID FROM shop_orders WHERE status = 'cancelled')""",
                                             "order_items", "shop_orders"))
def q_order_delete_cascade(spark, sf_dir):
    t = _t(spark, sf_dir)
    removed = t.orders.filter(F.col("status") == "cancelled")
    return changes.order_delete_cascade(t.orders, t.order_items, removed)[1]


# Payments from the events: typed text of every kind, some of orders that don't exist.
_PAYMENTS = """typed AS (
  SELECT event_id AS payment_id, CASE WHEN event_id % 10 = 0 THEN -user_id ELSE user_id * 7 END AS orderID,
         CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN '-5' WHEN 3 THEN '1000000'
              WHEN 4 THEN concat(' ', CAST(event_id AS VARCHAR), ' pesos')
              ELSE concat(CAST(event_id % 500 AS VARCHAR), '999.50') END AS cash,
         CASE event_id % 9 WHEN 1 THEN NULL WHEN 2 THEN -5 WHEN 3 THEN 1000000 WHEN 4 THEN event_id
              ELSE CAST(concat(CAST(event_id % 500 AS VARCHAR), '999.50') AS DECIMAL(20,2)) END AS number
  FROM events), judged AS (
  SELECT t.payment_id, t.orderID, o.order_type, o.status, o.totalAmount, t.cash, {number} AS value,
         CASE WHEN o.orderID IS NULL THEN 'No such order'
              WHEN o.status IN ('completed', 'cancelled') THEN 'Order is already closed'
              {walkin}
              WHEN t.cash = '' THEN 'Please enter cash received'
              WHEN {number} IS NULL OR {number} < 0 THEN 'Invalid cash amount'
              {cap}
              WHEN {number} < o.totalAmount THEN 'Cash is less than the total amount' END AS reason
  FROM typed t LEFT JOIN shop_orders o USING (orderID)), settled AS (
  SELECT * EXCLUDE (reason), CASE WHEN reason IS NOT NULL THEN reason
    WHEN ROW_NUMBER() OVER (PARTITION BY orderID, reason IS NULL ORDER BY payment_id) > 1
    THEN 'Order is already paid' END AS reason
  FROM judged)"""
_SETTLED = """SELECT payment_id, orderID, order_type, status, totalAmount,
       CAST({value} AS DECIMAL(20,2)) AS cash_value, reason IS NULL AS accepted, reason,
       CASE WHEN reason IS NULL THEN CAST(value - totalAmount AS DECIMAL(20,2)) END AS change_due,
       CASE WHEN reason = 'Cash is less than the total amount'
            THEN CAST(totalAmount - value AS DECIMAL(20,2)) END AS shortfall,
       CASE WHEN reason IS NULL THEN 'completed' ELSE status END AS new_status,
       (reason IS NULL AND COALESCE(status IN ('pending', 'preparing'), FALSE)) AS early
FROM settled"""


def _payments(spark, sf_dir):
    ev, n = driver.read_raw(spark, sf_dir, "events"), F.col("event_id")
    large = F.concat((n % 500).cast("string"), F.lit("999.50"))
    cash = (F.when(n % 9 == 0, "").when(n % 9 == 1, "abc").when(n % 9 == 2, "-5").when(n % 9 == 3, "1000000")
            .when(n % 9 == 4, F.concat(F.lit(" "), n.cast("string"), F.lit(" pesos"))).otherwise(large))
    return ev.select(n.alias("payment_id"), F.when(n % 10 == 0, -F.col("user_id")).otherwise(F.col("user_id") * 7)
                     .alias("orderID"), cash.alias("cash"))


_COLLECT = _PAYMENTS.format(
    number="CASE WHEN t.cash = '' THEN 0 ELSE COALESCE(t.number, 0) END", cap="",
    walkin="WHEN o.order_type = 'walk-in' THEN 'Walk-in order: paid at checkout'")
_COUNTER = _PAYMENTS.format(
    number="CASE WHEN t.cash = '' THEN NULL ELSE t.number END", walkin="",
    cap="WHEN t.number > 999999 THEN 'Cash amount is too large'")


@register("payment_settlement", with_views(_SETTLED.format(value="value"), "shop_orders", extra=[_COLLECT]))
def q_payment_settlement(spark, sf_dir):
    return changes.payment_settlement(_t(spark, sf_dir).orders, _payments(spark, sf_dir))


@register("payment_at_counter", with_views(_SETTLED.format(value="value"), "shop_orders", extra=[_COUNTER]))
def q_payment_at_counter(spark, sf_dir):
    return changes.payment_settlement(_t(spark, sf_dir).orders, _payments(spark, sf_dir), counter=True)


# ======================================================================= streaming
_LIVE_STATE = """live AS (
  SELECT orderID, st AS status FROM (
    SELECT e.orderID, CASE WHEN e.status = 'ready' AND s.order_type = 'walk-in' THEN 'completed'
                           ELSE e.status END AS st,
           ROW_NUMBER() OVER (PARTITION BY e.orderID ORDER BY e.ts DESC, e.event_id DESC) AS rn
    FROM status_events e JOIN shop_orders s ON e.orderID = s.orderID) r WHERE rn = 1)"""


def _live_current(spark, sf_dir, name):
    t = _t(spark, sf_dir)
    ev = live.event_stream(spark, sf_dir)
    path = live.run_live_status(spark, ev, t.orders, f"{name}-{uuid.uuid4().hex}")
    return t, live.current_from_changelog(spark, path)


@register("live_order_status", with_views("SELECT * FROM live", "shop_orders", "status_events",
                                          extra=[_LIVE_STATE]))
def q_live_order_status(spark, sf_dir):
    """Stream the events directory (availableNow) through the stateful
    latest-status aggregate; return the state as left by the stream."""
    return _live_current(spark, sf_dir, "live-status")[1]


@register("live_kitchen_queue", with_views("""
SELECT o.orderID, o.customer_name, o.order_type, o.orderDateTime, COALESCE(l.status, o.status) AS status
FROM shop_orders o LEFT JOIN live l ON o.orderID = l.orderID
WHERE COALESCE(l.status, o.status) IN ('pending', 'preparing')""", "shop_orders", "status_events",
                                           extra=[_LIVE_STATE]))
def q_live_kitchen_queue(spark, sf_dir):
    t, cur = _live_current(spark, sf_dir, "live-kitchen")
    return live.live_kitchen_queue(t.orders, cur)


@register("live_status_counts", with_views("""
SELECT COALESCE(l.status, o.status) AS status, COUNT(*) AS cnt
FROM shop_orders o LEFT JOIN live l ON o.orderID = l.orderID
GROUP BY COALESCE(l.status, o.status)""", "shop_orders", "status_events", extra=[_LIVE_STATE]))
def q_live_status_counts(spark, sf_dir):
    """Dashboard counts kept by retraction from the stored ones."""
    t = _t(spark, sf_dir)
    ev = live.event_stream(spark, sf_dir)
    base = dashboard.run_live_dashboard(spark, ev, t.orders, f"live-dash-{uuid.uuid4().hex}")
    return dashboard.status_counts(spark, base)


@register("live_daily_sales", """
SELECT CAST(ts AS DATE) AS day, COUNT(*) AS orders, SUM(CAST(value AS DECIMAL(12,2))) AS sales
FROM events WHERE event_type = 'purchase' GROUP BY CAST(ts AS DATE)""")
def q_live_daily_sales(spark, sf_dir):
    ev = live.event_stream(spark, sf_dir)
    path = live.run_daily_sales(spark, ev, f"live-sales-{uuid.uuid4().hex}")
    return live.daily_sales_from_changelog(spark, path)


_SNAP = """SELECT orderID FROM (
  SELECT orderID, status, ROW_NUMBER() OVER (PARTITION BY orderID ORDER BY ts DESC, event_id DESC) AS rn
  FROM status_events WHERE ts <= TIMESTAMP '{at}') r
WHERE rn = 1 AND status IN ('pending', 'preparing')"""


@register("new_order_diff", with_views(f"""
SELECT orderID FROM ({_SNAP.format(at='2024-01-16 00:00:00')}) cur
WHERE orderID NOT IN ({_SNAP.format(at='2024-01-15 00:00:00')})
  AND EXISTS ({_SNAP.format(at='2024-01-15 00:00:00')})""", "status_events"))
def q_new_order_diff(spark, sf_dir):
    upd = driver.status_events(spark, sf_dir)
    cur = live.queue_snapshot(upd, "2024-01-16 00:00:00")
    prev = live.queue_snapshot(upd, "2024-01-15 00:00:00")
    return live.new_order_diff(cur, prev)


# ======================================================================= sinks
# Orders someone took, then those that nobody did, in one list of columns under the fixed header.
_EXPORTED = """exported AS (
  SELECT s.*, name AS taken_by FROM shop_orders s JOIN employees USING (EmployeeID)
  UNION ALL BY NAME
  SELECT s.*, '—' AS taken_by FROM shop_orders s WHERE EmployeeID IS NULL)"""


@register("orders_csv_export", with_views(f"""
SELECT format('{{}}', orderID) AS "Order ID", customer_name AS Customer, order_type AS Type, CAST(totalAmount AS VARCHAR) AS Total,
       status AS Status, replace(left(CAST(orderDateTime AS VARCHAR), 19), ' ', 'T') AS "Date & Time", taken_by AS Employee
FROM exported WHERE year(orderDateTime) = {DATE_FROM[:4]}""", "shop_orders", extra=[_EXPORTED]))
def q_orders_csv_export(spark, sf_dir):
    """Write the export as quoted CSV, then read the files back as text."""
    rows = export.orders_csv_rows(_t(spark, sf_dir), DATE_FROM, DATE_TO)
    path = export.write_orders_csv(rows, scratch_path(spark, f"export-{uuid.uuid4().hex}"),
                                   DATE_FROM, DATE_TO)
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)


_DOCUMENTS = """
SELECT o.orderID, o.EmployeeID, o.customer_name, o.order_type, o.totalAmount, o.status, e.name AS employee_name,
       i.productID, i.quantity AS item_quantity, i.price AS item_price, p.name AS product_name, p.category
FROM shop_orders o LEFT JOIN employees e ON e.EmployeeID = o.EmployeeID
LEFT JOIN (order_items i JOIN products p ON p.productID = i.productID) ON i.orderID = o.orderID
{where}"""


def _flat_documents(docs):
    """Documents (one row an order, nested items) as one row per item."""
    return docs.select("orderID", "EmployeeID", "customer_name", "order_type", "totalAmount", "status",
                       "employee_name", F.explode_outer("items").alias("i")).select(
        "orderID", "EmployeeID", "customer_name", "order_type", "totalAmount", "status", "employee_name",
        "i.productID", F.col("i.quantity").alias("item_quantity"), F.col("i.price").alias("item_price"),
        "i.product_name", "i.category")


@register("orders_json_export", with_views(_DOCUMENTS.format(where=""), "shop_orders", "order_items", "products"))
def q_orders_json_export(spark, sf_dir):
    """Every order as a JSON document with its items, null fields kept; written, read
    back with the documents' schema and unfolded."""
    t = _t(spark, sf_dir)
    docs = joins.order_detail(t.orders, t.employees, t.order_items, t.products)
    path = export.write_orders_json(docs, scratch_path(spark, f"json-{uuid.uuid4().hex}"))
    return _flat_documents(spark.read.schema(docs.schema).json(path))


@register("order_by_id", with_views(_DOCUMENTS.format(where="WHERE o.orderID = 77"),
                                    "shop_orders", "order_items", "products"))
def q_order_by_id(spark, sf_dir):
    t = _t(spark, sf_dir)
    return _flat_documents(joins.order_by_id(77, t.orders, t.employees, t.order_items, t.products))
