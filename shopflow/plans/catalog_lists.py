"""Registered list, filter, join, inventory, scalar and quality queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shopflow.functions import scalars as S
from shopflow.operators import deep_pages, filters, inventory, joins, quality, reports, search_index
from shopflow.plans.catalog import AS_OF, DATE_FROM, DATE_TO, _t, register
from shopflow.plans.views import with_views
from shopflow.schema import ORDERS, Tables
from shopflow.session import scratch_path
from shopflow.sources import driver

_RANGE = f"CAST(orderDateTime AS DATE) BETWEEN DATE '{DATE_FROM}' AND DATE '{DATE_TO}'"
_O_RANGE = f"CAST(o.orderDateTime AS DATE) BETWEEN DATE '{DATE_FROM}' AND DATE '{DATE_TO}'"
_CATS = "['ECONOMY', 'SMALL', 'MEDIUM', 'LARGE', 'STANDARD', 'PROMO']"


# ======================================================================= projections
@register("project_columns", with_views("""
SELECT orderID, customer_name, order_type, orderDateTime, status, totalAmount AS "Total Amount"
FROM shop_orders""", "shop_orders"))
def q_project_columns(spark, sf_dir):
    o = _t(spark, sf_dir).orders
    return o.select("orderID", "customer_name", "order_type", "orderDateTime", "status",
                    F.col("totalAmount").alias("Total Amount"))


@register("line_totals", with_views("""
SELECT orderID, productID, line_no, quantity, price, quantity * price AS line_total
FROM order_items""", "order_items"))
def q_line_totals(spark, sf_dir):
    it = _t(spark, sf_dir).order_items
    return it.withColumn("line_total", F.col("quantity") * F.col("price"))


def _image_stand_in():
    # Stand-in image paths from part columns (the driver data has no images).
    return (F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("http://img/"), F.col("p_partkey").cast("string")))
            .when(F.col("p_size") % 4 == 1, F.concat(F.lit("/img/"), F.col("p_partkey").cast("string")))
            .when(F.col("p_size") % 4 == 2, F.concat(F.lit("img/"), F.col("p_partkey").cast("string")))
            .otherwise(F.lit(None).cast("string")))


@register("product_image_path", """
SELECT productID, CASE WHEN image IS NULL OR image = '' THEN NULL
  WHEN starts_with(image, 'http') OR starts_with(image, '/') OR starts_with(image, '../') THEN image
  ELSE concat('../', image) END AS image_src
FROM (SELECT p_partkey AS productID,
        CASE WHEN p_size % 4 = 0 THEN concat('http://img/', CAST(p_partkey AS VARCHAR))
             WHEN p_size % 4 = 1 THEN concat('/img/', CAST(p_partkey AS VARCHAR))
             WHEN p_size % 4 = 2 THEN concat('img/', CAST(p_partkey AS VARCHAR)) END AS image
      FROM part) t""")
def q_product_image_path(spark, sf_dir):
    p = driver.read_raw(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("productID"), _image_stand_in().alias("image"))
    return p.select("productID", S.product_image_path("image").alias("image_src"))


# ======================================================================= filters
@register("products_list", with_views("""
SELECT * FROM products WHERE category = 'SMALL' AND is_available = 1""", "products"))
def q_products_list(spark, sf_dir):
    t = _t(spark, sf_dir)
    return filters.products_list(t.products, "SMALL", 1, t.categories)


@register("category_ordinal_sort", with_views(f"""
SELECT *, list_position({_CATS}, category) AS category_ordinal FROM products""", "products"))
def q_category_ordinal_sort(spark, sf_dir):
    t = _t(spark, sf_dir)
    return filters.category_ordinal_sort(t.products, t.categories).withColumn(
        "category_ordinal", F.col("category_ordinal").cast("int"))


@register("product_by_id", with_views("SELECT * FROM products WHERE productID = 7", "products"))
def q_product_by_id(spark, sf_dir):
    return filters.product_by_id(_t(spark, sf_dir).products, 7)


_SEARCH_SQL = "(CAST(o.orderID AS VARCHAR) LIKE '%{s}%' OR lower(o.customer_name) LIKE lower('%{s}%'))"


@register("orders_list", with_views(f"""
SELECT page.*, (SELECT MAX(name) FROM employees e WHERE e.EmployeeID = page.EmployeeID) AS employee_name
FROM (SELECT o.* FROM shop_orders o WHERE o.status = 'completed' AND {_O_RANGE} AND {_SEARCH_SQL.format(s='1')}
      QUALIFY ROW_NUMBER() OVER (ORDER BY o.orderDateTime DESC, o.orderID DESC) BETWEEN 11 AND 60) page""",
                                    "shop_orders"))
def q_orders_list(spark, sf_dir):
    t = _t(spark, sf_dir)
    return filters.orders_list(t.orders, t.employees, "completed", DATE_FROM, DATE_TO, "1", 50, 10)


@register("orders_search", with_views(f"""
SELECT * FROM shop_orders o WHERE {_SEARCH_SQL.format(s='7_3')}""", "shop_orders"))
def q_orders_search(spark, sf_dir):
    return filters.orders_search(_t(spark, sf_dir).orders, "7_3")


@register("orders_in_date_range", with_views(f"SELECT * FROM shop_orders WHERE {_RANGE}", "shop_orders"))
def q_orders_in_date_range(spark, sf_dir):
    return filters.orders_in_date_range(_t(spark, sf_dir).orders, DATE_FROM, DATE_TO)


@register("active_kitchen_orders", with_views(
    "SELECT * FROM shop_orders WHERE status IN ('pending', 'preparing')", "shop_orders"))
def q_active_kitchen_orders(spark, sf_dir):
    return filters.active_kitchen_orders(_t(spark, sf_dir).orders)


@register("kitchen_fifo", with_views("""
SELECT orderID, customer_name, order_type, orderDateTime, status FROM shop_orders
WHERE status IN ('pending', 'preparing')""", "shop_orders"))
def q_kitchen_fifo(spark, sf_dir):
    o = _t(spark, sf_dir).orders.select("orderID", "customer_name", "order_type", "orderDateTime", "status")
    return filters.kitchen_fifo(o.filter(F.col("status").isin("pending", "preparing")))


@register("not_cancelled_on_day", with_views("""
SELECT * FROM shop_orders WHERE CAST(orderDateTime AS DATE) = DATE '1997-03-15'
  AND status <> 'cancelled'""", "shop_orders"))
def q_not_cancelled_on_day(spark, sf_dir):
    return filters.not_cancelled_on_day(_t(spark, sf_dir).orders, "1997-03-15")


@register("low_stock", with_views("SELECT * FROM products WHERE quantity <= 10", "products"))
def q_low_stock(spark, sf_dir):
    return filters.low_stock(_t(spark, sf_dir).products)


@register("sellable_products", with_views(
    "SELECT * FROM products WHERE is_available = 1 AND quantity > 0", "products"))
def q_sellable_products(spark, sf_dir):
    return filters.sellable_products(_t(spark, sf_dir).products)


@register("menu_search", with_views("""
SELECT * FROM products WHERE category = 'SMALL' AND contains(lower(name), 'blue')""", "products"))
def q_menu_search(spark, sf_dir):
    return filters.menu_search(_t(spark, sf_dir).products, "SMALL", "Blue")


@register("catalogue_search", with_views("""
SELECT * FROM products
WHERE (contains(lower(name), 'pro') OR contains(lower(category), 'pro')) AND is_available = 1""",
                                         "products"))
def q_catalogue_search(spark, sf_dir):
    return filters.catalogue_search(_t(spark, sf_dir).products, "Pro", "", "1")


@register("report_range_defaults", with_views("""
SELECT CAST(orderDateTime AS DATE) AS period, COUNT(*) AS order_count, SUM(totalAmount) AS revenue
FROM shop_orders WHERE status = 'completed'
  AND orderDateTime >= TIMESTAMP '1998-03-01 00:00:00' AND orderDateTime < TIMESTAMP '1998-03-18 00:00:00'
GROUP BY CAST(orderDateTime AS DATE)""", "shop_orders"))
def q_report_range_defaults(spark, sf_dir):
    """The default range as of 17 March 1998: from the first of that month."""
    f, t = filters.report_range_defaults("1998-03-17")
    return reports.sales_daily(_t(spark, sf_dir).orders, f, t)


@register("orders_param_sql", with_views(f"""
SELECT orderID, customer_name, status, totalAmount, orderDateTime FROM shop_orders
WHERE status = 'ready' AND {_RANGE}""", "shop_orders"))
def q_orders_param_sql(spark, sf_dir):
    return filters.orders_param_sql(_t(spark, sf_dir).orders, "ready", DATE_FROM, DATE_TO)


@register("orders_page", with_views("""
SELECT * FROM shop_orders ORDER BY orderDateTime DESC, orderID DESC LIMIT 200 OFFSET 100""",
                                    "shop_orders"))
def q_orders_page(spark, sf_dir):
    return filters.orders_page(_t(spark, sf_dir).orders, limit=200, offset=100)


@register("orders_page_after", with_views("""
SELECT * FROM shop_orders
WHERE orderDateTime < TIMESTAMP '1998-06-01 00:00:00'
   OR (orderDateTime = TIMESTAMP '1998-06-01 00:00:00' AND orderID < 5000)
ORDER BY orderDateTime DESC, orderID DESC LIMIT 200""", "shop_orders"))
def q_orders_page_after(spark, sf_dir):
    return filters.orders_page_after(_t(spark, sf_dir).orders, "1998-06-01 00:00:00", 5000, limit=200)


@register("orders_page_deep", with_views("""
SELECT * EXCLUDE (newness)
FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY orderDateTime DESC, orderID DESC) AS newness FROM shop_orders) s
WHERE newness BETWEEN 1001 AND 1200""", "shop_orders"))
def q_orders_page_deep(spark, sf_dir):
    """An offset found by the map of counts, with zones small enough that it narrows."""
    return deep_pages.orders_page_at(_t(spark, sf_dir).orders, limit=200, offset=1000, zone_rows=16)


@register("order_count_by_map", with_views("SELECT COUNT(*) AS result_count FROM shop_orders", "shop_orders"))
def q_order_count_by_map(spark, sf_dir):
    return deep_pages.total_rows(deep_pages.day_counts(_t(spark, sf_dir).orders))


@register("orders_search_indexed", with_views("""
SELECT * FROM shop_orders
WHERE CAST(orderID AS VARCHAR) LIKE '%st 14%5%' OR regexp_matches(customer_name, '(?i)st 14.*5')""", "shop_orders"))
def q_orders_search_indexed(spark, sf_dir):
    """Orders and their index written to the shared folder, then searched."""
    place = scratch_path(spark, f"search-{uuid.uuid4().hex}")
    _t(spark, sf_dir).orders.repartitionByRange("orderID").write.parquet(f"{place}/orders")
    orders = spark.read.schema(ORDERS).parquet(f"{place}/orders")
    search_index.write_index(orders, f"{place}/index")
    return search_index.orders_search(orders, spark.read.parquet(f"{place}/index"), "st 14%5")


@register("result_count", with_views(f"""
SELECT COUNT(*) AS result_count FROM shop_orders o
WHERE o.status = 'pending' AND {_SEARCH_SQL.format(s='9')}""", "shop_orders"))
def q_result_count(spark, sf_dir):
    return filters.result_count(_t(spark, sf_dir).orders, status="pending", search="9")


# ======================================================================= joins
@register("orders_with_employee", with_views("""
SELECT o.*, names[o.EmployeeID] AS employee_name
FROM shop_orders o, (SELECT map_from_entries(list((EmployeeID, name))) AS names FROM employees) m""", "shop_orders"))
def q_orders_with_employee(spark, sf_dir):
    t = _t(spark, sf_dir)
    return joins.orders_with_employee(t.orders, t.employees)


@register("items_with_product", with_views("""
SELECT oi.*, p.name AS product_name, p.category
FROM order_items oi JOIN products p ON oi.productID = p.productID""", "order_items", "products"))
def q_items_with_product(spark, sf_dir):
    t = _t(spark, sf_dir)
    return joins.items_with_product(t.order_items, t.products)


@register("sales_lines", with_views(f"""
SELECT oi.*, o.orderDateTime, p.name, p.category, oi.quantity * oi.price AS line_total
FROM order_items oi JOIN shop_orders o ON oi.orderID = o.orderID
JOIN products p ON oi.productID = p.productID
WHERE o.status = 'completed' AND {_O_RANGE}""", "shop_orders", "order_items", "products"))
def q_sales_lines(spark, sf_dir):
    return joins.sales_lines(_t(spark, sf_dir), DATE_FROM, DATE_TO)


@register("order_detail", with_views("""
SELECT o.*, e.name AS employee_name, it.productID, it.item_quantity, it.item_price,
       it.product_name, it.category
FROM shop_orders o LEFT JOIN employees e ON o.EmployeeID = e.EmployeeID
LEFT JOIN (SELECT oi.orderID, oi.productID, oi.quantity AS item_quantity, oi.price AS item_price,
                  p.name AS product_name, p.category
           FROM order_items oi JOIN products p ON oi.productID = p.productID) it
  ON it.orderID = o.orderID""", "shop_orders", "order_items", "products"))
def q_order_detail(spark, sf_dir):
    t = _t(spark, sf_dir)
    return joins.order_detail_flat(t.orders, t.employees, t.order_items, t.products)


@register("kitchen_tickets", with_views("""
SELECT o.orderID, o.customer_name, o.order_type, o.orderDateTime, o.status, it.quantity,
       it.product_name
FROM shop_orders o
LEFT JOIN (SELECT oi.orderID, oi.quantity, p.name AS product_name
           FROM order_items oi JOIN products p ON oi.productID = p.productID) it
  ON it.orderID = o.orderID
WHERE o.status IN ('pending', 'preparing')""", "shop_orders", "order_items", "products"))
def q_kitchen_tickets(spark, sf_dir):
    t = _t(spark, sf_dir)
    return joins.kitchen_ticket_lines(t.orders, t.order_items, t.products)


_CART = "SELECT orderID AS cart_id, productID, quantity FROM order_items"


@register("cart_priced", with_views(f"""
SELECT c.cart_id, c.productID, c.quantity, p.price
FROM ({_CART}) c JOIN products p ON c.productID = p.productID
WHERE p.is_available = 1 AND p.quantity > 0""", "order_items", "products"))
def q_cart_priced(spark, sf_dir):
    t = _t(spark, sf_dir)
    cart = t.order_items.select(F.col("orderID").alias("cart_id"), "productID", "quantity")
    return joins.cart_priced(cart, t.products)[0]


@register("cart_rejects", with_views(f"""
SELECT DISTINCT cart_id, 'No valid items in cart' AS reason FROM ({_CART}) c
WHERE cart_id NOT IN (
  SELECT c2.cart_id FROM ({_CART}) c2 JOIN products p ON c2.productID = p.productID
  WHERE p.is_available = 1 AND p.quantity > 0)""", "order_items", "products"))
def q_cart_rejects(spark, sf_dir):
    t = _t(spark, sf_dir)
    cart = t.order_items.select(F.col("orderID").alias("cart_id"), "productID", "quantity")
    return joins.cart_priced(cart, t.products)[1]


# ======================================================================= inventory
_SUMMARY = """SELECT COUNT(*) AS total_products,
  COUNT(*) FILTER (WHERE quantity <= 0) AS out_of_stock,
  COUNT(*) FILTER (WHERE quantity > 0 AND quantity <= 10) AS low_stock,
  COUNT(*) FILTER (WHERE quantity > 10) AS in_stock FROM products"""


@register("inventory_summary", with_views(_SUMMARY, "products"))
def q_inventory_summary(spark, sf_dir):
    return inventory.inventory_summary(_t(spark, sf_dir).products)


@register("stock_alert", with_views(
    f"SELECT *, (low_stock > 0 OR out_of_stock > 0) AS alert FROM ({_SUMMARY}) s", "products"))
def q_stock_alert(spark, sf_dir):
    return inventory.stock_alert(_t(spark, sf_dir).products)


@register("stock_level", with_views("""
SELECT productID, name, category, quantity,
  CASE WHEN quantity <= 0 THEN 'Out' WHEN quantity <= 10 THEN 'Low' ELSE 'Good' END AS stock_level,
  CASE WHEN quantity <= 0 THEN 100 WHEN quantity <= 10 THEN LEAST(quantity * 10, 100)
       ELSE LEAST(quantity * 2, 100) END AS bar_pct
FROM products""", "products"))
def q_stock_level(spark, sf_dir):
    return inventory.stock_levels(_t(spark, sf_dir).products)


# ======================================================================= scalars
@register("fn_dates", with_views(f"""
SELECT orderID, CAST(orderDateTime AS DATE) AS day,
       CAST(orderDateTime AS DATE) >= DATE '{AS_OF}' - INTERVAL 7 DAY AS in_last_7,
       CAST(year(orderDateTime) AS INT) AS year,
       strftime(orderDateTime, '%G-W%V') AS iso_week,
       strftime(orderDateTime, '%Y-%m') AS month
FROM shop_orders""", "shop_orders"))
def q_fn_dates(spark, sf_dir):
    o = _t(spark, sf_dir).orders
    return o.select("orderID", S.to_day("orderDateTime").alias("day"),
                    (S.to_day("orderDateTime") >= S.days_back(AS_OF, 7)).alias("in_last_7"),
                    F.year("orderDateTime").alias("year"),
                    S.iso_week_label("orderDateTime").alias("iso_week"),
                    S.month_label("orderDateTime").alias("month"))


@register("fn_strings", """
SELECT c_custkey AS customer_id,
       concat('[Table ', CAST(c_nationkey AS VARCHAR), '] ', c_name) AS label,
       lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS padded,
       regexp_replace(concat(chr(9), ' ', c_name, ' ', chr(10)), '^\\s+|\\s+$', '', 'g') AS js_trimmed,
       replace(c_name, '#', '') AS stripped,
       contains(lower(c_name), '00001') AS has_text,
       CAST(c_custkey AS VARCHAR) LIKE '%1_' AS id_like
FROM customer""")
def q_fn_strings(spark, sf_dir):
    c = driver.read_raw(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("customer_id"),
        F.concat(F.lit("[Table "), F.col("c_nationkey").cast("string"), F.lit("] "), "c_name").alias("label"),
        F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("padded"),
        S.js_trim(F.concat(F.lit("\t "), "c_name", F.lit(" \n"))).alias("js_trimmed"),
        F.regexp_replace("c_name", "#", "").alias("stripped"),
        S.contains_ci("c_name", "00001").alias("has_text"),
        F.col("c_custkey").cast("string").like("%1_").alias("id_like"))


@register("fn_conditionals", """
SELECT o_orderkey AS orderID,
       COALESCE(e.EmployeeID, -1) AS employee_or_default,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'rush' ELSE 'normal' END AS speed,
       CASE WHEN o_custkey % 3 = 0 THEN '' ELSE CAST(o_custkey % 3 - 1 AS VARCHAR) END AS falsy_text,
       CASE WHEN o_custkey % 3 = 0 THEN -7 ELSE o_custkey % 3 END AS falsy_number,
       CAST(CASE WHEN o_custkey % 3 = 0 THEN -0.5 ELSE o_custkey % 3 / 2.0 END AS DOUBLE) AS falsy_double
FROM orders LEFT JOIN (SELECT c_custkey AS EmployeeID FROM customer WHERE c_mktsegment = 'BUILDING') e
  ON o_custkey = e.EmployeeID""")
def q_fn_conditionals(spark, sf_dir):
    t = _t(spark, sf_dir)
    o = driver.read_raw(spark, sf_dir, "orders")
    e = t.employees.select("EmployeeID")
    j = o.join(e, o["o_custkey"] == e["EmployeeID"], "left")
    return j.select(
        F.col("o_orderkey").alias("orderID"),
        S.default_if_null("EmployeeID", -1).alias("employee_or_default"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "rush").otherwise("normal").alias("speed"),
        F.regexp_replace(S.default_if_falsy(
            F.when(F.col("o_custkey") % 3 == 0, "").otherwise((F.col("o_custkey") % 3 - 1).cast("string")),
            "default"), "default", "").alias("falsy_text"),
        S.default_if_falsy(F.col("o_custkey") % 3, -7).alias("falsy_number"),
        S.default_if_falsy((F.col("o_custkey") % 3) / 2, -0.5).alias("falsy_double"))


@register("fn_js_int", """
SELECT event_id,
  TRY_CAST(NULLIF(regexp_extract(CAST(value AS VARCHAR), '^\\s*([+-]?\\d+)', 1), '') AS BIGINT) AS from_value,
  TRY_CAST(NULLIF(regexp_extract(props, '([+-]?\\d+)', 1), '') AS BIGINT) AS from_props,
  GREATEST(1, TRY_CAST(NULLIF(regexp_extract(concat(' ', CAST(user_id - 5 AS VARCHAR), 'x'),
      '^\\s*([+-]?\\d+)', 1), '') AS BIGINT)) AS qty
FROM events""")
def q_fn_js_int(spark, sf_dir):
    ev = driver.read_raw(spark, sf_dir, "events")
    return ev.select(
        "event_id", S.js_int(F.col("value").cast("string")).alias("from_value"),
        # The text from the first digit or sign of the properties on: digits, then anything.
        S.js_int(F.regexp_extract("props", r"[+-]?\d.*", 0)).alias("from_props"),
        S.at_least_one(S.js_int(F.concat(F.lit(" "), (F.col("user_id") - 5).cast("string"),
                                         F.lit("x")))).alias("qty"))


@register("fn_money", with_views("""
SELECT orderID, format('{:,.2f}', totalAmount) AS amount_text FROM shop_orders""", "shop_orders"))
def q_fn_money(spark, sf_dir):
    o = _t(spark, sf_dir).orders
    return o.select("orderID", S.money_text("totalAmount").alias("amount_text"))


@register("elapsed_wait", with_views("""
SELECT orderID, CASE
  WHEN s < 60 THEN concat(CAST(s AS VARCHAR), 's')
  WHEN s < 3600 THEN concat(CAST(s // 60 AS VARCHAR), 'm ', CAST(s % 60 AS VARCHAR), 's')
  ELSE concat(CAST(s // 3600 AS VARCHAR), 'h ', CAST((s % 3600) // 60 AS VARCHAR), 'm') END AS waiting
FROM (SELECT orderID, CAST(epoch(TIMESTAMP '2001-08-01 12:00:00') - epoch(orderDateTime) AS BIGINT) AS s
      FROM shop_orders WHERE status IN ('pending', 'preparing')) t""", "shop_orders"))
def q_elapsed_wait(spark, sf_dir):
    o = filters.active_kitchen_orders(_t(spark, sf_dir).orders)
    now = F.lit("2001-08-01 12:00:00").cast("timestamp_ntz")
    return o.select("orderID", S.elapsed_wait("orderDateTime", now).alias("waiting"))


@register("relative_age", with_views("""
SELECT orderID, CASE
  WHEN s < 60 THEN concat(CAST(s AS VARCHAR), 's ago')
  WHEN s < 3600 THEN concat(CAST(s // 60 AS VARCHAR), 'm ago')
  WHEN s < 86400 THEN concat(CAST(s // 3600 AS VARCHAR), 'h ago')
  ELSE strftime(orderDateTime, '%Y-%m-%d') END AS age
FROM (SELECT orderID, orderDateTime,
             CAST(epoch(TIMESTAMP '2001-08-01 00:00:30') - epoch(orderDateTime) AS BIGINT) AS s
      FROM shop_orders) t""", "shop_orders"))
def q_relative_age(spark, sf_dir):
    o = _t(spark, sf_dir).orders
    now = F.lit("2001-08-01 00:00:30").cast("timestamp_ntz")
    return o.select("orderID", S.relative_age("orderDateTime", now).alias("age"))


@register("hash_secret", with_views(
    "SELECT EmployeeID, sha256(name) AS secret_hash FROM employees", "employees"))
def q_hash_secret(spark, sf_dir):
    e = _t(spark, sf_dir).employees
    return e.select("EmployeeID", S.hash_secret("name").alias("secret_hash"))


# ======================================================================= quality
@register("validate_products", with_views(f"""
SELECT *, reason IS NULL AS valid FROM (
  SELECT *, CASE
    WHEN name IS NULL OR trim(name) = '' THEN 'Product name is required'
    WHEN length(trim(name)) > 100 THEN 'Product name is too long'
    WHEN category IS NULL OR NOT list_contains({_CATS}, category) THEN 'Please select a category'
    WHEN price IS NULL OR price <= 0 THEN 'Price must be greater than 0'
    WHEN price > 99999 THEN 'Price is too high'
    WHEN quantity IS NULL OR quantity < 0 THEN 'Quantity cannot be negative'
    WHEN quantity > 9999 THEN 'Quantity is too high' END AS reason
  FROM products) t""", "products"))
def q_validate_products(spark, sf_dir):
    t = _t(spark, sf_dir)
    return quality.validate_products(t.products, t.categories)


# Names of every kind from the customers': as they are, without '#', blank, with a
# no-break space around or inside, too long, with other letters.
_NAMES = """names AS (
  SELECT CASE c_custkey % 7 WHEN 0 THEN c_name WHEN 1 THEN replace(c_name, '#', ' ')
         WHEN 2 THEN '  ' WHEN 3 THEN concat(chr(160), replace(c_name, '#', '-'), chr(160))
         WHEN 4 THEN concat('O''Neil', chr(8195), 'Jr.') WHEN 5 THEN repeat('ab ', 40)
         ELSE concat('Zoë ', CAST(c_custkey AS VARCHAR)) END AS customer_name,
         CASE c_custkey % 7 WHEN 0 THEN 'Name contains invalid characters' WHEN 5 THEN 'Name is too long'
         WHEN 6 THEN 'Name contains invalid characters' END AS reason
  FROM customer)"""


@register("validate_customer_name", with_views(
    "SELECT customer_name, reason, reason IS NULL AS valid FROM names", extra=[_NAMES]))
def q_validate_customer_name(spark, sf_dir):
    c, n = driver.read_raw(spark, sf_dir, "customer"), F.col("c_custkey") % 7
    name = (F.when(n == 0, F.col("c_name")).when(n == 1, F.replace("c_name", F.lit("#"), F.lit(" ")))
            .when(n == 2, "  ").when(n == 3, F.concat(F.lit("\u00a0"), F.replace("c_name", F.lit("#"), F.lit("-")),
                                                      F.lit("\u00a0")))
            .when(n == 4, "O'Neil\u2003Jr.").when(n == 5, "ab " * 40)
            .otherwise(F.concat(F.lit("Zoë "), F.col("c_custkey").cast("string"))))
    return quality.validate_customer_name(c.select(name.alias("customer_name")))


def _odd_tables(spark, sf_dir) -> Tables:
    """The mapped tables with values, keys and references that break the rules: statuses,
    types, roles and categories outside their domains, repeated keys and user names, and
    rows that refer to nothing."""
    t = _t(spark, sf_dir)
    o, n = t.orders, F.col("orderID")
    o = o.withColumn("status", F.when(n % 50 == 0, "lost").when(n % 51 == 0, F.lit(None)).otherwise(F.col("status")))
    o = o.withColumn("order_type", F.when(n % 40 == 0, "phone").otherwise(F.col("order_type")))
    o = o.withColumn("EmployeeID", F.when(n % 30 == 0, n * 1000).otherwise(F.col("EmployeeID")))
    o = o.withColumn("orderID", F.when(n % 25 == 0, n - 1).otherwise(n))
    e = t.employees.withColumn("role", F.when(F.col("EmployeeID") % 4 == 0, "chef").otherwise(F.col("role")))
    e = e.withColumn("username", F.concat(F.lit("user"), (F.col("EmployeeID") % 100).cast("string")))
    p = t.products.withColumn("category", F.when(F.col("productID") % 3 == 0, "MISC").otherwise(F.col("category")))
    p = p.filter(F.col("productID") % 7 != 0)
    i = t.order_items.withColumn("id", n * 8 + F.col("line_no"))
    return Tables(employees=e, products=p, orders=o, order_items=i, categories=t.categories)


_ODD = """odd_orders AS (
  SELECT CASE WHEN orderID % 25 = 0 THEN orderID - 1 ELSE orderID END AS orderID,
         CASE WHEN orderID % 50 = 0 THEN 'lost' WHEN orderID % 51 = 0 THEN NULL ELSE status END AS status,
         CASE WHEN orderID % 40 = 0 THEN 'phone' ELSE order_type END AS order_type,
         CASE WHEN orderID % 30 = 0 THEN orderID * 1000 ELSE EmployeeID END AS EmployeeID
  FROM shop_orders), odd_employees AS (
  SELECT EmployeeID, CASE WHEN EmployeeID % 4 = 0 THEN 'chef' ELSE role END AS role,
         concat('user', CAST(EmployeeID % 100 AS VARCHAR)) AS username FROM employees), odd_products AS (
  SELECT productID, CASE WHEN productID % 3 = 0 THEN 'MISC' ELSE category END AS category
  FROM products WHERE productID % 7 <> 0), odd_items AS (
  SELECT orderID * 8 + line_no AS id, orderID, productID FROM order_items)"""
_ODD_VIEWS = ("shop_orders", "products", "order_items")


@register("domain_checks", with_views(f"""
SELECT 'orders' AS table_name, 'status' AS column_name, status AS value, COUNT(*) AS rows FROM odd_orders
WHERE NOT COALESCE(list_contains(['pending', 'preparing', 'ready', 'completed', 'cancelled'], status), FALSE)
GROUP BY status
UNION ALL SELECT 'orders', 'order_type', order_type, COUNT(*) FROM odd_orders
WHERE order_type NOT IN ('online', 'walk-in') GROUP BY order_type
UNION ALL SELECT 'employees', 'role', role, COUNT(*) FROM odd_employees
WHERE role NOT IN ('admin', 'cashier') GROUP BY role
UNION ALL SELECT 'products', 'category', category, COUNT(*) FROM odd_products
WHERE NOT list_contains({_CATS}, category) GROUP BY category""", *_ODD_VIEWS, extra=[_ODD]))
def q_domain_checks(spark, sf_dir):
    return quality.domain_checks(_odd_tables(spark, sf_dir))


@register("key_checks", with_views(" UNION ALL ".join(
    f"""SELECT '{table}' AS table_name, '{key}' AS key_column, CAST({key} AS VARCHAR) AS key_value,
    COUNT(*) AS rows FROM {view} GROUP BY {key} HAVING COUNT(*) > 1"""
    for view, table, key in (("odd_employees", "employees", "EmployeeID"), ("odd_employees", "employees", "username"),
                             ("odd_products", "products", "productID"), ("odd_orders", "orders", "orderID"),
                             ("odd_items", "order_items", "id"))), *_ODD_VIEWS, extra=[_ODD]))
def q_key_checks(spark, sf_dir):
    return quality.key_checks(_odd_tables(spark, sf_dir))


@register("reference_checks", with_views(" UNION ALL ".join(
    f"""SELECT '{child}.{key}' AS reference, CAST(c.{key} AS VARCHAR) AS key_value, COUNT(*) AS rows
    FROM odd_{view} c WHERE c.{key} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} q WHERE q.{key} = c.{key})
    GROUP BY c.{key}"""
    for child, view, key, parent in (("order_items", "items", "orderID", "odd_orders"),
                                     ("order_items", "items", "productID", "odd_products"),
                                     ("orders", "orders", "EmployeeID", "odd_employees"))), *_ODD_VIEWS, extra=[_ODD]))
def q_reference_checks(spark, sf_dir):
    return quality.reference_checks(_odd_tables(spark, sf_dir))


def _loaded(spark, sf_dir):
    """Write the mapped tables as a new version under the checkpoint folder and
    read them back with their declared schemas."""
    import uuid

    from shopflow.session import scratch_path
    from shopflow.sources.tables import load_tables, write_tables

    base = scratch_path(spark, f"tables-{uuid.uuid4().hex}")
    write_tables(_t(spark, sf_dir), base)
    return load_tables(spark, base)


@register("load_tables", with_views("SELECT * FROM shop_orders", "shop_orders"))
def q_load_tables(spark, sf_dir):
    return _loaded(spark, sf_dir).orders.drop("order_month")


@register("load_tables_items", with_views(
    "SELECT orderID, productID, quantity, price FROM order_items", "order_items"))
def q_load_tables_items(spark, sf_dir):
    return _loaded(spark, sf_dir).order_items.drop("id")


@register("load_tables_products", with_views("""
SELECT productID, name, category, price, CAST(quantity AS BIGINT) AS quantity, is_available FROM products""", "products"))
def q_load_tables_products(spark, sf_dir):
    return _loaded(spark, sf_dir).products.drop("image", "created_at")


@register("load_tables_employees", with_views("SELECT * FROM employees", "employees"))
def q_load_tables_employees(spark, sf_dir):
    return _loaded(spark, sf_dir).employees.select("EmployeeID", "name", "role")
