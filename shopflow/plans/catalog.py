"""Registered queries over the driver tables, each with its DuckDB oracle SQL.

``QUERIES[key](spark, sf_dir) -> DataFrame`` runs the library function on the
whole mapped tables; ``ORACLES[key]`` is the same question in plain SQL over the
raw tables (the FIXTURES views inlined as CTEs). Keys without an oracle are
checked by their own tests (see ``tests/``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.operators import reports
from shopflow.plans.views import with_views
from shopflow.sources import driver

# Fixed parameters of the registered queries (FIXTURES.md).
AS_OF = "2001-08-01"
DATE_FROM = "1998-01-01"
DATE_TO = "1998-12-31"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn
    return deco


def _t(spark, sf_dir):
    return driver.tables(spark, sf_dir)


# ======================================================================= reports
# What each completed order sold of each product: reports add these up, orders first.
def _sold(date_from: str | None = None, date_to: str | None = None) -> str:
    when = f"AND orderDateTime >= DATE '{date_from}' AND orderDateTime < DATE '{date_to}' + INTERVAL 1 DAY" if date_from else ""
    return f"""sold AS (
  SELECT productID, orderID, SUM(quantity) AS units, SUM(quantity * price) AS amount FROM order_items
  WHERE EXISTS (SELECT 1 FROM shop_orders s WHERE s.orderID = order_items.orderID AND s.status = 'completed' {when})
  GROUP BY productID, orderID), per_product AS (
  SELECT productID, CAST(SUM(units) AS BIGINT) AS total_sold, SUM(amount) AS revenue FROM sold GROUP BY productID)"""


_SOLD_YEAR = _sold(DATE_FROM, DATE_TO)


@register("category_performance", with_views("""
SELECT p.category, x.order_count, CAST(SUM(t.total_sold) AS BIGINT) AS total_sold, SUM(t.revenue) AS revenue
FROM per_product t JOIN products p USING (productID)
JOIN (SELECT category, COUNT(*) AS order_count
      FROM (SELECT DISTINCT p2.category, sold.orderID FROM sold JOIN products p2 USING (productID)) d
      GROUP BY category) x USING (category)
GROUP BY p.category, x.order_count""", "shop_orders", "products", "order_items", extra=[_SOLD_YEAR]))
def q_category_performance(spark, sf_dir):
    return reports.category_performance(_t(spark, sf_dir), DATE_FROM, DATE_TO)


_RANKED = "SELECT productID, name, category, total_sold, revenue FROM per_product JOIN products USING (productID)"


@register("product_ranking", with_views(_RANKED, "shop_orders", "products", "order_items", extra=[_SOLD_YEAR]))
def q_product_ranking(spark, sf_dir):
    return reports.product_ranking(_t(spark, sf_dir), DATE_FROM, DATE_TO)


@register("product_rank_positions", with_views(f"""
SELECT r.*, better + 1 AS rank, CASE WHEN better < 3 THEN better + 1 END AS medal
FROM ({_RANKED}) r JOIN (
  SELECT productID, RANK() OVER (ORDER BY -total_sold, productID) - 1 AS better FROM ({_RANKED}) r2) q
USING (productID)""", "shop_orders", "products", "order_items", extra=[_SOLD_YEAR]))
def q_product_rank_positions(spark, sf_dir):
    r = reports.product_ranking(_t(spark, sf_dir), DATE_FROM, DATE_TO)
    return reports.product_rank_positions(r)


@register("top_products", with_views("""
SELECT productID, name, total_sold, revenue FROM per_product JOIN products USING (productID)
QUALIFY ROW_NUMBER() OVER (ORDER BY total_sold DESC, productID) <= 8""",
                                     "shop_orders", "products", "order_items", extra=[_sold()]))
def q_top_products(spark, sf_dir):
    return reports.top_products(_t(spark, sf_dir))


@register("recent_orders", with_views("""
SELECT orderID, customer_name, totalAmount, status, orderDateTime, order_type,
       (SELECT MAX(name) FROM employees e WHERE e.EmployeeID = s.EmployeeID) AS employee_name
FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY orderDateTime DESC, orderID DESC) AS newness FROM shop_orders) s
WHERE newness <= 10""", "shop_orders"))
def q_recent_orders(spark, sf_dir):
    return reports.recent_orders(_t(spark, sf_dir))


@register("order_status_counts", with_views("""
SELECT status, COUNT(*) AS cnt FROM shop_orders GROUP BY status""", "shop_orders"))
def q_order_status_counts(spark, sf_dir):
    return reports.order_status_counts(_t(spark, sf_dir).orders)


# One pass by day and status, from which the figures are picked.
_BY_DAY = """by_day AS (
  SELECT CAST(orderDateTime AS DATE) AS d, status, COUNT(*) AS n, SUM(totalAmount) AS amount FROM shop_orders GROUP BY 1, 2)"""


@register("dashboard_stats", with_views(f"""
SELECT CAST(COALESCE(SUM(n) FILTER (d = DATE '{AS_OF}' AND status <> 'cancelled'), 0) AS BIGINT) AS today_orders,
       COALESCE(SUM(amount) FILTER (d = DATE '{AS_OF}' AND status = 'completed'), 0) AS today_sales,
       COALESCE(SUM(amount) FILTER (status = 'completed'), 0) AS total_sales,
       CAST(COALESCE(SUM(n) FILTER (status = 'pending'), 0) AS BIGINT) AS pending_orders,
       ANY_VALUE(m.product_count) AS product_count
FROM (SELECT COUNT(*) AS product_count FROM products WHERE is_available = 1) m LEFT JOIN by_day ON TRUE""",
                                        "shop_orders", "products", extra=[_BY_DAY]))
def q_dashboard_stats(spark, sf_dir):
    return reports.dashboard_stats(_t(spark, sf_dir), AS_OF)


# Days of completed sales, from which the periods are added up.
_DAYS = """days AS (
  SELECT CAST(orderDateTime AS DATE) AS d, COUNT(*) AS n, SUM(totalAmount) AS amount FROM shop_orders
  WHERE status = 'completed' GROUP BY 1)"""
_SALES_WINDOW_DAYS = 90


@register("sales_by_day_window", with_views(f"""
SELECT d AS date, amount AS total FROM days
WHERE date_diff('day', d, DATE '{AS_OF}') <= {_SALES_WINDOW_DAYS}""", "shop_orders", extra=[_DAYS]))
def q_sales_by_day_window(spark, sf_dir):
    return reports.sales_by_day_window(_t(spark, sf_dir).orders, AS_OF, _SALES_WINDOW_DAYS)


_IN_YEAR = f"d >= DATE '{DATE_FROM}' AND d <= DATE '{DATE_TO}'"


@register("sales_daily", with_views(f"""
SELECT d AS period, n AS order_count, amount AS revenue FROM days WHERE {_IN_YEAR}""",
                                    "shop_orders", extra=[_DAYS]))
def q_sales_daily(spark, sf_dir):
    return reports.sales_daily(_t(spark, sf_dir).orders, DATE_FROM, DATE_TO)


@register("sales_weekly", with_views("""
SELECT concat(CAST(isoyear(d) AS VARCHAR), '-W', lpad(CAST(week(d) AS VARCHAR), 2, '0')) AS period,
       CAST(SUM(n) AS BIGINT) AS order_count, SUM(amount) AS revenue
FROM days WHERE d >= DATE '1995-01-01' AND d <= DATE '2001-08-01' GROUP BY 1""", "shop_orders", extra=[_DAYS]))
def q_sales_weekly(spark, sf_dir):
    return reports.sales_weekly(_t(spark, sf_dir).orders, "1995-01-01", AS_OF)


_MONTHS = f"""SELECT left(CAST(d AS VARCHAR), 7) AS period, CAST(SUM(n) AS BIGINT) AS order_count,
       SUM(amount) AS revenue FROM days WHERE {_IN_YEAR} GROUP BY 1"""


@register("sales_monthly", with_views(_MONTHS, "shop_orders", extra=[_DAYS]))
def q_sales_monthly(spark, sf_dir):
    return reports.sales_monthly(_t(spark, sf_dir).orders, DATE_FROM, DATE_TO)


@register("sales_with_total", with_views(f"""
SELECT period, order_count, revenue, 0 AS is_total FROM ({_MONTHS}) m
UNION ALL
SELECT 'TOTAL', CAST(SUM(order_count) AS BIGINT), SUM(revenue), 1 FROM ({_MONTHS}) m
HAVING COUNT(*) > 0""", "shop_orders", extra=[_DAYS]))
def q_sales_with_total(spark, sf_dir):
    return reports.sales_with_total(_t(spark, sf_dir).orders, DATE_FROM, DATE_TO, "monthly")


@register("active_order_count", with_views("""
SELECT COUNT(*) AS active_orders FROM shop_orders
WHERE status IN ('pending', 'preparing', 'ready')""", "shop_orders"))
def q_active_order_count(spark, sf_dir):
    return reports.active_order_count(_t(spark, sf_dir).orders)


@register("active_orders_union", with_views("""
SELECT o.*, b.branch FROM shop_orders o
JOIN (VALUES ('ready', 0), ('preparing', 1), ('pending', 2)) b(status, branch) USING (status)""", "shop_orders"))
def q_active_orders_union(spark, sf_dir):
    return reports.active_orders_union(_t(spark, sf_dir).orders)


# Further registrations (imported last: they use ``register`` defined above).
from shopflow.plans import catalog_changes, catalog_lists  # noqa: E402,F401,I001
from shopflow.plans import catalog_live  # noqa: E402,F401
