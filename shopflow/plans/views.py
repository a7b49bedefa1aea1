"""The FIXTURES.md views as SQL CTEs, for the DuckDB oracle of each query.

The driver registers only the raw tables, so every oracle statement starts with
these CTEs. Text must stay valid in both DuckDB and Spark SQL.
"""

EMPLOYEES = """employees AS (
  SELECT c_custkey AS EmployeeID, c_name AS name,
         CASE WHEN c_custkey % 10 = 0 THEN 'admin' ELSE 'cashier' END AS role
  FROM customer WHERE c_mktsegment = 'BUILDING')"""

PRODUCTS = """products AS (
  SELECT p_partkey AS productID, p_name AS name, p_type AS category,
         CAST(p_retailprice AS DECIMAL(10,2)) AS price, p_size - 3 AS quantity,
         CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 1 END AS is_available
  FROM part)"""

SHOP_ORDERS = """shop_orders AS (
  SELECT o.o_orderkey AS orderID, e.EmployeeID AS EmployeeID,
         concat('Guest ', CAST(o.o_custkey AS VARCHAR(20))) AS customer_name,
         CASE WHEN e.EmployeeID IS NULL THEN 'online' ELSE 'walk-in' END AS order_type,
         CAST(o.o_totalprice AS DECIMAL(10,2)) AS totalAmount, o.o_orderdate AS orderDateTime,
         CASE WHEN o.o_orderstatus = 'F' THEN 'completed' WHEN o.o_orderstatus = 'P' THEN 'preparing'
              WHEN o.o_orderpriority = '1-URGENT' THEN 'cancelled'
              WHEN o.o_orderpriority = '2-HIGH' THEN 'ready' ELSE 'pending' END AS status
  FROM orders o LEFT JOIN employees e ON o.o_custkey = e.EmployeeID)"""

ORDER_ITEMS = """order_items AS (
  SELECT l_orderkey AS orderID, l_partkey AS productID, l_linenumber AS line_no,
         CAST(l_quantity AS INT) AS quantity, CAST(l_extendedprice AS DECIMAL(10,2)) AS price
  FROM lineitem)"""

STATUS_EVENTS = """status_events AS (
  SELECT event_id, ts, user_id AS orderID,
         CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'preparing'
              WHEN 'click' THEN 'ready' WHEN 'purchase' THEN 'completed' ELSE 'cancelled' END AS status
  FROM events)"""

ALL = {
    "employees": EMPLOYEES,
    "products": PRODUCTS,
    "shop_orders": SHOP_ORDERS,
    "order_items": ORDER_ITEMS,
    "status_events": STATUS_EVENTS,
}

# Views another view needs.
_DEPS = {"shop_orders": ["employees"]}


def with_views(body: str, *names: str, extra: list[str] | None = None) -> str:
    """Prefix ``body`` with the CTEs it uses (dependencies first)."""
    order: list[str] = []
    for n in names:
        for d in _DEPS.get(n, []):
            if d not in order:
                order.append(d)
        if n not in order:
            order.append(n)
    ctes = [ALL[n] for n in order] + list(extra or [])
    return "WITH " + ",\n".join(ctes) + "\n" + body
