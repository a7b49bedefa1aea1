"""Equi-joins of the shop model (left joins to employees, items to products/orders).

No join here broadcasts a side whose size grows with the data: the planner's
size thresholds (``spark.sql.autoBroadcastJoinThreshold`` on plan statistics,
AQE's on runtime statistics) decide, with sort-merge join beyond them and AQE
skew splitting for hot keys. Null join keys, which would all hash to one
partition, are spread by a second key (:func:`left_join_nullable_key`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import shopflow.schema as S
from shopflow.operators.filters import completed_in_range


def left_join_nullable_key(left: DataFrame, right: DataFrame, key: str,
                           spread: str = "orderID") -> DataFrame:
    """``left LEFT JOIN right USING (key)`` where many left keys may be null.

    Null keys never match, but a sort-merge join would hash them all into one
    partition (online orders have no employee: possibly most of the table). A
    second key spreads them: a hash of the row's ``spread`` column where the key
    is null, else 0, which is what every right row has. One scan of each side."""
    extra = [c for c in right.columns if c != key]
    salted = left.withColumn("_salt", F.when(F.col(key).isNull(), F.xxhash64(spread)).otherwise(F.lit(0).cast("long")))
    joined = salted.join(right.withColumn("_salt", F.lit(0).cast("long")), [key, "_salt"], "left")
    return joined.select(*left.columns, *extra)


def orders_with_employee(orders: DataFrame, employees: DataFrame) -> DataFrame:
    """Every order with the name of its employee, null where it has none."""
    e = employees.select("EmployeeID", F.col("name").alias("employee_name"))
    return left_join_nullable_key(orders, e, "EmployeeID")


def attach_employee_name(small_orders: DataFrame, employees: DataFrame) -> DataFrame:
    """Left-join employee names onto a top-k or a page, once. The sizes that Spark
    sees decide which side is broadcast, if any."""
    return orders_with_employee(small_orders, employees)


def items_with_product(order_items: DataFrame, products: DataFrame) -> DataFrame:
    """``order_items oi JOIN products p`` with product name and category."""
    p = products.select("productID", F.col("name").alias("product_name"), "category")
    return order_items.join(p, "productID", "inner")


def sales_lines(tables, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Fact of all reports: items of completed orders (optionally in an inclusive
    date range) with product name and category and the line total."""
    o = completed_in_range(tables.orders, date_from, date_to).select("orderID", "orderDateTime")
    lines = tables.order_items.join(o, "orderID", "inner")
    p = tables.products.select("productID", "name", "category")
    return lines.join(p, "productID", "inner").withColumn(
        "line_total", F.col("quantity") * F.col("price"))


def order_detail(orders: DataFrame, employees: DataFrame, order_items: DataFrame,
                 products: DataFrame) -> DataFrame:
    """Every order with employee name and its item list (nested, one row per order).

    Items are grouped per order before joining back, so the join is 1:1 on
    orderID. Orders without (joinable) items get an empty list.
    """
    it = items_with_product(order_items, products)
    nested = it.groupBy("orderID").agg(
        F.sort_array(F.collect_list(F.struct(
            "productID", "quantity", "price", "product_name", "category"))).alias("items"))
    base = orders_with_employee(orders, employees)
    return base.join(nested, "orderID", "left").withColumn(
        "items", F.coalesce(F.col("items"), F.array().cast(nested.schema["items"].dataType)))


def order_detail_flat(orders: DataFrame, employees: DataFrame, order_items: DataFrame,
                      products: DataFrame) -> DataFrame:
    """Flattened order detail: one row per item of every order; an order without
    items keeps one row with null item columns (the nested form's empty list)."""
    base = orders_with_employee(orders, employees)
    it = items_with_product(order_items, products).select(
        "orderID", "productID", F.col("quantity").alias("item_quantity"),
        F.col("price").alias("item_price"), "product_name", "category")
    return base.join(it, "orderID", "left")


def kitchen_tickets(orders: DataFrame, order_items: DataFrame, products: DataFrame) -> DataFrame:
    """Active (pending/preparing) orders, oldest first, each with its items
    ``(quantity, product_name)``; no items gives an empty list."""
    active = orders.filter(F.col("status").isin("pending", "preparing")).select(
        "orderID", "customer_name", "order_type", "orderDateTime", "status")
    it = items_with_product(order_items.join(active.select("orderID"), "orderID", "left_semi"),
                            products)
    nested = it.groupBy("orderID").agg(
        F.sort_array(F.collect_list(F.struct("product_name", "quantity"))).alias("items"))
    out = active.join(nested, "orderID", "left")
    out = out.withColumn("items", F.coalesce(F.col("items"), F.array().cast(nested.schema["items"].dataType)))
    return out.orderBy("orderDateTime", "orderID")


def kitchen_ticket_lines(orders: DataFrame, order_items: DataFrame, products: DataFrame) -> DataFrame:
    """Flat form of :func:`kitchen_tickets`: one row per item of an active order;
    an active order without items keeps one row with null item columns."""
    active = orders.filter(F.col("status").isin("pending", "preparing")).select(
        "orderID", "customer_name", "order_type", "orderDateTime", "status")
    own = order_items.join(active.select("orderID"), "orderID", "left_semi")
    it = items_with_product(own, products).select("orderID", "quantity", "product_name")
    return active.join(it, "orderID", "left")


def order_by_id(order_id: int, orders: DataFrame, employees: DataFrame, order_items: DataFrame,
                products: DataFrame) -> DataFrame:
    """One order with employee name and nested items; the id reaches the scans of
    orders and of items. No row where there is no such order."""
    this = F.col("orderID") == F.lit(int(order_id))
    return order_detail(orders.filter(this), employees, order_items.filter(this), products)


def cart_priced(cart_lines: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Price cart lines ``(cart_id, productID, quantity)`` against sellable products.

    Returns ``(priced, rejected_carts)``: priced lines carry the product's current
    price; a cart none of whose lines matched is rejected ('No valid items in cart').
    """
    from shopflow.operators.filters import sellable_products

    sell = sellable_products(products).select("productID", "price")
    priced = cart_lines.join(sell, "productID", "inner")
    rejected = (cart_lines.select("cart_id").distinct()
                .join(priced.select("cart_id").distinct(), "cart_id", "left_anti")
                .withColumn("reason", F.lit(S.NO_VALID_ITEMS)))
    return priced, rejected
