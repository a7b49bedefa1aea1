"""Data-quality jobs: catalogue and name validation, domain, key and reference checks.

Each check is a set-based DataFrame job (filter, group-by-having, anti-join), so
it runs at any table size without collecting rows to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import shopflow.schema as S
from shopflow.functions.scalars import JS_SPACE, js_trim
from shopflow.schema import CATEGORIES, NAME_MAX, ORDER_TYPES, PRICE_MAX, QUANTITY_MAX, ROLES, STATUSES

# Fixed pattern of allowed customer-name characters (ASCII word chars, JavaScript
# whitespace, hyphen, apostrophe, dot).
NAME_PATTERN = rf"\A[\w{JS_SPACE}\-'.]+\z"


def product_reject_reason(categories=tuple(CATEGORIES)):
    """First failing rule of the catalogue form, or null when valid."""
    name = js_trim("name")
    price = F.col("price").cast("decimal(20,2)")
    qty = F.col("quantity")
    return (F.when(name.isNull() | (name == ""), S.NAME_REQUIRED)
            .when(F.length(name) > NAME_MAX, S.NAME_TOO_LONG)
            .when(F.col("category").isNull() | ~F.col("category").isin(*categories),
                  S.CATEGORY_REQUIRED)
            .when(price.isNull() | (price <= 0), S.PRICE_NOT_POSITIVE)
            .when(price > PRICE_MAX, S.PRICE_TOO_HIGH)
            .when(qty.isNull() | (qty < 0), S.QUANTITY_NEGATIVE)
            .when(qty > QUANTITY_MAX, S.QUANTITY_TOO_HIGH))


def validate_products(products: DataFrame, categories=tuple(CATEGORIES)) -> DataFrame:
    """Every product with ``valid`` and the first failing rule as ``reason``."""
    r = product_reject_reason(categories)
    return products.withColumn("reason", r).withColumn("valid", F.col("reason").isNull())


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col("valid")), df.filter(~F.col("valid"))


def customer_name_reason():
    """Reason a typed customer name is refused (null when fine): longer than 100
    after trimming, or characters outside the allowed set. Blank is fine (it
    becomes 'Customer')."""
    t = js_trim("customer_name")
    return (F.when(F.length(t) > NAME_MAX, S.CUSTOMER_NAME_TOO_LONG)
            .when((t != "") & ~t.rlike(NAME_PATTERN), S.CUSTOMER_NAME_INVALID))


def validate_customer_name(df: DataFrame) -> DataFrame:
    r = customer_name_reason()
    return df.withColumn("reason", r).withColumn("valid", F.col("reason").isNull())


def domain_checks(tables) -> DataFrame:
    """Rows whose ENUM column is outside its domain: (table, column, value, rows)."""
    checks = [
        (tables.employees, "employees", {"role": ROLES}),
        (tables.products, "products", {"category": list(tables.categories)}),
        (tables.orders, "orders", {"order_type": ORDER_TYPES, "status": STATUSES}),
    ]
    parts = []
    for df, t, domains in checks:  # one scan a table
        values = df.select(F.explode(F.filter(
            F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"),
                               F.coalesce(~F.col(c).isin(*dom), F.lit(True)).alias("bad"))
                      for c, dom in domains.items()]), lambda x: x["bad"])).alias("v"))
        parts.append(values.groupBy("v.column_name", "v.value").agg(F.count(F.lit(1)).alias("rows"))
                     .select(F.lit(t).alias("table_name"), "column_name", "value", "rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def duplicate_keys(df: DataFrame, key: str, table: str) -> DataFrame:
    """Key values that occur more than once (partial counts combine map-side)."""
    return (df.groupBy(F.col(key).alias("key_value")).agg(F.count(F.lit(1)).alias("rows"))
            .filter(F.col("rows") > 1)
            .select(F.lit(table).alias("table_name"), F.lit(key).alias("key_column"),
                    F.col("key_value").cast("string").alias("key_value"), "rows"))


def key_checks(tables) -> DataFrame:
    """Duplicates of primary keys (employees, products, orders, order items) and of the
    employees' unique user name. A table without one of the columns skips that check."""
    checks = [(tables.employees, "EmployeeID", "employees"), (tables.employees, "username", "employees"),
              (tables.products, "productID", "products"), (tables.orders, "orderID", "orders"),
              (tables.order_items, "id", "order_items")]
    parts = [duplicate_keys(df.where(F.col(key).isNotNull()), key, name)
             for df, key, name in checks if key in df.columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dangling(child: DataFrame, parent: DataFrame, key: str, name: str,
             nullable: bool = False) -> DataFrame:
    """Child rows whose key has no parent row (anti join), counted per key."""
    c = child.filter(F.col(key).isNotNull()) if nullable else child
    miss = c.join(parent.select(key), key, "left_anti")
    return (miss.groupBy(F.col(key).alias("key_value")).agg(F.count(F.lit(1)).alias("rows"))
            .select(F.lit(name).alias("reference"),
                    F.col("key_value").cast("string").alias("key_value"), "rows"))


def reference_checks(tables) -> DataFrame:
    """Foreign-key violations: items->orders, items->products, orders->employees."""
    return (dangling(tables.order_items, tables.orders, "orderID", "order_items.orderID")
            .unionByName(dangling(tables.order_items, tables.products, "productID",
                                  "order_items.productID"))
            .unionByName(dangling(tables.orders, tables.employees, "EmployeeID",
                                  "orders.EmployeeID", nullable=True)))
