"""Inventory views: summary counts, stock alert, stock levels, low-stock list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.functions.scalars import stock_bar_pct, stock_level as _stock_level
from shopflow.operators.filters import low_stock, sort_by_category
from shopflow.schema import CATEGORIES, LOW_STOCK_LEVEL

__all__ = ["inventory_summary", "stock_alert", "stock_levels", "low_stock", "inventory_list"]


def inventory_summary(products: DataFrame, level: int = LOW_STOCK_LEVEL) -> DataFrame:
    """total / out (<= 0) / low (1..level) / in stock (> level): one global
    aggregate (partial counts per task, one tiny final merge)."""
    q = F.col("quantity")
    return products.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count_if(q <= 0).alias("out_of_stock"),
        F.count_if((q > 0) & (q <= level)).alias("low_stock"),
        F.count_if(q > level).alias("in_stock"))


def stock_alert(products: DataFrame, level: int = LOW_STOCK_LEVEL) -> DataFrame:
    """The summary plus ``alert``: true when anything is low or out."""
    s = inventory_summary(products, level)
    return s.withColumn("alert", (F.col("low_stock") > 0) | (F.col("out_of_stock") > 0))


def stock_levels(products: DataFrame) -> DataFrame:
    """Per product: Out / Low / Good label and bar width."""
    return products.select("productID", "name", "category", "quantity",
                           _stock_level("quantity").alias("stock_level"),
                           stock_bar_pct("quantity").alias("bar_pct"))


def inventory_list(products: DataFrame, low_only: bool = False,
                   categories=tuple(CATEGORIES)) -> DataFrame:
    """Low-stock list ascending by quantity, or the whole catalogue by category, name."""
    return low_stock(products) if low_only else sort_by_category(products, categories)
