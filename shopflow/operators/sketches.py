"""Category performance from mergeable daily sketches.

Units and revenue add up over days, distinct orders do not: so each (category, day) keeps a
HyperLogLog sketch of its order ids. A report over any range is a union of the sketches of
its days, without the items; the exact report stays the default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_K = 14  # 2^14 registers a sketch: a standard error below 1 %


def daily_sketches(tables, lg_k: int = LG_K) -> DataFrame:
    """(category, day, sketch, total_sold, revenue) of completed orders, one row a category
    and day. Items whose order or product is unknown don't count, as in the exact report;
    orders without a day are kept under null, which no range reaches."""
    o = tables.orders.filter("status = 'completed'").select("orderID", F.to_date("orderDateTime").alias("day"))
    p = tables.products.select("productID", "category")
    return tables.order_items.join(o, "orderID").join(p, "productID").groupBy("category", "day").agg(
        F.hll_sketch_agg("orderID", lg_k).alias("sketch"), F.sum("quantity").alias("total_sold"),
        F.sum(F.col("quantity") * F.col("price")).alias("revenue"))


def add_days(sketches: DataFrame, more: DataFrame) -> DataFrame:
    """Sketches of further orders merged in (of new days, or late ones of old days)."""
    return sketches.unionByName(more).groupBy("category", "day").agg(
        F.hll_union_agg("sketch").alias("sketch"), F.sum("total_sold").alias("total_sold"),
        F.sum("revenue").alias("revenue"))


def category_performance(sketches: DataFrame, date_from, date_to) -> DataFrame:
    """Per category: about how many distinct orders, units, revenue; revenue desc."""
    days = sketches.filter(F.col("day").between(F.to_date(F.lit(str(date_from))), F.to_date(F.lit(str(date_to)))))
    return days.groupBy("category").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("order_count"), F.sum("total_sold").alias("total_sold"),
        F.sum("revenue").alias("revenue")).orderBy(F.desc("revenue"), "category")
