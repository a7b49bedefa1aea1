"""Sales, product and category reports, dashboard KPIs, rankings and top-k.

Money stays DECIMAL end to end; empty sums are 0 (``coalesce``) except where the
reference has no COALESCE (top products). Revenue counts completed orders only.
Aggregations are grouped by key and combined map-side before the shuffle, so a
hot key (one product or day with a third of all rows) is reduced per task first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopflow.operators.filters import completed_in_range
from shopflow.functions.scalars import iso_week_label, month_label
from shopflow.operators.joins import attach_employee_name
from shopflow.schema import RECENT_ORDERS, TOP_PRODUCTS


def _zero_money() -> Column:
    return F.lit(0).cast("decimal(10,2)")


def _money_sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), _zero_money())


def _completed_lines(tables, date_from=None, date_to=None) -> DataFrame:
    """order_items of completed orders (optionally in range): an inner join on the
    filtered orders' ids, which are unique, keeps only item columns."""
    o = completed_in_range(tables.orders, date_from, date_to).select("orderID")
    return tables.order_items.join(o, "orderID", "inner")


def _product_totals(lines: DataFrame) -> DataFrame:
    """Units and revenue per product, pre-aggregated before any product join."""
    return lines.groupBy("productID").agg(
        F.sum("quantity").alias("total_sold"),
        _money_sum(F.col("quantity") * F.col("price")).alias("revenue"))


def category_performance(tables, date_from=None, date_to=None, approx: bool = False) -> DataFrame:
    """Per category: distinct completed orders, units, revenue; revenue desc.

    The exact distinct count runs as Spark's two-phase aggregation on
    (category, orderID). ``approx=True`` uses HyperLogLog++
    (``approx_count_distinct``, 1% relative standard deviation) instead, a single pass with
    fixed-size per-category sketches."""
    lines = _completed_lines(tables, date_from, date_to)
    p = tables.products.select("productID", "category")
    j = lines.join(p, "productID", "inner")
    distinct = F.approx_count_distinct("orderID", rsd=0.01) if approx else F.countDistinct("orderID")
    return (j.groupBy("category")
            .agg(distinct.alias("order_count"),
                 F.sum("quantity").alias("total_sold"),
                 _money_sum(F.col("quantity") * F.col("price")).alias("revenue"))
            .orderBy(F.col("revenue").desc(), "category"))


def product_ranking(tables, date_from=None, date_to=None) -> DataFrame:
    """Per product in range: name, category, units, revenue; units desc.

    Lines are summed per product first; the product join then sees one row per
    product, so a hot product costs nothing extra in the join."""
    agg = _product_totals(_completed_lines(tables, date_from, date_to))
    p = tables.products.select("productID", "name", "category")
    return (agg.join(p, "productID", "inner")
            .select("productID", "name", "category", "total_sold", "revenue")
            .orderBy(F.col("total_sold").desc(), "productID"))


def product_rank_positions(ranking: DataFrame) -> DataFrame:
    """Rank 1..n in ranking order (units desc, productID), top three marked.
    Numbered with :func:`global_row_number`, so no single-partition window."""
    from shopflow.operators.ranking import global_row_number

    r = global_row_number(ranking, [F.col("total_sold").desc(), F.col("productID")])
    return r.withColumn(
        "medal", F.when(F.col("rank") <= 3, F.col("rank")))


def top_products(tables, k: int = TOP_PRODUCTS) -> DataFrame:
    """Top k products by units sold, completed orders, all time. No COALESCE on
    revenue, as in the reference. Lines are summed per product first; products
    without a row in ``products`` don't count, so the join comes before the cut."""
    lines = _completed_lines(tables)
    agg = lines.groupBy("productID").agg(
        F.sum("quantity").alias("total_sold"),
        F.sum(F.col("quantity") * F.col("price")).alias("revenue"))
    return (agg.join(tables.products.select("productID", "name"), "productID", "inner")
            .select("productID", "name", "total_sold", "revenue")
            .orderBy(F.col("total_sold").desc(), "productID").limit(k))


def recent_orders(tables, k: int = RECENT_ORDERS) -> DataFrame:
    """Newest k orders with employee name (``orderID`` breaks ties)."""
    top = tables.orders.select(
        "orderID", "customer_name", "totalAmount", "status", "orderDateTime", "order_type",
        "EmployeeID").orderBy(F.col("orderDateTime").desc(), F.col("orderID").desc()).limit(k)
    out = attach_employee_name(top, tables.employees).drop("EmployeeID")
    return out.orderBy(F.col("orderDateTime").desc(), F.col("orderID").desc())


def order_status_counts(orders: DataFrame) -> DataFrame:
    return orders.groupBy("status").agg(F.count(F.lit(1)).alias("cnt")).orderBy("status")


def dashboard_stats(tables, as_of) -> DataFrame:
    """Five KPIs in one scan of orders and products: today's orders (not
    cancelled), today's completed sales, all-time completed sales, pending
    count, available product count.

    The two tables are stacked (``unionByName``) and reduced by one global
    aggregate, so there is no join; partial aggregates combine map-side.
    """
    day = F.to_date(F.lit(str(as_of)))
    o = tables.orders.select(
        F.lit("o").alias("src"), F.to_date("orderDateTime").alias("d"), "status", "totalAmount")
    p = tables.products.select(F.lit("p").alias("src"), "is_available")
    u = o.unionByName(p, allowMissingColumns=True)
    is_o = F.col("src") == "o"
    completed = is_o & (F.col("status") == "completed")
    today = is_o & (F.col("d") == day)
    return u.agg(
        F.count_if(today & (F.col("status") != "cancelled")).alias("today_orders"),
        _money_sum(F.when(today & completed, F.col("totalAmount"))).alias("today_sales"),
        _money_sum(F.when(completed, F.col("totalAmount"))).alias("total_sales"),
        F.count_if(is_o & (F.col("status") == "pending")).alias("pending_orders"),
        F.count_if((F.col("src") == "p") & (F.col("is_available") == 1)).alias("product_count"))


def sales_by_day_window(orders: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Completed revenue per date since ``as_of - days`` (N+1 dates, no upper
    bound); days without sales are absent."""
    d = F.to_date("orderDateTime")
    start = F.date_sub(F.to_date(F.lit(str(as_of))), int(days))
    f = orders.filter((d >= start) & (F.col("status") == "completed"))
    return (f.groupBy(d.alias("date")).agg(_money_sum(F.col("totalAmount")).alias("total"))
            .orderBy("date"))


def period_key(period: str) -> Column:
    if period == "weekly":
        return iso_week_label("orderDateTime")
    if period == "monthly":
        return month_label("orderDateTime")
    return F.to_date("orderDateTime")


def sales_report(orders: DataFrame, date_from, date_to, period: str = "daily") -> DataFrame:
    """Completed order count and revenue per day / ISO week / month, in range."""
    f = completed_in_range(orders, date_from, date_to)
    return (f.groupBy(period_key(period).alias("period"))
            .agg(F.count(F.lit(1)).alias("order_count"),
                 _money_sum(F.col("totalAmount")).alias("revenue"))
            .orderBy("period"))


def sales_daily(orders, date_from, date_to):
    return sales_report(orders, date_from, date_to, "daily")


def sales_weekly(orders, date_from, date_to):
    return sales_report(orders, date_from, date_to, "weekly")


def sales_monthly(orders, date_from, date_to):
    return sales_report(orders, date_from, date_to, "monthly")


def sales_with_total(orders: DataFrame, date_from, date_to, period: str = "daily") -> DataFrame:
    """Period rows plus a TOTAL row (``GROUPING SETS ((period), ())``).

    ``is_total`` carries ``grouping()``; empty input gives no rows at all.
    """
    f = completed_in_range(orders, date_from, date_to).withColumn(
        "period", period_key(period).cast("string"))
    g = (f.rollup("period")
         .agg(F.count(F.lit(1)).alias("order_count"),
              _money_sum(F.col("totalAmount")).alias("revenue"),
              F.grouping("period").alias("is_total")))
    # rollup's grand total exists even on empty input; drop it then (no TOTAL row).
    g = g.filter((F.col("is_total") == 0) | (F.col("order_count") > 0))
    return g.select(
        F.when(F.col("is_total") == 1, F.lit("TOTAL")).otherwise(F.col("period")).alias("period"),
        "order_count", "revenue", F.col("is_total").cast("int").alias("is_total"),
    ).orderBy("is_total", "period")


def active_order_count(orders: DataFrame) -> DataFrame:
    return orders.agg(F.count_if(F.col("status").isin("pending", "preparing", "ready"))
                      .alias("active_orders"))


def active_orders_union(orders: DataFrame, per_status: int | None = None) -> DataFrame:
    """All ready, then preparing, then pending orders, each newest first, in one scan.
    ``per_status`` cuts each list to a page (a rank limit that Spark applies in
    every task before the shuffle)."""
    shown = ["ready", "preparing", "pending"]
    newest = [F.col("orderDateTime").desc(), F.col("orderID").desc()]
    df = orders.filter(F.col("status").isin(*shown)).withColumn(
        "branch", F.array_position(F.array(*map(F.lit, shown)), F.col("status")).cast("int") - 1)
    if per_status is not None:
        rank = F.row_number().over(Window.partitionBy("branch").orderBy(*newest))
        df = df.withColumn("_r", rank).filter(F.col("_r") <= per_status).drop("_r")
    return df.orderBy("branch", *newest)

