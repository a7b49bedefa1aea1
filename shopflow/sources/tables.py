"""Read and write the four shop tables with their fixed schemas."""

from __future__ import annotations

from pyspark.sql import SparkSession

from shopflow.schema import EMPLOYEES, ORDER_ITEMS, ORDERS, PRODUCTS, Tables

SCHEMAS = {"employees": EMPLOYEES, "products": PRODUCTS, "orders": ORDERS,
           "order_items": ORDER_ITEMS}


def load_tables(spark: SparkSession, base: str, fmt: str = "parquet") -> Tables:
    """Read ``{base}/{table}`` for the four tables with declared schemas (never
    inferred). JDBC (``spark.read.jdbc``) is the route to a live database; it
    needs the database's driver jar on the cluster."""
    r = {k: spark.read.schema(s).format(fmt).load(f"{base}/{k}") for k, s in SCHEMAS.items()}
    return Tables(**r)


def write_tables(t: Tables, base: str, mode: str = "overwrite") -> None:
    """Write a new version of the tables. Orders are partitioned by month, and dealt by
    month and id first so that a month is a few files; date-range filters prune
    whole months (:func:`shopflow.operators.filters.orders_in_date_range`)."""
    from pyspark.sql import functions as F

    t.employees.write.mode(mode).parquet(f"{base}/employees")
    t.products.write.mode(mode).parquet(f"{base}/products")
    (t.orders.withColumn("order_month", F.date_format("orderDateTime", "yyyy-MM"))
     .repartitionByRange("order_month", "orderID")
     .write.mode(mode).partitionBy("order_month").parquet(f"{base}/orders"))
    t.order_items.write.mode(mode).parquet(f"{base}/order_items")


def write_bucketed(t: Tables, database: str, buckets: int, mode: str = "overwrite") -> None:
    """Save orders and order_items as catalog tables bucketed and sorted by
    orderID, so their join reads co-located buckets with no shuffle. Needs a
    catalog the cluster shares (e.g. a Hive metastore)."""
    spark = t.orders.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, df in (("orders", t.orders), ("order_items", t.order_items)):
        (df.write.mode(mode).bucketBy(buckets, "orderID").sortBy("orderID")
         .saveAsTable(f"{database}.{name}"))
