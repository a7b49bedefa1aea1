"""Map the driver's TPC-H-like tables onto the four-table shop model.

This only renames and re-types columns into the shop schema (the views of
FIXTURES.md); it does none of the work of any report. Every reader selects
just the columns it maps, so the Parquet scans are pruned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.schema import MONEY, Tables

# Category domain over driver data, in this fixture's declaration (sort) order.
DRIVER_CATEGORIES = ("ECONOMY", "SMALL", "MEDIUM", "LARGE", "STANDARD", "PROMO")


# Declared schemas of the driver tables read here (no footer-inference job per read).
RAW_SCHEMAS = {
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
              "props string",
}


def read_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table with its declared schema."""
    r = spark.read
    if name in RAW_SCHEMAS:
        r = r.schema(RAW_SCHEMAS[name])
    return r.parquet(f"{sf_dir}/{name}.parquet")


_read = read_raw


def employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    return c.filter(F.col("c_mktsegment") == "BUILDING").select(
        F.col("c_custkey").alias("EmployeeID"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 10 == 0, "admin").otherwise("cashier").alias("role"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("productID"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").cast(MONEY).alias("price"),
        (F.col("p_size") - 3).alias("quantity"),
        F.when(F.col("p_partkey") % 7 == 0, 0).otherwise(1).alias("is_available"),
    )


def orders(spark: SparkSession, sf_dir: str, emp: DataFrame | None = None) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    # Employees are distinct on their key; saying so lets Catalyst drop this join
    # from plans that use no employee-derived column.
    e = (emp if emp is not None else employees(spark, sf_dir)).select("EmployeeID").distinct()
    j = o.join(e, o["o_custkey"] == e["EmployeeID"], "left")
    status = (
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "P", "preparing")
        .when(F.col("o_orderpriority") == "1-URGENT", "cancelled")
        .when(F.col("o_orderpriority") == "2-HIGH", "ready")
        .otherwise("pending")
    )
    return j.select(
        F.col("o_orderkey").alias("orderID"),
        F.col("EmployeeID"),
        F.concat(F.lit("Guest "), F.col("o_custkey").cast("string")).alias("customer_name"),
        F.when(F.col("EmployeeID").isNull(), "online").otherwise("walk-in").alias("order_type"),
        F.col("o_totalprice").cast(MONEY).alias("totalAmount"),
        F.col("o_orderdate").alias("orderDateTime"),
        status.alias("status"),
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("orderID"),
        F.col("l_partkey").alias("productID"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast(MONEY).alias("price"),
    )


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_events_from(_read(spark, sf_dir, "events"))


def status_events_from(ev: DataFrame) -> DataFrame:
    """events -> (event_id, ts, orderID, status); usable on a stream as well."""
    status = (
        F.when(F.col("event_type") == "signup", "pending")
        .when(F.col("event_type") == "view", "preparing")
        .when(F.col("event_type") == "click", "ready")
        .when(F.col("event_type") == "purchase", "completed")
        .otherwise("cancelled")
    )
    return ev.select(
        "event_id", "ts", F.col("user_id").alias("orderID"), status.alias("status")
    )


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    emp = employees(spark, sf_dir)
    return Tables(
        employees=emp,
        products=products(spark, sf_dir),
        orders=orders(spark, sf_dir, emp),
        order_items=order_items(spark, sf_dir),
        categories=DRIVER_CATEGORIES,
    )
