"""Sinks: CSV report export and JSON serialisation of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.operators.filters import orders_in_date_range
from shopflow.operators.joins import left_join_nullable_key

# Fixed export header of the sales CSV, in column order.
CSV_COLUMNS = ["Order ID", "Customer", "Type", "Total", "Status", "Date & Time", "Employee"]
NO_EMPLOYEE = "—"  # em dash shown when an order has no employee


def orders_csv_rows(tables, date_from, date_to) -> DataFrame:
    """Orders in the inclusive range with employee name, the seven renamed
    export columns, newest first (``orderID`` breaks ties)."""
    o = orders_in_date_range(tables.orders, date_from, date_to)
    e = tables.employees.select("EmployeeID", F.col("name").alias("_emp"))
    j = left_join_nullable_key(o, e, "EmployeeID")
    out = j.select(
        F.col("orderID").alias("Order ID"), F.col("customer_name").alias("Customer"),
        F.col("order_type").alias("Type"), F.col("totalAmount").alias("Total"),
        F.col("status").alias("Status"), F.col("orderDateTime").alias("Date & Time"),
        F.coalesce(F.col("_emp"), F.lit(NO_EMPLOYEE)).alias("Employee"))
    return out.orderBy(F.col("Date & Time").desc(), F.col("Order ID").desc())


def csv_file_name(date_from, date_to) -> str:
    return f"sales_{date_from}_to_{date_to}.csv"


def write_orders_csv(rows: DataFrame, base: str, date_from, date_to) -> str:
    """Write the export under ``{base}/sales_{from}_to_{to}.csv/`` (a directory
    of part files, in order). Every value is quoted, ``"`` doubled, null written
    as ``""``; the header is written even when there are no rows. Timestamps
    are ISO text. Spark also quotes the header line."""
    path = f"{base}/{csv_file_name(date_from, date_to)}"
    (rows.write.mode("overwrite")
     .option("header", True).option("quoteAll", True).option("escape", '"')
     .option("nullValue", "").option("emptyValue", "")
     .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss")
     .csv(path))
    return path


def orders_json(df: DataFrame, key: str = "orderID") -> DataFrame:
    """One JSON document per row (nested item lists included): (key, json). Null fields
    are written as null."""
    return df.select(key, F.to_json(F.struct(*[F.col(c) for c in df.columns]),
                                    {"ignoreNullFields": "false"}).alias("json"))


def write_orders_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path
