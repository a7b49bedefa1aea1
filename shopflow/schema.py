"""Fixed schemas, value domains and ENUM ordinals of the four-table shop model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)

# Fixed values of the shop model (ENUM declarations, in declaration order; the
# order is the sort order, as in an ENUM column).
ROLES = ["admin", "cashier"]
CATEGORIES = ["Appetizer", "Main Course", "Drinks", "Dessert", "Specialty"]
ORDER_TYPES = ["online", "walk-in"]
STATUSES = ["pending", "preparing", "ready", "completed", "cancelled"]

# Fixed limits of the shop model.
LOW_STOCK_LEVEL = 10
PAGE_DEFAULT = 50
PAGE_CAP = 200
RECENT_ORDERS = 10
TOP_PRODUCTS = 8
PRICE_MAX = 99999
QUANTITY_MAX = 9999
NAME_MAX = 100
CASH_MAX = 999999

# User-facing reasons of the shop's checks, in the order the checks
# run (order intake; catalogue form; customer name; stock form; cash payment).
CART_EMPTY = "Cart is empty"
NO_VALID_ITEMS = "No valid items in cart"
ORDER_FAILED = "Order failed"
NAME_REQUIRED = "Product name is required"
NAME_TOO_LONG = "Product name is too long"
CATEGORY_REQUIRED = "Please select a category"
PRICE_NOT_POSITIVE = "Price must be greater than 0"
PRICE_TOO_HIGH = "Price is too high"
QUANTITY_NEGATIVE = "Quantity cannot be negative"
QUANTITY_TOO_HIGH = "Quantity is too high"
CUSTOMER_NAME_TOO_LONG = "Name is too long"
CUSTOMER_NAME_INVALID = "Name contains invalid characters"
CASH_BLANK = "Please enter cash received"
CASH_INVALID = "Invalid cash amount"
CASH_TOO_LARGE = "Cash amount is too large"
CASH_SHORT = "Cash is less than the total amount"
# Reasons of this library (no counterpart in the shop).
TOTAL_OVERFLOW = "Total overflow"
WALKIN_PAID = "Walk-in order: paid at checkout"
# Reasons of this library's own rejects (the shop's forms never offer these rows).
ORDER_UNKNOWN = "No such order"
ORDER_CLOSED = "Order is already closed"
ORDER_PAID = "Order is already paid"
PRICE_INVALID = "Price must be a number"
PRODUCT_UNKNOWN = "No such product"

EMPLOYEES = T.StructType(
    [
        T.StructField("EmployeeID", T.LongType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("username", T.StringType(), True),
        T.StructField("password", T.StringType(), True),
        T.StructField("role", T.StringType(), False),
        T.StructField("created_at", T.TimestampNTZType(), True),
    ]
)

PRODUCTS = T.StructType(
    [
        T.StructField("productID", T.LongType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("price", MONEY, False),
        T.StructField("quantity", T.LongType(), False),
        T.StructField("image", T.StringType(), True),
        T.StructField("is_available", T.IntegerType(), False),
        T.StructField("created_at", T.TimestampNTZType(), True),
    ]
)

ORDERS = T.StructType(
    [
        T.StructField("orderID", T.LongType(), False),
        T.StructField("EmployeeID", T.LongType(), True),
        T.StructField("customer_name", T.StringType(), False),
        T.StructField("order_type", T.StringType(), False),
        T.StructField("totalAmount", MONEY, False),
        T.StructField("orderDateTime", T.TimestampNTZType(), False),
        T.StructField("status", T.StringType(), False),
    ]
)

ORDER_ITEMS = T.StructType(
    [
        T.StructField("id", T.LongType(), True),
        T.StructField("orderID", T.LongType(), False),
        T.StructField("productID", T.LongType(), False),
        T.StructField("quantity", T.IntegerType(), False),
        T.StructField("price", MONEY, False),
    ]
)

STATUS_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType(), False),
        T.StructField("ts", T.TimestampNTZType(), False),
        T.StructField("orderID", T.LongType(), False),
        T.StructField("status", T.StringType(), False),
    ]
)


@dataclass(frozen=True)
class Tables:
    """The four shop tables plus the category domain used for ordinal sorts."""

    employees: DataFrame
    products: DataFrame
    orders: DataFrame
    order_items: DataFrame
    categories: tuple[str, ...] = tuple(CATEGORIES)


def ordinal(column: str | Column, domain: list[str] | tuple[str, ...]) -> Column:
    """1-based position of ``column`` in ``domain`` (0 when absent), as an ENUM sorts."""
    c = F.col(column) if isinstance(column, str) else column
    return F.array_position(F.array(*[F.lit(v) for v in domain]), c)
