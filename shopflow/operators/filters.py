"""Filters, predicates and list queries (products list, order list, search, paging).

Date predicates are written on ``to_date(ts)``; Catalyst turns an inclusive
``to_date(ts) BETWEEN a AND b`` into a half-open range on the timestamp and
pushes it to the Parquet scan.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopflow.schema import CATEGORIES, LOW_STOCK_LEVEL, PAGE_DEFAULT, ordinal


def _date(v) -> Column:
    return F.to_date(F.lit(str(v)))


def in_date_range(ts: str | Column, date_from=None, date_to=None) -> Column:
    """Inclusive ``DATE(ts) BETWEEN from AND to``; either bound optional."""
    d = F.to_date(F.col(ts) if isinstance(ts, str) else ts)
    cond = F.lit(True)
    if date_from is not None:
        cond = cond & (d >= _date(date_from))
    if date_to is not None:
        cond = cond & (d <= _date(date_to))
    return cond


def orders_in_date_range(orders: DataFrame, date_from=None, date_to=None) -> DataFrame:
    """Orders of the range. Where the table is partitioned by ``order_month``, the range's
    months are a predicate too, so only their directories are read."""
    df = orders.filter(in_date_range("orderDateTime", date_from, date_to))
    if "order_month" in orders.columns:
        if date_from is not None:
            df = df.filter(F.col("order_month") >= str(date_from)[:7])
        if date_to is not None:
            df = df.filter(F.col("order_month") <= str(date_to)[:7])
    return df


def completed_in_range(orders: DataFrame, date_from=None, date_to=None) -> DataFrame:
    """Completed orders, optionally in an inclusive date range (revenue basis)."""
    return orders_in_date_range(orders, date_from, date_to).filter(F.col("status") == "completed")


def sort_by_category(df: DataFrame, categories=tuple(CATEGORIES), *more: str) -> DataFrame:
    """``ORDER BY category, name`` with category in ENUM declaration order.
    ``productID`` breaks ties between equal names."""
    return df.orderBy(ordinal("category", categories), "name", *more, "productID")


def category_ordinal_sort(products: DataFrame, categories=tuple(CATEGORIES)) -> DataFrame:
    return sort_by_category(products, categories).withColumn(
        "category_ordinal", ordinal("category", categories))


def products_list(products: DataFrame, category: str | None = None,
                  available: int | None = None, categories=tuple(CATEGORIES)) -> DataFrame:
    """Optional ``category =`` and ``is_available =`` (ANDed), sorted category, name."""
    df = products
    if category:
        df = df.filter(F.col("category") == category)
    if available is not None and available != "":
        df = df.filter(F.col("is_available") == int(available))
    return sort_by_category(df, categories)


def product_by_id(products: DataFrame, product_id: int) -> DataFrame:
    """Point lookup; an empty result stands for the reference's 'Not found'."""
    return products.filter(F.col("productID") == F.lit(int(product_id)))


def like_pattern(search: str) -> str:
    """User text wrapped in ``%..%`` unescaped, so ``%`` and ``_`` stay wildcards."""
    return "%" + search + "%"


def _accents() -> dict[str, str]:
    """Accented letters of the Latin blocks (U+00C0 to U+024F and U+1E00 to U+1EFF) and the
    base letters that Unicode decomposes them to, position by position, for
    accent-insensitive matching (``fold_accents``). Letters with a stroke don't decompose."""
    import unicodedata

    # Letters with a stroke or a bar and their base letters.
    out = {"Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ħ": "H", "ħ": "h", "Ł": "L", "ł": "l", "Ŧ": "T", "ŧ": "t"}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii() and base[0].isalpha():
            out[chr(code)] = base[0]
    return out


ACCENTED, UNACCENTED = map("".join, zip(*_accents().items()))


def fold(c: Column, accents: bool = False) -> Column:
    """Lower case, and with ``accents`` also accented Latin letters to their base."""
    c = F.translate(c, ACCENTED, UNACCENTED) if accents else c
    return F.lower(c)


def search_predicate(search: str, fold_accents: bool = False) -> Column:
    """``orderID LIKE %s% OR customer_name LIKE %s%``, case-insensitive on the name
    (the reference's collation folds case; ``fold_accents`` also folds accents,
    keeping ``%``/``_`` wildcards, which Spark's accent-insensitive collation
    does not support with LIKE)."""
    p = like_pattern(search)
    text = p.translate(str.maketrans(ACCENTED, UNACCENTED)) if fold_accents else p
    return (F.col("orderID").cast("string").like(p)
            | fold(F.col("customer_name"), fold_accents).like(text.lower()))


def orders_search(orders: DataFrame, search: str, fold_accents: bool = False) -> DataFrame:
    return orders.filter(search_predicate(search, fold_accents))


def orders_filtered(orders: DataFrame, status: str | None = None, date_from=None,
                    date_to=None, search: str | None = None) -> DataFrame:
    """All optional predicates of the order list, ANDed."""
    df = orders
    if status:
        df = df.filter(F.col("status") == status)
    if date_from or date_to:
        df = orders_in_date_range(df, date_from or None, date_to or None)
    if search:
        df = df.filter(search_predicate(search))
    return df


def page_bounds(limit=None, offset=None, cap: int | None = None) -> tuple[int, int]:
    """``LIMIT`` (default 50) and ``OFFSET`` (default 0). ``cap`` bounds the limit; the
    shop's list endpoint passes :data:`shopflow.schema.PAGE_CAP`."""
    lim = int(limit) if limit not in (None, "") else PAGE_DEFAULT
    lim = lim if cap is None else min(lim, cap)
    off = int(offset) if offset not in (None, "") else 0
    return lim, off


def orders_page(df: DataFrame, limit=None, offset=None, newest_first: bool = True,
                cap: int | None = None) -> DataFrame:
    """Newest first (``orderID`` breaks ties), then offset/limit. Every task keeps
    offset + limit rows; for deep pages use :func:`orders_page_after`."""
    lim, off = page_bounds(limit, offset, cap)
    order = ([F.col("orderDateTime").desc(), F.col("orderID").desc()] if newest_first
             else [F.col("orderDateTime"), F.col("orderID")])
    return df.orderBy(*order).offset(off).limit(lim)


def orders_page_after(df: DataFrame, last_ts=None, last_id=None, limit=None) -> DataFrame:
    """Keyset form of :func:`orders_page` for deep paging: the page after the row
    ``(last_ts, last_id)`` in newest-first order. Each task keeps at most
    ``limit`` rows (OFFSET paging keeps offset + limit), and the seek predicate
    on ``orderDateTime`` reaches the Parquet scan."""
    lim, _ = page_bounds(limit, 0)
    if last_ts is not None:
        ts = F.lit(str(last_ts)).cast("timestamp_ntz")
        df = df.filter((F.col("orderDateTime") < ts)
                       | ((F.col("orderDateTime") == ts) & (F.col("orderID") < F.lit(int(last_id)))))
    return df.orderBy(F.col("orderDateTime").desc(), F.col("orderID").desc()).limit(lim)


def orders_list(orders: DataFrame, employees: DataFrame, status=None, date_from=None,
                date_to=None, search=None, limit=None, offset=None, cap: int | None = None) -> DataFrame:
    """Filtered, paged order list with employee name. The page is cut before the
    employee join, so the join touches one page of orders."""
    from shopflow.operators.joins import attach_employee_name

    page = orders_page(orders_filtered(orders, status, date_from, date_to, search), limit, offset, cap=cap)
    out = attach_employee_name(page, employees)
    return out.orderBy(F.col("orderDateTime").desc(), F.col("orderID").desc())


def result_count(orders: DataFrame, status=None, date_from=None, date_to=None, search=None,
                 limit=None, offset=None) -> DataFrame:
    """Number of orders the filters match, as one row; with a ``limit`` or ``offset``
    the length of that page instead."""
    found = orders_filtered(orders, status, date_from, date_to, search)
    if limit is not None or offset is not None:
        found = orders_page(found, limit, offset)
    return found.agg(F.count(F.lit(1)).alias("result_count"))


def active_kitchen_orders(orders: DataFrame) -> DataFrame:
    """``status IN ('pending','preparing')`` oldest first (the kitchen FIFO)."""
    return kitchen_fifo(orders.filter(F.col("status").isin("pending", "preparing")))


def kitchen_fifo(orders: DataFrame) -> DataFrame:
    return orders.orderBy("orderDateTime", "orderID")


def not_cancelled_on_day(orders: DataFrame, day) -> DataFrame:
    return orders.filter((F.to_date("orderDateTime") == _date(day)) & (F.col("status") != "cancelled"))


def low_stock(products: DataFrame, level: int = LOW_STOCK_LEVEL) -> DataFrame:
    """``quantity <= 10`` ascending (``productID`` breaks ties)."""
    return products.filter(F.col("quantity") <= level).orderBy("quantity", "productID")


def sellable_products(products: DataFrame) -> DataFrame:
    return products.filter((F.col("is_available") == 1) & (F.col("quantity") > 0))


def menu_search(products: DataFrame, category: str = "All", search: str = "") -> DataFrame:
    """Category equals (or 'All') AND lower(name) contains the text, literally."""
    df = products
    if category and category != "All":
        df = df.filter(F.col("category") == category)
    if search:
        df = df.filter(F.lower("name").contains(search.lower()))
    return df


def catalogue_search(products: DataFrame, search: str = "", category: str = "",
                     available: str = "") -> DataFrame:
    """(name or category contains text) AND category AND availability."""
    s = search.lower()
    df = products.filter(F.lower("name").contains(s) | F.lower("category").contains(s))
    if category:
        df = df.filter(F.col("category") == category)
    if available != "":
        df = df.filter(F.col("is_available").cast("string") == str(available))
    return df


def report_range_defaults(as_of, date_from=None, date_to=None) -> tuple[str, str]:
    """Default range first-of-month..as_of; reject from > to and from in the future."""
    as_of = _dt.date.fromisoformat(str(as_of))
    f = _dt.date.fromisoformat(str(date_from)) if date_from else as_of.replace(day=1)
    t = _dt.date.fromisoformat(str(date_to)) if date_to else as_of
    if f > t:
        raise ValueError("date_from is after date_to")
    if f > as_of:
        raise ValueError("date_from is in the future")
    return f.isoformat(), t.isoformat()


def orders_param_sql(orders: DataFrame, status: str, date_from, date_to):
    """Parameterised statement over ``orders`` with bound values (no text splicing and no
    view left in the session)."""
    return orders.sparkSession.sql(
        "SELECT orderID, customer_name, status, totalAmount, orderDateTime FROM {shop_orders} "
        "WHERE status = :status AND to_date(orderDateTime) BETWEEN :dfrom AND :dto",
        args={"status": status, "dfrom": _dt.date.fromisoformat(str(date_from)),
              "dto": _dt.date.fromisoformat(str(date_to))}, shop_orders=orders)
