"""Change jobs: the shop's writes re-aimed as batch DataFrame jobs.

Each job takes input frames and returns new frames (no in-place update); the
caller writes them (e.g. Parquet overwrite of a new version path). "Last write
wins" is a ``max`` over a ``struct(sequence, ...)`` per key, which Spark
combines map-side, so a key receiving a large share of all changes is reduced
per task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import shopflow.schema as S
from shopflow.functions.scalars import at_least_one, js_float, js_int, js_trim, strip_markup_chars
from shopflow.operators.allocation import bucketed, decide, stock_after
from shopflow.operators.filters import sellable_products
from shopflow.operators.joins import left_join_nullable_key
from shopflow.schema import CASH_MAX, MONEY, NAME_MAX, QUANTITY_MAX


CASH_DIGITS = 10 ** 16 - 1
OPEN = ("pending", "preparing", "ready")  # orders that can still be paid


def _money_max() -> Column:
    return F.lit("99999999.99").cast("decimal(12,2)")


# ----------------------------------------------------------------- cart
def cart_totals(lines: DataFrame, cart: str = "orderID") -> DataFrame:
    """Per cart: ``total`` = sum(price * quantity), ``item_count`` = sum(quantity)."""
    return lines.groupBy(cart).agg(
        F.sum(F.col("price") * F.col("quantity")).alias("total"),
        F.sum("quantity").alias("item_count"))


def cart_merge(adds: DataFrame, products: DataFrame, cart: str = "orderID") -> DataFrame:
    """Repeated adds of one product collapse into one line whose quantity never
    exceeds current stock; products that are unknown, unavailable or out of stock
    are not added."""
    s = sellable_products(products).select("productID", F.col("quantity").alias("_stock"), "price")
    merged = adds.groupBy(cart, "productID").agg(F.sum("quantity").alias("_want"))
    return merged.join(s, "productID", "inner").select(
        cart, "productID", "price", F.least(F.col("_want"), F.col("_stock")).cast("long").alias("quantity"))


# ----------------------------------------------------------------- intake rules
def order_type_rule(table_number: Column, employee_id: Column) -> Column:
    """Table number -> 'online'; else employee -> 'walk-in'; else 'online'.
    ``table_number`` is the parsed integer (0 and null count as no table)."""
    has_table = table_number.isNotNull() & (table_number != 0)
    return (F.when(has_table, "online").when(employee_id.isNotNull(), "walk-in")
            .otherwise("online"))


def customer_label(name: Column, table_number: Column) -> Column:
    """'Customer' when the name is missing or empty; otherwise trimmed (all
    whitespace) with ``<>"'`` removed; ``[Table n] `` in front for a table."""
    raw = F.when(name.isNull() | (name == ""), F.lit("Customer")).otherwise(
        strip_markup_chars(js_trim(name)))
    has_table = table_number.isNotNull() & (table_number != 0)
    return F.when(has_table, F.concat(F.lit("[Table "), table_number.cast("string"),
                                      F.lit("] "), raw)).otherwise(raw)


# ----------------------------------------------------------------- intake
def orders_intake(headers: DataFrame, lines: DataFrame, products: DataFrame) -> dict[str, DataFrame]:
    """Order intake with stock allocation.

    ``headers``: (order_seq, customer_name, table_number, EmployeeID, has_items)
    with raw text values; ``lines``: (order_seq, line_pos, productID, quantity)
    as raw text. Returns ``orders`` (new headers, status 'pending'), ``items``
    (accepted lines with the price frozen), ``stock`` (products after intake),
    ``rejects`` (order_seq, reason) and ``by_order``, which orders and rejects read
    (order_seq, totalAmount, placed, has_valid), for callers that keep it for them.

    Rules: an empty cart is rejected; lines whose product is unknown,
    unavailable or out of stock are dropped; an order with no line left is
    rejected; quantity is ``max(1, parseInt(q))``. An order with a valid item
    whose label exceeds 100 characters, or which holds a non-numeric quantity
    on a product that still has stock when it is checked, fails as a whole
    ('Order failed') and takes no stock.
    The second rule depends on earlier orders, so the failing set is refined
    until it is stable. It only shrinks, so this ends; each round decides again
    only the products of orders that no longer fail.
    Totals above DECIMAL(10,2) are flagged in ``rejects`` with reason
    'Total overflow' and kept (the caller decides).
    """
    h = headers.select(
        "order_seq", "EmployeeID", F.col("has_items"),
        js_int(F.col("table_number")).alias("_table"), F.col("customer_name"))
    h = h.select(
        "order_seq", "EmployeeID", "has_items",
        customer_label(F.col("customer_name"), F.col("_table")).alias("customer_name"),
        order_type_rule(F.col("_table"), F.col("EmployeeID")).alias("order_type"))
    valid_h = h.filter(F.col("has_items")).withColumn(
        "_label_fail", F.length("customer_name") > NAME_MAX)
    # One join of lines with their header: drops lines without a (non-empty)
    # header and carries the order-level failure flag.
    parsed = (lines.select("order_seq", "line_pos", js_int(F.col("productID")).alias("productID"),
                           at_least_one(js_int(F.col("quantity"))).alias("quantity"))
              .filter(F.col("productID").isNotNull()))
    ln = parsed.join(valid_h.select("order_seq", "_label_fail"), "order_seq", "inner")
    stock = products.select("productID", "quantity", "is_available", "price")
    # Sequence bounds come from the raw lines (a one-column scan, no join).
    ln = bucketed(ln, splits_from=lines)

    def decided_lines(lines_in: DataFrame, fail: Column) -> DataFrame:
        req = lines_in.select(
            "order_seq", "line_pos", "productID", "_bucket",
            F.when(~fail & F.col("quantity").isNotNull(), F.col("quantity"))
            .otherwise(F.lit(0)).alias("quantity"),
            F.col("quantity").isNull().alias("_nan"), fail.alias("_failed"))
        return decide(req, stock)

    label_fail = valid_h.filter(F.col("_label_fail")).select("order_seq")
    # Checked on the parsed lines (a filtered scan that stops at the first hit).
    if parsed.filter(F.col("quantity").isNull()).isEmpty():
        failing = label_fail
        # All results below read the decision, so it is made once; it reads its lines twice.
        ln = ln.persist()
        try:
            decided = decided_lines(ln, F.col("_label_fail")).checkpoint()
        finally:
            ln.unpersist()
    else:
        # Start from "every order with a non-numeric quantity fails" and shrink.
        nan_orders = ln.filter(F.col("quantity").isNull()).select("order_seq")
        ln = ln.checkpoint()
        failing = label_fail.unionByName(nan_orders).distinct().checkpoint()

        def flagged(lines_in: DataFrame, fails: DataFrame) -> DataFrame:
            marked = lines_in.join(fails.withColumn("_f", F.lit(True)), "order_seq", "left")
            return decided_lines(marked, F.col("_f").isNotNull())

        decided = flagged(ln, failing).checkpoint()
        while True:
            still = (decided.filter(F.col("_nan") & F.col("accepted")).select("order_seq")
                     .unionByName(label_fail).distinct().checkpoint())
            freed = failing.join(still, "order_seq", "left_anti")
            if freed.isEmpty():
                break
            touched = ln.join(freed, "order_seq", "left_semi").select("productID").distinct().checkpoint()
            redone = flagged(ln.join(touched, "productID", "left_semi"), still)
            # Lines of other products keep their decision but not their order's old mark.
            rest = decided.join(touched, "productID", "left_anti").drop("_failed").join(
                still.withColumn("_failed", F.lit(True)), "order_seq", "left").withColumn(
                "_failed", F.coalesce("_failed", F.lit(False)))
            decided = redone.unionByName(rest.select(*redone.columns)).checkpoint()
            failing = still

    ok = F.col("accepted") & ~F.col("_failed") & ~F.col("_nan")
    items = decided.filter(ok).select("order_seq", "line_pos", "productID", "quantity", "price")
    # An order "has a valid item" when any line found its product sellable at its
    # turn (checked before the insert that may fail), whether or not it failed.
    by_order = decided.groupBy("order_seq").agg(
        F.sum(F.when(ok, F.col("quantity") * F.col("price"))).alias("totalAmount"),
        F.max(ok).alias("placed"), F.max("accepted").alias("has_valid"))
    # Failed orders have no accepted line, so they are not placed.
    new_orders = valid_h.join(by_order.filter("placed"), "order_seq", "inner").select(
        F.col("order_seq").alias("orderID"), "EmployeeID", "customer_name", "order_type",
        "totalAmount", F.lit("pending").alias("status"))
    new_stock = stock_after(products, decided.withColumn("accepted", ok))

    has_valid = by_order.filter("has_valid").select("order_seq")
    empty = h.filter(~F.col("has_items")).select("order_seq", F.lit(S.CART_EMPTY).alias("reason"))
    failed = (failing.join(has_valid, "order_seq", "left_semi")
              .select("order_seq", F.lit(S.ORDER_FAILED).alias("reason")))
    novalid = (valid_h.select("order_seq").join(has_valid, "order_seq", "left_anti")
               .select("order_seq", F.lit(S.NO_VALID_ITEMS).alias("reason")))
    overflow = new_orders.filter(F.col("totalAmount") > _money_max()).select(
        F.col("orderID").alias("order_seq"), F.lit(S.TOTAL_OVERFLOW).alias("reason"))
    rejects = empty.unionByName(failed).unionByName(novalid).unionByName(overflow)
    return {"orders": new_orders, "items": items, "stock": new_stock, "rejects": rejects, "by_order": by_order}


# ----------------------------------------------------------------- stock
def stock_decrement(products: DataFrame, sold_lines: DataFrame) -> DataFrame:
    """Subtract summed quantities per product (lines are pre-summed per product,
    so the join with products is 1:1)."""
    sold = sold_lines.groupBy("productID").agg(F.sum("quantity").alias("_sold"))
    return (products.join(sold, "productID", "left")
            .withColumn("quantity", (F.col("quantity") - F.coalesce(F.col("_sold"), F.lit(0))).cast("long"))
            .drop("_sold"))


def stock_set_reason(q: Column) -> Column:
    """Why a stock input is refused (null when fine): not a number / negative,
    above 9999."""
    return (F.when(q.isNull() | (q < 0), S.QUANTITY_NEGATIVE)
            .when(q > QUANTITY_MAX, S.QUANTITY_TOO_HIGH))


def stock_set(products: DataFrame, updates: DataFrame, seq: str = "seq",
              check_bounds: bool = True) -> tuple[DataFrame, DataFrame]:
    """Absolute stock overwrite per product; the last update (by ``seq``, then
    quantity) wins. Returns (products, rejects): with ``check_bounds`` updates
    outside 0..9999 are refused with the form's reason; updates of unknown products
    are refused too."""
    reason = stock_set_reason(F.col("quantity")) if check_bounds else F.lit(None).cast("string")
    u = updates.withColumn("reason", reason)
    last = u.filter(F.col("reason").isNull()).groupBy("productID").agg(
        F.max(F.struct(F.col(seq).alias("s"), F.col("quantity").alias("q")))["q"].alias("_new"))
    known = products.select("productID", F.lit(True).alias("_known"))
    rejects = u.join(known, "productID", "left").withColumn(
        "reason", F.coalesce("reason", F.when(F.col("_known").isNull(), S.PRODUCT_UNKNOWN))).filter(
        F.col("reason").isNotNull()).select("productID", seq, "quantity", "reason")
    after = (products.join(last, "productID", "left")
             .withColumn("quantity", F.coalesce(F.col("_new"), F.col("quantity")).cast("long"))
             .drop("_new"))
    return after, rejects


# ----------------------------------------------------------------- status
def walkin_rule(status: Column, order_type: Column) -> Column:
    """'ready' on a walk-in order becomes 'completed' (paid at checkout)."""
    return F.when((status == "ready") & (order_type == "walk-in"), F.lit("completed")).otherwise(status)


def status_apply(orders: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply status changes ``(orderID, status, ts, event_id)``.

    The last update per order (by ts, then event_id) wins; 'ready' on a
    walk-in order becomes 'completed'; updates for unknown orders are ignored.
    Any status may follow any other (no terminal states), as in the reference.

    The winner depends only on (ts, event_id), so it is picked first by a
    map-side combinable ``max(struct)``; the order-type rule then needs one
    1:1 join, and an order with a huge share of all updates causes no skew.
    """
    last = updates.groupBy("orderID").agg(F.max(F.struct("ts", "event_id", "status"))["status"].alias("_s"))
    kinds = orders.select("orderID", "order_type")
    final = last.join(kinds, "orderID", "inner").select(
        "orderID", walkin_rule(F.col("_s"), F.col("order_type")).alias("_new"))
    return (orders.join(final, "orderID", "left")
            .withColumn("status", F.coalesce(F.col("_new"), F.col("status"))).drop("_new"))


# ----------------------------------------------------------------- catalogue
def catalogue_upsert(products: DataFrame, changes: DataFrame,
                     seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Insert new / overwrite existing products; the last good change per productID
    wins. Returns (products, rejects).

    Name and image are trimmed (all whitespace); an empty image is stored as '';
    is_available defaults to 1. A quantity is the integer its text starts with: a new
    product without one gets 0, an existing product keeps its stock (the shop's update
    form always sends one, and an update that left it out must not empty the shelf).
    A price that is not a number is refused, and so is a quantity text without one."""
    raw_qty = F.col("quantity").cast("string")
    c = changes.select(
        "productID", seq,
        js_trim(F.col("name")).alias("name"), F.col("category"),
        js_float(F.col("price")).cast(MONEY).alias("price"),
        js_int(raw_qty).alias("quantity"),
        F.coalesce(js_trim(F.col("image")), F.lit("")).alias("image"),
        F.coalesce(js_int(F.col("is_available")), F.lit(1)).cast("int").alias("is_available"),
        F.when(js_float(F.col("price")).isNull(), S.PRICE_INVALID)
        .when(js_int(raw_qty).isNull() & (js_trim(raw_qty) != ""), S.QUANTITY_NEGATIVE).alias("reason"))
    fields = ["name", "category", "price", "quantity", "image", "is_available"]
    last = c.filter(F.col("reason").isNull()).groupBy("productID").agg(
        F.max(F.struct(F.col(seq).alias("_s"), *fields)).alias("_c"))
    last = last.select("productID", F.lit(True).alias("_hit"), *[F.col("_c")[f].alias("_n_" + f) for f in fields])
    old = products.withColumn("quantity", F.col("quantity").cast("long"))
    j = old.join(last, "productID", "full_outer")
    new = {f: F.col("_n_" + f) for f in fields}
    new["quantity"] = F.coalesce(F.col("_n_quantity"), F.col("quantity"), F.lit(0))
    after = j.select("productID", *[
        F.when(F.col("_hit"), new[f]).otherwise(F.col(f)).alias(f) if f in fields else F.col(f)
        for f in products.columns if f != "productID"])
    rejects = c.filter(F.col("reason").isNotNull()).select("productID", seq, "name", "reason")
    return after, rejects


def catalogue_delete(products: DataFrame, order_items: DataFrame,
                     deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete products unless order_items reference them (RESTRICT).

    Returns ``(remaining_products, refused)``. The referenced set is found by a
    semi-join of order_items against the delete list (the big side streams),
    then de-duplicated with map-side partial aggregation."""
    d = deletes.select("productID").distinct()
    referenced = order_items.select("productID").join(d, "productID", "left_semi").distinct()
    refused = d.join(referenced, "productID", "left_semi")
    allowed = d.join(referenced, "productID", "left_anti")
    return products.join(allowed, "productID", "left_anti"), refused


def employee_delete_set_null(orders: DataFrame, employees: DataFrame,
                             removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove employees; their orders keep existing with EmployeeID null."""
    r = removed.select("EmployeeID").distinct().withColumn("_gone", F.lit(True))
    o = (left_join_nullable_key(orders, r, "EmployeeID")
         .withColumn("EmployeeID", F.when(F.col("_gone"), F.lit(None).cast("long"))
                     .otherwise(F.col("EmployeeID")))
         .drop("_gone").select(*orders.columns))
    return o, employees.join(r.select("EmployeeID"), "EmployeeID", "left_anti")


def order_delete_cascade(orders: DataFrame, order_items: DataFrame,
                         removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove orders and, by cascade, their items."""
    r = removed.select("orderID").distinct()
    return (orders.join(r, "orderID", "left_anti"),
            order_items.join(r, "orderID", "left_anti"))


# ----------------------------------------------------------------- payment
def payment_settlement(orders: DataFrame, payments: DataFrame, counter: bool = False,
                       cash_cap: int | None = None) -> DataFrame:
    """Settle cash payments ``(payment_id, orderID, cash)`` (cash as typed text)
    against order totals, one row per payment.

    Only open orders (pending, preparing, ready) can be paid, and each once: of the
    payments that would do, the first by ``payment_id`` is accepted. Refused are also
    payments of unknown orders, blank and negative cash, and less than the total
    (with the shortfall). Accepted payments give ``change_due`` and ``new_status``
    'completed'; ``early`` marks orders still pending or preparing.

    Collecting (the default) is for online orders: walk-in orders were paid at
    checkout, and text that is no number counts as 0. At the ``counter`` any open
    order is paid, such text is invalid, and cash above ``cash_cap`` (default 999999
    there) is refused.
    """
    cash_cap = CASH_MAX if counter and cash_cap is None else cash_cap
    p = payments.join(orders.select("orderID", "order_type", "status", "totalAmount"), "orderID", "left")
    raw = F.col("cash").cast("string")
    blank = raw.isNull() | (js_trim(raw) == "")
    # Beyond 16 digits before the point a number counts as the greatest one.
    size = js_float(raw, "double")
    most = F.when(size < 0, F.lit(-CASH_DIGITS)).when(size > 0, F.lit(CASH_DIGITS)).cast("decimal(22,6)")
    cash = F.coalesce(js_float(raw), most)
    if not counter:
        cash = F.coalesce(cash, F.lit(0).cast("decimal(22,6)"))
    total = F.col("totalAmount").cast("decimal(22,6)")
    reason = (F.when(F.col("status").isNull(), S.ORDER_UNKNOWN)
              .when(~F.col("status").isin(*OPEN), S.ORDER_CLOSED))
    if not counter:
        reason = reason.when(F.col("order_type") == "walk-in", S.WALKIN_PAID)
    reason = reason.when(blank, S.CASH_BLANK).when(cash.isNull() | (cash < 0), S.CASH_INVALID)
    if cash_cap is not None:
        reason = reason.when(cash > cash_cap, S.CASH_TOO_LARGE)
    reason = reason.when(cash < total, S.CASH_SHORT)
    out = p.withColumn("_cash", cash).withColumn("reason", reason)
    # The first good payment per order: a grouped minimum, combined map-side.
    first = out.filter(F.col("reason").isNull()).groupBy("orderID").agg(F.min("payment_id").alias("_first"))
    out = out.join(first, "orderID", "left").withColumn(
        "reason", F.coalesce("reason", F.when(F.col("payment_id") != F.col("_first"), S.ORDER_PAID)))
    ok = F.col("reason").isNull()
    return out.select(
        "payment_id", "orderID", "order_type", "status", "totalAmount",
        F.col("_cash").cast("decimal(20,2)").alias("cash_value"),
        ok.alias("accepted"), "reason",
        F.when(ok, (F.col("_cash") - total).cast("decimal(20,2)")).alias("change_due"),
        F.when(F.col("reason") == S.CASH_SHORT,
               (total - F.col("_cash")).cast("decimal(20,2)")).alias("shortfall"),
        F.when(ok, F.lit("completed")).otherwise(F.col("status")).alias("new_status"),
        (ok & F.col("status").isin("pending", "preparing")).alias("early"))
