"""Edge rules on small hand-made frames (FIXTURES.md section 3)."""

import datetime as dt
import glob
import os
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from shopflow.operators import changes, filters, inventory, quality, reports
from shopflow.operators.allocation import stock_allocation
from shopflow.schema import EMPLOYEES, ORDER_ITEMS, ORDERS, Tables
from shopflow.sources import export, payloads
from shopflow.streaming import dashboard, live

TS = dt.datetime(2024, 1, 1, 9, 0)


def _orders(spark, rows):
    """rows: (orderID, EmployeeID, customer_name, order_type, total, ts, status)."""
    return spark.createDataFrame(
        [(i, e, n, t, Decimal(str(a)), ts, s) for i, e, n, t, a, ts, s in rows], ORDERS)


# ----------------------------------------------------------------- payloads / intake
def test_payload_intake_rules(spark, seed):
    bodies = [
        (1, "not json", None),
        (2, "{}", None),
        (3, '{"items": []}', None),
        (4, '{"customer_name": "  Ann <b>\\t", "table_number": 3, "items": [{"productID": 1, "quantity": "2x"}]}', None),
        (5, '{"customer_name": "Bob", "table_number": 0, "items": [{"productID": 2, "quantity": 0}]}', 1),
        (6, '{"customer_name": "", "items": [{"productID": 3, "quantity": -1}]}', None),
        (7, '{"customer_name": "Cy", "items": [{"productID": 4, "quantity": "x"}]}', None),
        (8, '{"customer_name": "Di", "items": [{"productID": 999, "quantity": 1}]}', None),
        (9, '{"customer_name": "   ", "items": [{"productID": 5, "quantity": 1}, {"productID": 5, "quantity": 2}]}', 2),
        (10, '{"customer_name": "Ed", "table_number": null, "items": [{"productID": "6abc", "quantity": "3.7"}]}', 1),
    ]
    p = spark.createDataFrame(bodies, "order_seq long, body string, EmployeeID long")
    h, ln = payloads.read_order_payloads(p)
    out = changes.orders_intake(h, ln, seed.products)
    orders = {r.orderID: r for r in out["orders"].collect()}
    rejects = {r.order_seq: r.reason for r in out["rejects"].collect()}
    assert rejects == {1: "Cart is empty", 2: "Cart is empty", 3: "Cart is empty",
                       7: "Order failed", 8: "No valid items in cart"}
    assert orders[4].customer_name == "[Table 3] Ann b" and orders[4].order_type == "online"
    assert orders[5].customer_name == "Bob" and orders[5].order_type == "walk-in"
    assert orders[6].customer_name == "Customer" and orders[6].order_type == "online"
    assert orders[9].customer_name == "" and orders[9].order_type == "walk-in"
    items = {(r.order_seq, r.line_pos): r for r in out["items"].collect()}
    assert items[(4, 0)].quantity == 2
    assert items[(5, 0)].quantity == 1 and items[(6, 0)].quantity == 1
    assert items[(10, 0)].quantity == 3 and items[(10, 0)].productID == 6
    assert orders[9].totalAmount == Decimal("3") * Decimal("280.00")
    stock = {r.productID: r.quantity for r in out["stock"].collect()}
    assert stock[5] == 20 - 3 and stock[4] == 20  # failed order takes no stock


def test_stock_race(spark, seed):
    """Stock 3; orders ask 2, 2, 1: accept, accept (oversell to -1), reject."""
    prods = seed.products.withColumn("quantity", F.when(F.col("productID") == 20, 3)
                                     .otherwise(F.col("quantity")))
    req = spark.createDataFrame([(1, 20, 2), (2, 20, 2), (3, 20, 1)],
                                "order_seq long, productID long, quantity int")
    d = {r.order_seq: r for r in stock_allocation(req, prods, buckets=2).collect()}
    assert [d[i].accepted for i in (1, 2, 3)] == [True, True, False]
    assert [d[i].stock_before for i in (1, 2, 3)] == [3, 1, -1]


def test_nan_quantity_on_sold_out_product_is_skipped(spark, seed):
    """A non-numeric quantity fails the order only while its product has stock;
    once sold out, the line is skipped and the rest of the order goes through."""
    prods = seed.products.withColumn("quantity", F.when(F.col("productID") == 20, 1)
                                     .otherwise(F.col("quantity")))
    bodies = [
        (1, '{"items": [{"productID": 20, "quantity": 1}]}', None),
        (2, '{"items": [{"productID": 20, "quantity": "x"}, {"productID": 1, "quantity": 1}]}', None),
        (3, '{"items": [{"productID": 2, "quantity": "x"}]}', None),
    ]
    p = spark.createDataFrame(bodies, "order_seq long, body string, EmployeeID long")
    h, ln = payloads.read_order_payloads(p)
    out = changes.orders_intake(h, ln, prods)
    assert {r.orderID for r in out["orders"].collect()} == {1, 2}
    assert {r.order_seq: r.reason for r in out["rejects"].collect()} == {3: "Order failed"}


# ----------------------------------------------------------------- dates
def test_iso_weeks_across_new_year(spark):
    days = [dt.datetime(1998, 12, 28) + dt.timedelta(days=i) for i in range(8)]
    days += [dt.datetime(2000, 12, 31), dt.datetime(2001, 1, 1), dt.datetime(2001, 1, 2)]
    o = _orders(spark, [(i, None, "g", "online", 10, d, "completed") for i, d in enumerate(days)])
    w = {r.period: r.order_count for r in reports.sales_weekly(o, "1998-01-01", "2001-12-31").collect()}
    assert w == {"1998-W53": 7, "1999-W01": 1, "2000-W52": 1, "2001-W01": 2}


def test_day_window_includes_n_days_back(spark):
    o = _orders(spark, [(1, None, "a", "online", 5, dt.datetime(2001, 7, 25, 23), "completed"),
                        (2, None, "b", "online", 7, dt.datetime(2001, 7, 24, 1), "completed"),
                        (3, None, "c", "online", 9, dt.datetime(2001, 8, 3), "completed")])
    r = reports.sales_by_day_window(o, "2001-08-01", 7).collect()
    assert [(x.date, x.total) for x in r] == [(dt.date(2001, 7, 25), Decimal("5.00")),
                                             (dt.date(2001, 8, 3), Decimal("9.00"))]


def test_empty_day_gives_zero_sums_and_no_total_row(spark, seed):
    o = _orders(spark, [(1, None, "a", "online", 5, dt.datetime(2001, 8, 1), "pending")])
    t = Tables(seed.employees, seed.products, o, spark.createDataFrame([], ORDER_ITEMS))
    s = reports.dashboard_stats(t, "2001-08-01").first()
    assert (s.today_orders, s.today_sales, s.total_sales, s.pending_orders, s.product_count) == \
        (1, Decimal("0.00"), Decimal("0.00"), 1, 20)
    assert reports.sales_with_total(o, "2001-01-01", "2001-12-31").count() == 0


# ----------------------------------------------------------------- catalogue
def test_validate_products(spark):
    rows = [("", "Drinks", "10", 1), ("x" * 101, "Drinks", "10", 1), ("ok", "Soup", "10", 1),
            ("ok", "Drinks", "0", 1), ("ok", "Drinks", "0.01", 1), ("ok", "Drinks", "99999", 1),
            ("ok", "Drinks", "100000", 1), ("ok", "Drinks", "5", -1), ("ok", "Drinks", "5", 0),
            ("ok", "Drinks", "5", 9999), ("ok", "Drinks", "5", 10000)]
    df = spark.createDataFrame([(i, n, c, Decimal(p), q) for i, (n, c, p, q) in enumerate(rows)],
                               "productID long, name string, category string, price decimal(12,2), quantity int")
    r = [x.reason for x in quality.validate_products(df).orderBy("productID").collect()]
    assert r == ["Product name is required", "Product name is too long", "Please select a category",
                 "Price must be greater than 0", None, None, "Price is too high",
                 "Quantity cannot be negative", None, None, "Quantity is too high"]


def test_stock_levels_and_summary(spark):
    df = spark.createDataFrame([(i, "p", "Drinks", q) for i, q in enumerate([-1, 0, 1, 10, 11, 60])],
                               "productID long, name string, category string, quantity int")
    lv = [(x.stock_level, x.bar_pct) for x in inventory.stock_levels(df).orderBy("productID").collect()]
    assert lv == [("Out", 100), ("Out", 100), ("Low", 10), ("Low", 100), ("Good", 22), ("Good", 100)]
    s = inventory.stock_alert(df).first()
    assert (s.total_products, s.out_of_stock, s.low_stock, s.in_stock, s.alert) == (6, 2, 2, 2, True)
    assert s.out_of_stock + s.low_stock + s.in_stock == s.total_products


def test_seed_menu_low_stock_and_ordinal_sort(seed):
    assert [r.name for r in filters.low_stock(seed.products).collect()] == ["Rose Cordial"]
    names = [r.name for r in filters.products_list(seed.products).collect()]
    assert names[:4] == ["Bean Dip", "Corn Soup", "Garlic Bread", "Olive Plate"]
    cats = [r.category for r in filters.products_list(seed.products).collect()]
    assert cats == sorted(cats, key=["Appetizer", "Main Course", "Drinks", "Dessert", "Specialty"].index)
    assert [r.name for r in filters.products_list(seed.products, "Drinks").collect()] == \
        ["Apple Juice", "Ginger Ale", "Mint Tea", "Plum Soda", "Warm Milk"]


# ----------------------------------------------------------------- export
def test_csv_export_quoting(spark, seed):
    o = _orders(spark, [(1, None, 'Say "hi", then\nbye', "online", 5, dt.datetime(2024, 1, 2, 3, 4, 5), "pending"),
                        (2, 1, "Plain", "walk-in", 6, dt.datetime(2024, 1, 3), "completed")])
    t = Tables(seed.employees, seed.products, o, spark.createDataFrame([], ORDER_ITEMS))
    base = tempfile.mkdtemp(prefix="shopflow-test-")
    path = export.write_orders_csv(export.orders_csv_rows(t, "2024-01-01", "2024-01-31"), base,
                                   "2024-01-01", "2024-01-31")
    assert path.endswith("sales_2024-01-01_to_2024-01-31.csv")
    text = "".join(open(f).read() for f in sorted(glob.glob(os.path.join(path, "part-*"))))
    assert '"Order ID","Customer","Type","Total","Status","Date & Time","Employee"' in text
    assert '"Say ""hi"", then\nbye"' in text
    assert '"—"' in text and '"Ada Boss"' in text and '"2024-01-02T03:04:05"' in text
    empty = export.write_orders_csv(export.orders_csv_rows(t, "2030-01-01", "2030-01-02"), base,
                                    "2030-01-01", "2030-01-02")
    etext = "".join(open(f).read() for f in glob.glob(os.path.join(empty, "part-*")))
    assert etext.startswith('"Order ID"')


def test_json_export(spark):
    o = _orders(spark, [(1, None, "A", "online", 5, TS, "pending")])
    j = export.orders_json(o).first().json
    assert '"orderID":1' in j and '"totalAmount":5.00' in j


# ----------------------------------------------------------------- search
def test_search_wildcards(spark):
    o = _orders(spark, [(101, None, "Alice", "online", 1, TS, "pending"),
                        (202, None, "bob_smith", "online", 1, TS, "pending"),
                        (303, None, "100% Carl", "online", 1, TS, "pending")])
    ids = lambda s: sorted(r.orderID for r in filters.orders_search(o, s).collect())
    assert ids("%") == [101, 202, 303]
    assert ids("b_s") == [202]
    assert ids("ALICE") == [101]
    assert ids("0") == [101, 202, 303]
    assert ids("10") == [101, 303]
    menu = spark.createDataFrame([(1, "Blue % Tea", "Drinks"), (2, "Blue Tea", "Drinks")],
                                 "productID long, name string, category string")
    assert [r.productID for r in filters.menu_search(menu, "All", "% t").collect()] == [1]


# ----------------------------------------------------------------- status feed
def test_status_apply_rules(spark):
    o = _orders(spark, [(1, 1, "w", "walk-in", 1, TS, "preparing"),
                        (2, None, "o", "online", 1, TS, "preparing"),
                        (3, None, "p", "online", 1, TS, "pending")])
    u = spark.createDataFrame([
        (1, "ready", TS, 1), (2, "ready", TS, 2), (3, "completed", TS, 3),
        (3, "pending", TS + dt.timedelta(seconds=1), 4), (99, "ready", TS, 5)],
        "orderID long, status string, ts timestamp_ntz, event_id long")
    st = {r.orderID: r.status for r in changes.status_apply(o, u).collect()}
    assert st == {1: "completed", 2: "ready", 3: "pending"}


def test_live_status_stream_equals_batch(spark, tmp_path):
    o = _orders(spark, [(i, 1 if i % 2 else None, "x", "walk-in" if i % 2 else "online", 1, TS, "pending")
                        for i in range(6)])
    ev = spark.createDataFrame(
        [(k, TS + dt.timedelta(minutes=k), k % 7, ["signup", "view", "click", "purchase", "error"][k % 5],
          1.0, "{}") for k in range(40)], live.EVENTS)
    d = tmp_path / "events"
    ev.repartition(3).write.parquet(str(d))
    stream = live.event_stream(spark, str(d), glob="*.parquet", max_files=1)
    path = live.run_live_status(spark, stream, o, f"t-{os.getpid()}")
    got = {r.orderID: r.status for r in live.current_from_changelog(spark, path).collect()}
    from shopflow.sources.driver import status_events_from
    batch = changes.status_apply(o, status_events_from(ev))
    want = {r.orderID: r.status for r in batch.collect()}
    assert got == {k: v for k, v in want.items() if k in got} and set(got) == set(range(6))


# ----------------------------------------------------------------- snapshots
def test_new_order_diff(spark):
    def snap(ids):
        return spark.createDataFrame([(i,) for i in ids], "orderID long")
    new = lambda prev, cur: sorted(r.orderID for r in live.new_order_diff(snap(cur), snap(prev)).collect())
    assert new([], [1]) == []
    assert new([1], [1, 2]) == [2]
    assert new([1, 2], [2]) == []
    assert new([2], [1, 2]) == [1]


# ----------------------------------------------------------------- payments
def test_payment_settlement(spark):
    o = _orders(spark, [(1, None, "a", "online", "100.00", TS, "ready"),
                        (2, 1, "b", "walk-in", "50.00", TS, "ready"),
                        (3, None, "c", "online", "80.00", TS, "pending"),
                        (4, None, "d", "online", "10.00", TS, "cancelled"),
                        (5, None, "e", "online", "10.00", TS, "completed")])
    p = spark.createDataFrame([
        (1, 1, "99.99"), (2, 1, "1000000"), (3, 1, "150.5"), (4, 1, "-5"), (5, 1, "  "),
        (6, 1, "100"), (7, 2, "60"), (8, 3, "80"), (9, 3, "abc"), (10, 4, "10"), (11, 5, "10"), (12, 77, "10")],
        "payment_id long, orderID long, cash string")
    r = {x.payment_id: x for x in changes.payment_settlement(o, p).collect()}
    assert len(r) == 12
    assert r[1].reason == "Cash is less than the total amount" and r[1].shortfall == Decimal("0.01")
    assert r[2].accepted and r[2].change_due == Decimal("999900.00") and r[2].new_status == "completed"
    assert r[3].reason == r[6].reason == "Order is already paid" and r[3].new_status == "ready"
    assert r[4].reason == "Invalid cash amount"
    assert r[5].reason == "Please enter cash received"
    assert r[7].reason == "Walk-in order: paid at checkout"
    assert r[8].accepted and r[8].early
    assert r[9].reason == "Cash is less than the total amount"
    assert r[10].reason == r[11].reason == "Order is already closed" and r[10].new_status == "cancelled"
    assert r[12].reason == "No such order" and r[12].status is None and not r[12].early
    c = {x.payment_id: x for x in changes.payment_settlement(o, p, counter=True).collect()}
    assert c[2].reason == "Cash amount is too large" and c[9].reason == "Invalid cash amount"
    assert c[3].accepted and c[6].reason == "Order is already paid" and c[7].accepted


# ----------------------------------------------------------------- deletes
def test_deletes(spark, seed):
    items = spark.createDataFrame([(1, 10, 1, 2, Decimal("90.00"))], ORDER_ITEMS)
    left, refused = changes.catalogue_delete(seed.products, items, spark.createDataFrame(
        [(1,), (2,)], "productID long"))
    assert [r.productID for r in refused.collect()] == [1]
    assert 2 not in {r.productID for r in left.collect()} and left.count() == 19
    o = _orders(spark, [(10, 1, "a", "walk-in", 1, TS, "ready"), (11, 2, "b", "walk-in", 1, TS, "ready")])
    o2, e2 = changes.employee_delete_set_null(o, seed.employees, spark.createDataFrame([(1,)], "EmployeeID long"))
    assert {r.orderID: r.EmployeeID for r in o2.collect()} == {10: None, 11: 2}
    assert [r.EmployeeID for r in e2.collect()] == [2]
    o3, i3 = changes.order_delete_cascade(o, items, spark.createDataFrame([(10,)], "orderID long"))
    assert o3.count() == 1 and i3.count() == 0


def test_stock_set_and_upsert(spark, seed):
    u = spark.createDataFrame([(1, 5, 1), (1, 7, 2), (2, -1, 1), (3, 10000, 1), (99, 5, 1)],
                              "productID long, quantity int, seq long")
    products, rejects = changes.stock_set(seed.products, u)
    s = {r.productID: r.quantity for r in products.collect()}
    assert (s[1], s[2], s[3]) == (7, 30, 25)
    assert {r.productID: r.reason for r in rejects.collect()} == {
        2: "Quantity cannot be negative", 3: "Quantity is too high", 99: "No such product"}
    ch = spark.createDataFrame([
        (1, 1, " Bread XL\t", "Appetizer", "130.00", None, None, None),
        (1, 2, "Bread", "Appetizer", "free", "9", None, None),
        (2, 1, "Soup", "Appetizer", "10", "4x", None, None), (2, 2, "Soup", "Appetizer", "10", "none", None, None),
        (30, 1, "New", "Dessert", "10.00", "4", " img.png ", 0), (31, 1, "Bare", "Dessert", "1", None, None, None)],
        "productID long, seq long, name string, category string, price string, quantity string, "
        "image string, is_available int")
    products, rejects = changes.catalogue_upsert(seed.products, ch)
    up = {r.productID: r for r in products.collect()}
    assert up[1].name == "Bread XL" and up[1].quantity == 50 and up[1].is_available == 1
    assert up[2].quantity == 4 and up[31].quantity == 0
    assert up[30].image == "img.png" and up[30].is_available == 0 and len(up) == 22
    assert {(r.productID, r.seq): r.reason for r in rejects.collect()} == {
        (1, 2): "Price must be a number", (2, 2): "Quantity cannot be negative"}


def test_large_quantities(spark, seed):
    sold = spark.createDataFrame([(1, 2_000_000_000), (1, 2_000_000_000)], "productID long, quantity int")
    left = {r.productID: r.quantity for r in changes.stock_decrement(seed.products, sold).collect()}
    assert left[1] == 50 - 4_000_000_000


def test_cart_merge_leaves_out_unavailable_products(spark, seed):
    p = seed.products.withColumn("is_available", F.when(F.col("productID") == 2, 0).otherwise(1))
    adds = spark.createDataFrame([(1, 1, 30), (1, 1, 40), (1, 2, 1), (1, 88, 1)], "orderID long, productID long, quantity int")
    assert [(r.productID, r.quantity) for r in changes.cart_merge(adds, p).collect()] == [(1, 50)]


def test_javascript_whitespace_and_falsy_values(spark):
    from shopflow.functions import scalars as S

    nbsp, wide, bom = "\u00a0", "\u3000", "\ufeff"
    df = spark.createDataFrame([(nbsp + wide + " Ann" + nbsp + "Lee \n" + bom,)], "customer_name string")
    r = quality.validate_customer_name(df).select("*", S.js_trim("customer_name").alias("t"),
                                                 S.js_int(F.lit(nbsp + "12x")).alias("i")).first()
    assert r.t == "Ann" + nbsp + "Lee" and r.valid and r.i == 12
    df = spark.createDataFrame([("0", 0, 0.0, False), ("", 3, float("nan"), True), (None, None, 2.5, None)],
                               "s string, n int, d double, b boolean")
    got = df.select(S.default_if_falsy("s", "x"), S.default_if_falsy("n", -1), S.default_if_falsy("d", -1.0),
                    S.default_if_falsy("b", True)).collect()
    assert [tuple(r) for r in got] == [("0", -1, -1.0, True), ("x", 3, -1.0, True), ("x", -1, 2.5, True)]


def test_chain_of_dependent_orders(spark, seed):
    """Order n has a non-numeric quantity on a product that order n - 1 sells out, so each
    round settles one more order: a chain of n needs about n rounds, and no bound on them."""
    n = 10
    p = spark.createDataFrame([(i, 1, 1, Decimal("1.00")) for i in range(n + 1)],
                              "productID long, quantity long, is_available int, price decimal(10,2)")
    bodies = [(0, '{"items": [{"productID": 0, "quantity": 1}]}', None)] + [
        (i, '{"items": [{"productID": %d, "quantity": "x"}, {"productID": %d, "quantity": 1}]}' % (i - 1, i), None)
        for i in range(1, n + 1)]
    h, ln = payloads.read_order_payloads(spark.createDataFrame(bodies, "order_seq long, body string, EmployeeID long"))
    out = changes.orders_intake(h, ln, p)
    assert out["orders"].count() == n + 1 and out["rejects"].count() == 0
    assert {r.quantity for r in out["stock"].collect()} == {0}


def test_half_the_lines_on_one_product(spark):
    """The lines are never exchanged by product alone, and the plain sums agree."""
    rows = [(i, 1 if i % 2 else 2 + i % 40, 1 + i % 3) for i in range(4000)]
    req = spark.createDataFrame(rows, "order_seq long, productID long, quantity int").withColumn("line_pos", F.lit(0))
    stock = spark.createDataFrame([(p, 50 * p, 1) for p in range(1, 42)], "productID long, quantity int, is_available int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = stock_allocation(req, stock)
        got = {(r.order_seq, r.productID): r.stock_before for r in out.collect()}
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        physical = out._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    used = {}
    for seq, p, q in rows:
        assert got[seq, p] == 50 * p - used.get(p, 0)
        used[p] = used.get(p, 0) + q
    assert plan.count("LogicalRDD") <= 3 and physical


def test_order_by_id_and_json_documents(spark, seed):
    from shopflow.operators import joins

    o = _orders(spark, [(1, None, "a", "online", 1, TS, "pending"), (2, 1, "b", "walk-in", 1, TS, "ready")])
    items = spark.createDataFrame([(1, 1, 1, 2, Decimal("120.00"))], ORDER_ITEMS)
    row = joins.order_by_id(1, o, seed.employees, items, seed.products).collect()
    assert len(row) == 1 and row[0].employee_name is None and row[0]["items"][0].product_name == "Garlic Bread"
    assert joins.order_by_id(3, o, seed.employees, items, seed.products).count() == 0
    doc = export.orders_json(joins.order_by_id(2, o, seed.employees, items, seed.products)).first().json
    assert '"items":[]' in doc and '"employee_name":"Ada Boss"' in doc
    assert '"EmployeeID":null' in export.orders_json(o.filter("orderID = 1")).first().json


def test_months_are_pruned(spark, seed, tmp_path):
    from shopflow.sources.tables import load_tables, write_tables

    o = _orders(spark, [(i, None, "x", "online", 1, dt.datetime(2024, 1 + i % 12, 3), "pending") for i in range(60)])
    write_tables(Tables(seed.employees, seed.products, o, seed.order_items), str(tmp_path))
    back = load_tables(spark, str(tmp_path)).orders
    march = filters.orders_in_date_range(back, "2024-03-01", "2024-03-31")
    plan = march._jdf.queryExecution().executedPlan().toString()
    assert march.count() == 5 and "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    assert len(glob.glob(str(tmp_path / "orders" / "*" / "*.parquet"))) <= 24


def test_a_cluster_needs_a_shared_checkpoint_folder():
    from shopflow.session import ensure_checkpoint_dir

    class Conf(dict):
        pass

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_daily_sales_do_not_depend_on_batches(spark, tmp_path):
    """Late purchases count, whether the files come one by one or together."""
    days = [dt.datetime(2024, 1, 20, 5), dt.datetime(2024, 1, 25), dt.datetime(2024, 1, 2, 23), dt.datetime(2024, 1, 20, 1)]
    (tmp_path / "ev").mkdir()
    for i, day in enumerate(days):
        spark.createDataFrame([(i, day, 1, "purchase", 2.5, "{}")], live.EVENTS).coalesce(1).write.parquet(
            str(tmp_path / f"p{i}"))
        f = next((tmp_path / f"p{i}").glob("part-*.parquet"))
        os.link(f, tmp_path / "ev" / f"events-{i}.parquet")
        os.utime(tmp_path / "ev" / f"events-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    out = []
    for files in (1, 10):
        stream = live.event_stream(spark, str(tmp_path / "ev"), glob="events-*.parquet", max_files=files)
        path = live.run_daily_sales(spark, stream, f"days-{files}-{os.getpid()}")
        out.append(sorted(map(tuple, live.daily_sales_from_changelog(spark, path).collect())))
    assert out[0] == out[1] and [(d.day, n) for d, n, _ in out[0]] == [(2, 1), (20, 2), (25, 1)]


def test_customer_name_validation(spark):
    df = spark.createDataFrame([("Ann O'Neil",), ("x" * 101,), ("bad<",), ("",), ("Jo-Jo Jr.",)],
                               "customer_name string")
    r = [x.reason for x in quality.validate_customer_name(df).collect()]
    assert r == [None, "Name is too long", "Name contains invalid characters", None, None]


def test_report_range_defaults():
    assert filters.report_range_defaults("2001-08-15") == ("2001-08-01", "2001-08-15")
    with pytest.raises(ValueError):
        filters.report_range_defaults("2001-08-15", "2001-08-10", "2001-08-01")
    with pytest.raises(ValueError):
        filters.report_range_defaults("2001-08-15", "2001-09-01", "2001-09-02")


def test_scalars(spark):
    from shopflow.functions import scalars as S
    df = spark.createDataFrame([Row(s="3abc", t=dt.datetime(2024, 1, 1, 0, 0, 0))], "s string, t timestamp_ntz")
    now = F.lit("2024-01-01 01:02:03").cast("timestamp_ntz")
    r = df.select(S.js_int("s").alias("i"), S.js_int(F.lit("x")).alias("nan"),
                  S.elapsed_wait("t", now).alias("w"), S.relative_age("t", now).alias("a"),
                  S.js_trim(F.lit("\t a \n")).alias("tr"), S.money_text(F.lit(1234.5), "P").alias("m"),
                  S.product_image_path(F.lit("img/x.png")).alias("p1"),
                  S.product_image_path(F.lit("../x.png")).alias("p2")).first()
    assert (r.i, r.nan, r.w, r.a, r.tr, r.m, r.p1, r.p2) == \
        (3, None, "1h 2m", "1h ago", "a", "P1,234.50", "../img/x.png", "../x.png")


def test_employees_schema_fixed(seed):
    assert seed.employees.schema == EMPLOYEES


def test_new_order_stream_over_batches(spark, tmp_path):
    """One file per micro-batch: the diff of each batch's queue snapshot against
    the previous batch's, with the empty-previous rule."""
    def ev(rows):
        return spark.createDataFrame(
            [(eid, TS + dt.timedelta(minutes=eid), oid, kind, 1.0, "{}") for eid, oid, kind in rows],
            live.EVENTS)
    d = tmp_path / "events"
    batches = [
        [(1, 1, "signup")],                      # queue {1}; previous empty -> nothing new
        [(2, 2, "signup")],                      # queue {1, 2} -> {2}
        [(3, 1, "purchase")],                    # queue {2} -> nothing
        [(4, 1, "view")],                        # queue {1, 2} -> {1} (new again)
    ]
    for i, b in enumerate(batches):
        ev(b).coalesce(1).write.mode("overwrite").parquet(str(d / f"b{i}"))
    # Flatten into one directory, one file per batch, in batch order.
    flat = tmp_path / "flat"
    flat.mkdir()
    for i in range(len(batches)):
        f = next((d / f"b{i}").glob("part-*.parquet"))
        os.link(f, flat / f"events-{i}.parquet")
        os.utime(flat / f"events-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = live.event_stream(spark, str(flat), glob="events-*.parquet", max_files=1)
    base = live.run_new_order_stream(spark, stream, f"new-{os.getpid()}")
    got = [sorted(x.orderID for x in spark.read.parquet(f"{base}/new").filter(F.col("batch_id") == i).collect())
           for i in range(len(batches))]
    assert got == [[], [2], [], [1]]


def test_nested_order_forms(spark, seed):
    o = _orders(spark, [(1, 1, "a", "walk-in", 1, TS, "pending"), (2, None, "b", "online", 1, TS, "ready")])
    items = spark.createDataFrame([(1, 1, 1, 2, Decimal("120.00")), (2, 1, 9, 1, Decimal("90.00"))], ORDER_ITEMS)
    from shopflow.operators import joins
    det = {r.orderID: r for r in joins.order_detail(o, seed.employees, items, seed.products).collect()}
    assert [i.product_name for i in det[1].items] == ["Garlic Bread", "Mint Tea"]
    assert det[2].items == [] and det[1].employee_name == "Ada Boss"
    k = joins.kitchen_tickets(o, items, seed.products).collect()
    assert [r.orderID for r in k] == [1] and len(k[0].items) == 2


def test_bucketed_tables_join_without_shuffle(spark, seed, capsys):
    from shopflow.sources.tables import write_bucketed
    o = _orders(spark, [(i, None, "a", "online", 1, TS, "pending") for i in range(20)])
    items = spark.createDataFrame([(i, i % 20, 1, 1, Decimal("1.00")) for i in range(60)], ORDER_ITEMS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        write_bucketed(Tables(seed.employees, seed.products, o, items), "shopflow_test", 4)
        j = spark.table("shopflow_test.order_items").join(spark.table("shopflow_test.orders"), "orderID")
        capsys.readouterr()
        j.explain()
        plan = capsys.readouterr().out
        assert j.count() == 60 and "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_live_dashboard_deltas_equal_batch_counts(spark, tmp_path):
    """Counts kept by streamed deltas over several micro-batches equal the batch
    counts after applying all updates (walk-in rule included)."""
    o = _orders(spark, [(i, 1 if i % 2 else None, "x", "walk-in" if i % 2 else "online", 1, TS,
                         ["pending", "ready", "completed"][i % 3]) for i in range(8)])
    kinds = ["signup", "view", "click", "purchase", "error"]
    rows = [(k, TS + dt.timedelta(minutes=k), (k * 3) % 10, kinds[(k * 7) % 5], 1.0, "{}") for k in range(30)]
    d = tmp_path / "ev"
    d.mkdir()
    for i in range(3):
        part = [r for r in rows if r[0] % 3 == i]
        spark.createDataFrame(part, live.EVENTS).coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        f = next((tmp_path / f"p{i}").glob("part-*.parquet"))
        os.link(f, d / f"events-{i}.parquet")
        os.utime(d / f"events-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = live.event_stream(spark, str(d), glob="events-*.parquet", max_files=1)
    base = dashboard.run_live_dashboard(spark, stream, o, f"dash-{os.getpid()}")
    got = {r.status: r.cnt for r in dashboard.status_counts(spark, base).collect()}
    from shopflow.sources.driver import status_events_from
    want = {r.status: r.cnt for r in reports.order_status_counts(
        changes.status_apply(o, status_events_from(spark.createDataFrame(rows, live.EVENTS)))).collect()}
    assert got == want


def test_kitchen_queue_with_processing_time_trigger(spark, tmp_path):
    """The kitchen's polling form: a processing-time trigger, found by name,
    drained with processAllAvailable and stopped; the queue matches the batch form."""
    o = _orders(spark, [(i, None, "x", "online", 1, TS + dt.timedelta(minutes=i), "pending") for i in range(4)])
    ev = spark.createDataFrame([(1, TS, 0, "purchase", 1.0, "{}"), (2, TS, 2, "view", 1.0, "{}")], live.EVENTS)
    d = tmp_path / "ev"
    ev.coalesce(1).write.parquet(str(d))
    name = f"kitchen-{os.getpid()}"
    path = live.run_live_status(spark, live.event_stream(spark, str(d), glob="*.parquet"), o, name,
                                trigger={"processingTime": "1 second"})
    q = next(x for x in spark.streams.active if x.name == live._qname(name))
    q.processAllAvailable()
    q.stop()
    queue = live.live_kitchen_queue(o, live.current_from_changelog(spark, path)).collect()
    assert [(r.orderID, r.status) for r in queue] == [(1, "pending"), (2, "preparing"), (3, "pending")]


def test_keyset_paging_equals_offset_paging(spark):
    o = _orders(spark, [(i, None, "x", "online", 1, TS + dt.timedelta(hours=i // 3), "pending") for i in range(23)])
    pages, last = [], (None, None)
    while True:
        page = filters.orders_page_after(o, *last, limit=5).collect()
        if not page:
            break
        pages.append([r.orderID for r in page])
        last = (page[-1].orderDateTime, page[-1].orderID)
    want = [[r.orderID for r in filters.orders_page(o, 5, off).collect()] for off in range(0, 23, 5)]
    assert pages == want


def test_payload_files_and_json_sink_round_trip(spark, seed, tmp_path):
    src = tmp_path / "payloads"
    src.mkdir()
    (src / "part-0.json").write_text(
        '{"order_seq": 1, "EmployeeID": null, "customer_name": "Ann", "table_number": "2", '
        '"items": [{"productID": 9, "quantity": 2}]}\n'
        '{"order_seq": 2, "EmployeeID": 1, "customer_name": "Bo", "items": []}\n')
    h, ln = payloads.read_order_payloads(payloads.read_payload_files(spark, str(src)))
    assert sorted((r.order_seq, r.has_items) for r in h.collect()) == [(1, True), (2, False)]
    assert [(r.productID, r.quantity) for r in ln.collect()] == [("9", "2")]
    out = changes.orders_intake(h, ln, seed.products)
    dest = export.write_orders_json(out["orders"], str(tmp_path / "orders_json"))
    back = spark.read.json(dest).collect()
    assert [(r.orderID, r.customer_name, r.order_type) for r in back] == [(1, "[Table 2] Ann", "online")]


def test_search_accent_folding(spark):
    o = _orders(spark, [(1, None, "José Müller", "online", 1, TS, "pending"),
                        (2, None, "Jose Muller", "online", 1, TS, "pending"),
                        (3, None, "Zoë", "online", 1, TS, "pending")])
    plain = sorted(r.orderID for r in filters.orders_search(o, "jose m_ller").collect())
    folded = sorted(r.orderID for r in filters.orders_search(o, "JOSÉ M_LLER", fold_accents=True).collect())
    assert plain == [2] and folded == [1, 2]
    assert [r.orderID for r in filters.orders_search(o, "zoe", fold_accents=True).collect()] == [3]
