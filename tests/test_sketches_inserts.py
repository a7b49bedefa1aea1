"""Daily sketches against the exact report, and checks of new rows against the full checks."""

import datetime as dt
import random
from decimal import Decimal

from shopflow.operators import changes, insert_checks, quality, reports, sketches
from shopflow.schema import ORDER_ITEMS, ORDERS, Tables
from shopflow.sources import driver

SF = "/root/testdata/sf0.01"


def test_ranges_of_sketches_are_close(spark):
    t = driver.tables(spark, SF)
    daily = sketches.daily_sketches(t).cache()
    lines = t.order_items.join(t.orders.filter("status = 'completed'").selectExpr(
        "orderID", "to_date(orderDateTime) AS day"), "orderID").join(t.products.select("productID", "category"), "productID")
    lines = lines.select("category", "day", "orderID").distinct().cache()
    rng, worst = random.Random(1), 0.0
    for _ in range(12):
        a = dt.date(1994, 1, 1) + dt.timedelta(days=rng.randrange(1500))
        b = a + dt.timedelta(days=rng.randrange(30, 900))
        exact = {r.category: r["count"] for r in lines.filter(lines.day.between(a, b)).dropDuplicates(
            ["category", "orderID"]).groupBy("category").count().collect()}
        got = {r.category: r.order_count for r in sketches.category_performance(daily, a, b).collect()}
        assert got.keys() == exact.keys()
        worst = max(worst, *(abs(got[c] - n) / n for c, n in exact.items()))
    assert worst < 0.02, worst


def test_sketches_merge(spark, seed):
    ts = dt.datetime(2024, 1, 1)
    o = [(i, None, "x", "online", Decimal(1), ts + dt.timedelta(days=i % 3), "completed" if i % 4 else "pending") for i in range(40)]
    items = [(i, i % 40, 1 + i % 20, 1, Decimal("2.00")) for i in range(90)]
    t = Tables(seed.employees, seed.products, spark.createDataFrame(o, ORDERS), spark.createDataFrame(items, ORDER_ITEMS))
    first, second = (Tables(t.employees, t.products, t.orders.filter(f"orderID % 2 = {k}"), t.order_items) for k in (0, 1))
    both = sketches.add_days(sketches.daily_sketches(first), sketches.daily_sketches(second))
    got = [tuple(r) for r in sketches.category_performance(both, "2024-01-01", "2024-01-02").collect()]
    assert got == [tuple(r) for r in reports.category_performance(t, "2024-01-01", "2024-01-02").collect()]


def keyed(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "orderID long")


def test_new_rows_as_the_full_checks_find_them(spark, monkeypatch):
    table = keyed(spark, [*range(0, 900, 3), 9, 9, None])
    for bits in (1 << 16, 64):  # the small filter lets nearly all through
        held = insert_checks.key_filter(table, "orderID", bits)
        new = keyed(spark, [3, 4, 4, 9, 10, 11, None, -5])
        got = {r.key_value: r.rows for r in insert_checks.clashing_keys(new, table, "orderID", "orders", held).collect()}
        full = quality.duplicate_keys(table.unionAll(new).filter("orderID is not null"), "orderID", "orders").collect()
        assert got == {r.key_value: r.rows for r in full} == {"3": 2, "4": 2, "9": 4}
        got = insert_checks.dangling_keys(new, table, "orderID", "x", held, nullable=True).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, quality.dangling(new, table, "orderID", "x", nullable=True).collect()))
    monkeypatch.setattr(insert_checks, "SEND_KEYS", 0)
    got = insert_checks.clashing_keys(new, table, "orderID", "orders", held).collect()
    assert {r.key_value for r in got} == {"3", "4", "9"}


def test_filter_leaves_few_and_empty_tables(spark):
    table = keyed(spark, range(0, 4000, 2))
    held = insert_checks.key_filter(table, "orderID", 1 << 15)
    some = insert_checks.may_exist(keyed(spark, range(4000)), "orderID", held)
    assert 2000 <= some.count() < 2100
    none = insert_checks.key_filter(keyed(spark, []), "orderID", 1 << 15)
    assert [r.key_value for r in insert_checks.dangling_keys(keyed(spark, [1]), keyed(spark, []), "orderID", "x", none).collect()] == ["1"]
    assert insert_checks.clashing_keys(keyed(spark, [1]), keyed(spark, []), "orderID", "orders", none).count() == 0


def test_the_table_is_not_shuffled(spark, capsys):
    table = spark.range(5000).withColumnRenamed("id", "orderID")
    held = insert_checks.key_filter(table, "orderID", 1 << 16).persist()
    capsys.readouterr()
    insert_checks._among(table, insert_checks.may_exist(keyed(spark, [1, 2]), "orderID", held), "orderID").explain("simple")
    assert "BroadcastHashJoin" in capsys.readouterr().out


def test_cash_beyond_all_digits(spark):
    o = spark.createDataFrame([(1, None, "x", "online", Decimal("10.00"), dt.datetime(2024, 1, 1), "ready")], ORDERS)
    pay = spark.createDataFrame([(1, 1, "99999999999999999999"), (2, 1, "1e400"), (3, 1, "-1e30")], "payment_id long, orderID long, cash string")
    at = {r.payment_id: r.reason for r in changes.payment_settlement(o, pay, counter=True).collect()}
    assert at == {1: "Cash amount is too large", 2: "Cash amount is too large", 3: "Invalid cash amount"}
    got = {r.payment_id: (r.accepted, r.reason) for r in changes.payment_settlement(o, pay).collect()}
    assert got[1] == (True, None) and got[3] == (False, "Invalid cash amount")
