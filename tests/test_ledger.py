"""The stock ledger against a sequential model."""

import random

from shopflow.operators.ledger import stock_ledger

PRODUCTS = [(1, 5, 1), (2, 0, 1), (3, 8, 0), (4, -3, 1), (5, 40, 1)]


def shown(stock):
    """Nothing is left is all that is told of a stock at or below zero."""
    return stock if stock is None or stock > 0 else 0


def model(lines, sets, switches):
    stock, on = {p: q for p, q, _ in PRODUCTS}, {p: a for p, _, a in PRODUCTS}
    out = []
    for s in sorted({e[0] for e in (*lines, *sets, *switches)}):
        for kind, state in ((sets, stock), (switches, on)):
            now = {}
            for seq, p, v in kind:
                if seq == s and p in state and v is not None:
                    now[p] = max(v, now.get(p, v))
            state.update(now)
        before = dict(stock)
        for seq, p, q in lines:
            if seq == s:
                ok = p in stock and on[p] == 1 and before[p] > 0
                out.append((seq, p, q, shown(before.get(p)), ok))
                if ok:
                    stock[p] -= q
    return sorted(out), sorted((p, stock[p], on[p]) for p in stock)


def run(spark, lines, sets, switches, buckets):
    got = stock_ledger(spark.createDataFrame(lines, "order_seq long, productID long, quantity int").repartition(3),
                       spark.createDataFrame(sets, "order_seq long, productID long, quantity int"),
                       spark.createDataFrame(switches, "order_seq long, productID long, is_available int"),
                       spark.createDataFrame(PRODUCTS, "productID long, quantity int, is_available int"), buckets=buckets)
    rows = sorted((r.order_seq, r.productID, r.quantity, shown(r.stock_before), r.accepted) for r in got["lines"].collect())
    return rows, sorted(tuple(r) for r in got["stock"].collect())


def test_mixed_orders_resets_and_switches(spark):
    rng = random.Random(4)
    for n, buckets in ((120, 5), (60, 100), (300, 16)):
        lines = [(rng.randrange(n), rng.choice([1, 1, 1, 2, 3, 4, 9]), rng.randint(1, 4)) for _ in range(2 * n)]
        sets = [(rng.randrange(n), rng.choice([1, 2, 3, 9]), rng.choice([0, 3, 7, None, -1])) for _ in range(n // 6)]
        switches = [(rng.randrange(n), rng.choice([1, 3, 4]), rng.choice([0, 1])) for _ in range(n // 8)]
        want = model(lines, sets, switches)
        got = run(spark, lines, sets, switches, buckets)
        assert got[0] == want[0] and got[1] == want[1]


def test_without_changes_it_is_the_allocation(spark):
    from shopflow.operators.allocation import stock_allocation
    rng = random.Random(5)
    lines = [(rng.randrange(50), rng.randint(1, 6), rng.randint(1, 3)) for _ in range(150)]
    lines = [x for x in lines if x[1] != 3]  # off sale: there the allocation counts requests too
    rows, _ = run(spark, lines, [], [], 9)
    plain = stock_allocation(spark.createDataFrame(lines, "order_seq long, productID long, quantity int"),
                             spark.createDataFrame(PRODUCTS, "productID long, quantity int, is_available int"))
    assert rows == sorted((*r[:3], shown(r[3]), r[4]) for r in plain.collect())


def test_nothing_at_all(spark):
    assert run(spark, [], [], [], 3) == ([], sorted(PRODUCTS))
    assert run(spark, [], [(1, 1, 7)], [(1, 3, 1)], 3)[1] == [(1, 7, 1), (2, 0, 1), (3, 8, 1), (4, -3, 1), (5, 40, 1)]


def test_no_window_by_product_alone(spark, capsys):
    df = spark.createDataFrame([(1, 1, 1)], "order_seq long, productID long, quantity int")
    sets = spark.createDataFrame([(1, 1, 1)], "order_seq long, productID long, quantity int")
    sw = sets.withColumnRenamed("quantity", "is_available")
    p = spark.createDataFrame(PRODUCTS, "productID long, quantity int, is_available int")
    capsys.readouterr()
    stock_ledger(df, sets, sw, p)["lines"].explain("simple")
    plan = capsys.readouterr().out
    windows = [x for x in plan.splitlines() if "Window [" in x and "_line" in x]
    assert all("_bucket" in x.split("], [")[1] for x in windows)
