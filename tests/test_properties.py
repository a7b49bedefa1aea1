"""Property checks: allocation equals a sequential loop; report totals agree."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shopflow.operators import inventory, reports
from shopflow.operators.allocation import stock_allocation
from shopflow.sources import driver

SF = "/root/testdata/sf0.001"


def sequential(stock, avail, lines):
    """The reference's loop: per order (in sequence) check each line against the
    stock as it was before the order, then take the accepted quantities."""
    left = dict(stock)
    out = {}
    for seq in sorted({s for s, _, _ in lines}):
        mine = [(p, q) for s, p, q in lines if s == seq]
        before = dict(left)
        for p, q in mine:
            ok = avail.get(p) == 1 and before.get(p, 0) > 0 and p in stock
            out[(seq, p)] = ok
            if ok:
                left[p] -= q
    return out, left


lines_st = st.lists(st.tuples(st.integers(0, 30), st.integers(1, 4), st.integers(1, 5)),
                    min_size=1, max_size=40)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(lines=lines_st, stocks=st.lists(st.integers(-1, 12), min_size=4, max_size=4),
       buckets=st.integers(1, 6))
def test_allocation_matches_sequential(spark, lines, stocks, buckets):
    stock = {p: stocks[p - 1] for p in range(1, 4)}  # product 4 unknown
    avail = {1: 1, 2: 1, 3: 0}
    req = spark.createDataFrame(lines, "order_seq long, productID long, quantity int")
    prods = spark.createDataFrame([(p, q, avail[p]) for p, q in stock.items()],
                                  "productID long, quantity int, is_available int")
    got = {(r.order_seq, r.productID): r.accepted
           for r in stock_allocation(req, prods, buckets=buckets).collect()}
    want, _ = sequential(stock, avail, lines)
    assert got == want


def test_status_counts_sum_to_orders(spark):
    t = driver.tables(spark, SF)
    total = reports.order_status_counts(t.orders).agg(F.sum("cnt")).first()[0]
    assert total == t.orders.count()


def test_period_reports_agree(spark):
    o = driver.tables(spark, SF).orders
    f, to = "1996-01-01", "1997-12-31"  # whole months and whole ISO years' worth of days
    d = reports.sales_daily(o, f, to).agg(F.sum("order_count"), F.sum("revenue")).first()
    m = reports.sales_monthly(o, f, to).agg(F.sum("order_count"), F.sum("revenue")).first()
    w = reports.sales_weekly(o, f, to).agg(F.sum("order_count"), F.sum("revenue")).first()
    assert tuple(d) == tuple(m) == tuple(w)
    tot = reports.sales_with_total(o, f, to, "monthly").filter("is_total = 1").first()
    assert (tot.order_count, tot.revenue) == tuple(m)


def test_inventory_parts_add_up(spark):
    s = inventory.inventory_summary(driver.tables(spark, SF).products).first()
    assert s.out_of_stock + s.low_stock + s.in_stock == s.total_products


def test_ranking_positions_are_dense(spark):
    r = reports.product_rank_positions(reports.product_ranking(driver.tables(spark, SF)))
    ranks = sorted(x.rank for x in r.select("rank").collect())
    assert ranks == list(range(1, len(ranks) + 1))
    top = r.orderBy("rank").limit(4).collect()
    assert [x.medal for x in top] == [1, 2, 3, None]
    assert all(a.total_sold >= b.total_sold for a, b in zip(top, top[1:]))


def test_category_performance_approx_is_close(spark):
    t = driver.tables(spark, SF)
    exact = {r.category: r.order_count for r in reports.category_performance(t).collect()}
    approx = {r.category: r.order_count for r in reports.category_performance(t, approx=True).collect()}
    assert exact.keys() == approx.keys()
    assert all(abs(approx[k] - exact[k]) <= max(2, 0.05 * exact[k]) for k in exact)


def test_cluster_confs_are_runtime_settable(spark):
    from shopflow.session import CLUSTER_CONFS, apply_confs
    before = {k: spark.conf.get(k, None) for k in CLUSTER_CONFS}
    try:
        apply_confs(spark, CLUSTER_CONFS)
        assert all(spark.conf.get(k) == v for k, v in CLUSTER_CONFS.items())
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
