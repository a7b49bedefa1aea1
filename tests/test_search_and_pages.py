"""The search index against the plain search, and pages by the map of counts against OFFSET."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from shopflow.operators import deep_pages, filters, search_index
from shopflow.schema import ORDERS as SHOP_ORDERS

ORDERS = T.StructType([T.StructField(f.name, f.dataType) for f in SHOP_ORDERS])  # nulls too

NAMES = ["Ann Lee", "anna", "Bob 10%", "ÉMILE", "x_y", "İnci", "zo", None, "", "Guest 373", "new\nline", "a\\b c"]


def orders(spark, times, names=NAMES):
    rows = [(1000 + 7 * i, None, names[i % len(names)], "online", Decimal(i), t, "pending") for i, t in enumerate(times)]
    return spark.createDataFrame(rows, ORDERS)


def files_read(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.head().metrics().apply("numFiles").value()


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("search") / "orders")
    df = orders(spark, [dt.datetime(2024, 1, 1)] * 900, [f"{NAMES[i % 12]} {i // 75}" if NAMES[i % 12] else NAMES[i % 12]
                                                        for i in range(900)])
    df.repartitionByRange(12, "orderID").sortWithinPartitions("orderID").write.parquet(path)
    return path


def test_search_finds_the_same_rows(spark, table, tmp_path):
    df, ix = spark.read.schema(ORDERS).parquet(table), str(tmp_path / "ix")
    search_index.write_index(df, ix, range_rows=20)
    index = spark.read.parquet(ix)
    for s in ["ann", "ANNA", "ee 1", "b 1_%_", "émile", "inci", "İNCİ", "73", "7", "373", "1_3", "2%45", "guest%11", "10\\%", "x\\_y",
              "w\nlin", "a\\\\b", "nothing at all", "", "%", "5000", "7293", "zo "]:
        assert sorted(map(str, search_index.orders_search(df, index, s).collect())) == sorted(
            map(str, filters.orders_search(df, s).collect())), s


def test_search_reads_fewer_files_and_new_ones(spark, table, tmp_path):
    df, ix = spark.read.schema(ORDERS).parquet(table), str(tmp_path / "ix")
    search_index.write_index(df, ix)
    index = spark.read.parquet(ix)
    every = files_read(filters.orders_search(df, "guest 373 7"))
    assert every == len(df.inputFiles()) > 4
    assert files_read(search_index.orders_search(df, index, "guest 373 7")) <= 3
    assert files_read(search_index.orders_search(df, index, "7279")) == 1
    assert files_read(search_index.orders_search(df, index, "st")) == every  # too short to look up
    more = str(tmp_path / "more")
    old = spark.read.schema(ORDERS).parquet(table)
    old.write.parquet(more)
    search_index.write_index(spark.read.schema(ORDERS).parquet(more), ix)
    orders(spark, [dt.datetime(2024, 2, 1)] * 5, ["Late Comer"]).coalesce(1).write.mode("append").parquet(more)
    found = search_index.orders_search(spark.read.schema(ORDERS).parquet(more), spark.read.parquet(ix), "late com")
    assert found.count() == 5


def test_pattern_grams():
    assert search_index.pattern_grams("%ab%cdef_g%") == ["cde", "def"]
    assert search_index.pattern_grams("%1\\%2%") == ["1%2"] and search_index.pattern_grams("%ab%") == []


def cases():
    d = dt.datetime(2024, 3, 1)
    spread = [d + dt.timedelta(hours=5 * i) for i in range(300)]
    hot = [d + dt.timedelta(days=2, microseconds=i // 3) for i in range(200)]  # a day with most rows
    ties = [d] * 250 + [d - dt.timedelta(days=900)] * 3 + [None] * 200
    return {"spread": spread, "hot": spread[:40] + hot, "ties": ties, "none": []}


@pytest.mark.parametrize("name", cases())
def test_pages_at_any_offset(spark, name):
    df = orders(spark, cases()[name]).coalesce(3).cache()
    n, counts = df.count(), deep_pages.day_counts(df)
    whole = [r.orderID for r in filters.orders_page(df, n + 1, 0).collect()]
    assert deep_pages.total_rows(counts).first()[0] == n
    for off in [0, 1, 57, 199, 240, 252, 260, 299, 452, 453, 600]:
        for zone in (4, 64):
            got = deep_pages.orders_page_at(df, counts, 17, off, zone_rows=zone)
            assert [r.orderID for r in got.collect()] == whole[off:off + 17], (off, zone)


def test_a_task_keeps_no_more_than_a_zone(spark):
    df = orders(spark, cases()["hot"])
    plan = deep_pages.orders_page_at(df, None, 10, 150, zone_rows=8)._jdf.queryExecution().optimizedPlan().toString()
    assert int(plan.split("Offset ")[1].split()[0]) <= 8 if "Offset " in plan else True


def test_counts_follow_changes(spark):
    df = orders(spark, cases()["spread"])
    a, b = df.filter("orderID % 2 = 0"), df.filter("orderID % 2 = 1")
    gone = deep_pages.day_counts(b).selectExpr("day", "-rows AS rows")
    both = deep_pages.add_counts(deep_pages.day_counts(a), deep_pages.day_counts(b))
    assert sorted(both.collect()) == sorted(deep_pages.day_counts(df).collect())
    assert sorted(deep_pages.add_counts(both, gone).collect()) == sorted(deep_pages.day_counts(a).collect())
