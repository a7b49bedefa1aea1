"""Streams that keep keyed state: intake, dashboard sums, top products, and the state itself."""

import datetime as dt
import json
import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shopflow.operators import changes, reports
from shopflow.schema import ORDER_ITEMS, ORDERS, Tables
from shopflow.sources import payloads
from shopflow.sources.driver import status_events_from
from shopflow.streaming import dashboard, intake, live
from shopflow.streaming.state import KeyedState

TS = dt.datetime(2024, 5, 1, 12)
KINDS = ["signup", "view", "click", "purchase", "error"]


# ------------------------------------------------------------ keyed state
def state(spark, tmp_path, **kw):
    return KeyedState(spark, str(tmp_path / "s"), "k", "k long, v long", **kw)


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k long, v long")


def held(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_writes_replace_keys_and_grow(spark, tmp_path):
    s = state(spark, tmp_path, rows_per_bucket=4, buckets=2)
    assert held(s.rows()) == [] and not s.started()
    want = {}
    for n in range(6):
        new = {(n * 7 + i) % 40: n for i in range(9)} | {None: n}
        s.write(rows(spark, *new.items()), n)
        want |= new
        assert held(s.rows()) == sorted(want.items(), key=str)
    m = s.manifest()
    assert m["buckets"] >= len(want) // 4 and sum(r for _, r in m["held"].values()) == len(want)


def test_a_batch_reads_its_buckets_whatever_the_table_holds(spark, tmp_path):
    reads = []
    for n in (2000, 16000):
        s = KeyedState(spark, str(tmp_path / f"s{n}"), "k", "k long, v long", rows_per_bucket=50, buckets=2)
        s.write(spark.range(n).selectExpr("id AS k", "id AS v"), 0)
        s.write(rows(spark, (1, 5)), 1)  # grows the buckets
        keys = rows(spark, (3, 0), (70, 0), (999, 0))
        got = s.read(keys, 2)
        assert {r.k for r in got.collect()} >= {3, 70, 999}
        reads.append(got.count())
    assert max(reads) <= 3 * 4 * 50 and reads[1] < 2 * reads[0] + 50


def test_a_retried_batch_starts_from_the_one_before(spark, tmp_path):
    s = state(spark, tmp_path, buckets=4)
    s.write(rows(spark, (1, 1), (2, 2)), 0)
    s.write(rows(spark, (2, 3)), 1)
    before = held(s.read(rows(spark, (2, 0)), 1))
    assert (2, 2) in before and held(s.rows()) == [(1, 1), (2, 3)]
    s.write(rows(spark, (2, 4)), 1)
    assert held(s.rows()) == [(1, 1), (2, 4)] and held(s.rows(1)) == [(1, 1), (2, 2)]


def test_old_folders_are_retired(spark, tmp_path):
    s = state(spark, tmp_path, buckets=3)
    for n in range(8):
        s.write(rows(spark, (1, n), (n + 10, n)), n)
    assert sorted(os.listdir(tmp_path / "s" / "manifest"))[-2:] == ["6.json", "7.json"]
    folders = [(v, b) for v in os.listdir(tmp_path / "s") if v.startswith("v=")
               for b in os.listdir(tmp_path / "s" / v) if b.startswith("_b=")]
    assert len(folders) <= 6  # two versions of three buckets


def test_several_rows_of_a_key_and_empty_batches(spark, tmp_path):
    s = state(spark, tmp_path)
    s.write(rows(spark), 0)
    s.write(rows(spark, (1, 1), (1, 2), (2, 9)), 1)
    s.write(rows(spark), 2)
    s.write(rows(spark, (1, 7)), 3)
    assert held(s.rows()) == [(1, 7), (2, 9)] and held(s.rows(3)) == [(1, 1), (1, 2), (2, 9)]


# ------------------------------------------------------------ files in order
def put(folder, i, lines):
    folder.mkdir(exist_ok=True)
    f = folder / f"part-{i:03}.json"
    f.write_text("".join(line + "\n" for line in lines))
    os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))


def event_files(spark, tmp_path, parts):
    d = tmp_path / "events"
    d.mkdir()
    for i, part in enumerate(parts):
        spark.createDataFrame(part, live.EVENTS).coalesce(1).write.parquet(str(tmp_path / f"e{i}"))
        f = next((tmp_path / f"e{i}").glob("part-*.parquet"))
        os.link(f, d / f"events-{i:03}.parquet")
        os.utime(d / f"events-{i:03}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return live.event_stream(spark, str(d), glob="events-*.parquet", max_files=1)


# ------------------------------------------------------------ intake
def bodies(n, seed):
    """Order bodies: a hot product, quantities of every kind, empty and broken ones."""
    rng, out = random.Random(seed), []
    for i in range(1, n + 1):
        items = [{"productID": rng.choice([1, 1, 1, 20, rng.randint(2, 22)]), "quantity": rng.choice([1, 2, "3", 9, 0])}
                 for _ in range(rng.randint(0, 3))]
        if rng.random() < 0.05 and items:
            items[0]["quantity"] = "x"
        line = json.dumps({"order_seq": i, "EmployeeID": rng.choice([None, 1]), "table_number": rng.choice([None, 4]),
                           "customer_name": f"G{i}", "items": items})
        out.append(line if rng.random() > 0.05 else line[:-6])
    return out


@pytest.mark.parametrize("cuts", [[60], [7, 31]])
def test_any_cut_into_batches_is_one_batch(spark, seed, tmp_path, cuts):
    lines = bodies(60, 3)
    h, ln = payloads.read_order_payloads(payloads.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")))
    want = changes.orders_intake(h, ln, seed.products)
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, 60])):
        put(tmp_path / "in", i, lines[a:b])
    base = intake.run_live_intake(spark, intake.payload_stream(spark, str(tmp_path / "in"), max_files=1),
                                  seed.products, f"intake-{len(cuts)}-{os.getpid()}")
    for kind in intake.OUTPUTS:
        got = intake.taken(spark, base, kind)
        assert held(got.select(want[kind].columns)) == held(want[kind]), kind
    stock = lambda df: sorted((r.productID, r.quantity) for r in df.collect())
    assert stock(intake.stock_now(spark, base, seed.products)) == stock(want["stock"])


def test_a_body_is_parsed_once(spark, seed, tmp_path, monkeypatch):
    parsed, parse = spark.sparkContext.accumulator(0), payloads.parse_lines

    @F.udf("boolean")
    def counted(_):
        parsed.add(1)
        return True

    counted = counted.asNondeterministic()
    monkeypatch.setattr(payloads, "parse_lines", lambda df: parse(df).filter(counted("order_seq")))
    lines = [x for x in bodies(40, 5) if x.endswith("}")]
    put(tmp_path / "in", 0, lines)
    intake.run_live_intake(spark, intake.payload_stream(spark, str(tmp_path / "in")), seed.products, f"once-{os.getpid()}")
    assert parsed.value == len(lines)


def test_some_exponent_is_in_every_exponent(spark):
    texts = ['{"quantity": 1e3}', '{"quantity":-2.5E+1}', '{"table_number" : 10e-1}', '{"quantity": 10}', '{"items": [{"productID": 1.5e0}]}']
    df = spark.createDataFrame([(x,) for x in texts], "value string")
    got = df.select(F.col("value").rlike(payloads._EXPONENT).alias("a"), F.col("value").rlike(payloads._SOME_EXPONENT).alias("b")).collect()
    assert [r.a for r in got] == [True, True, True, False, True] and all(r.b for r in got if r.a)


def test_state_holds_only_products_that_were_asked_for(spark, seed, tmp_path):
    put(tmp_path / "in", 0, ['{"order_seq": 1, "items": [{"productID": 9, "quantity": 2}]}'])
    base = intake.run_live_intake(spark, intake.payload_stream(spark, str(tmp_path / "in")), seed.products, f"one-{os.getpid()}")
    assert [(r.productID, r.quantity) for r in intake.stock_state(spark, base).rows().collect()] == [(9, 98)]


def test_lines_that_are_no_json_and_exponents(spark):
    lines = ['{"order_seq": 7, "items": [{"productID": 1, "quantity": 1e3}, {"productID": "2e1", "quantity": "1e3"}]}',
             '{"order_seq": 8, "EmployeeID": 2, "items": [{"productID": 1', "no json at all", '{"items": []}']
    df = payloads.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    h, ln = payloads.read_order_payloads(df)
    assert sorted(((r.order_seq, r.has_items) for r in h.collect()), key=str) == sorted(
        [(7, True), (8, False), (None, False), (None, False)], key=str)
    got = sorted((r.line_pos, r.productID, float(r.quantity) if r.line_pos == 0 else r.quantity) for r in ln.collect() if r.order_seq == 7)
    assert got == [(0, "1", 1000.0), (1, "2e1", "1e3")]


# ------------------------------------------------------------ dashboard
def orders(spark, n):
    rng = random.Random(9)
    return spark.createDataFrame([(i, 1 if i % 3 else None, "x", "walk-in" if i % 3 else "online", Decimal(rng.randint(100, 9000)) / 100,
                                   TS - dt.timedelta(days=i % 4), rng.choice(["pending", "ready", "completed", "cancelled", "preparing"]))
                                  for i in range(n)], ORDERS)


def moves(n, n_orders, seed):
    rng = random.Random(seed)
    return [(k, TS + dt.timedelta(minutes=rng.randint(0, 40)), rng.randrange(n_orders + 3), rng.choice(KINDS), 1.0, "{}") for k in range(n)]


def test_sums_follow_every_batch(spark, seed, tmp_path):
    o = orders(spark, 20)
    parts = [moves(9, 20, s) for s in range(3)]
    for i, p in enumerate(parts):
        parts[i] = [(100 * i + r[0], *r[1:]) for r in p]
    name = f"dash-sums-{os.getpid()}"
    for i in (3,):
        (tmp_path / f"{i}").mkdir()
        stream = event_files(spark, tmp_path / f"{i}", parts[:i])
        base = dashboard.run_live_dashboard(spark, stream, o, f"{name}-{i}")
        now = changes.status_apply(o, status_events_from(spark.createDataFrame(sum(parts[:i], []), live.EVENTS)))
        t = Tables(seed.employees, seed.products, now, seed.order_items)
        day = TS.date().isoformat()
        assert dashboard.dashboard_stats(spark, base, seed.products, day).first() == reports.dashboard_stats(t, day).first()
        assert held(dashboard.sales_by_day(spark, base, day, 2)) == held(reports.sales_by_day_window(now, day, 2))
        assert held(dashboard.status_counts(spark, base)) == held(reports.order_status_counts(now))


# ------------------------------------------------------------ top products
def test_top_products_equal_the_batch_report(spark, seed, tmp_path):
    rng = random.Random(5)
    o = orders(spark, 25)
    items = spark.createDataFrame([(i, rng.randrange(25), rng.choice([1, 2, 3, rng.randint(1, 23)]), rng.randint(1, 5),
                                    Decimal("2.50")) for i in range(120)], ORDER_ITEMS)
    t = Tables(seed.employees, seed.products, o, items)
    parts = [[(100 * i + r[0], TS + dt.timedelta(hours=i), *r[2:]) for r in moves(12, 25, 40 + i)] for i in range(3)]
    base = dashboard.run_live_top_products(spark, event_files(spark, tmp_path, parts), t, f"top-{os.getpid()}", k=3, size=4)
    now = changes.status_apply(o, status_events_from(spark.createDataFrame(sum(parts, []), live.EVENTS)))
    want = reports.top_products(Tables(seed.employees, seed.products, now, items), 3).collect()
    assert dashboard.top_products(spark, base, seed.products, 3).collect() == want


def test_candidates_are_refilled_exactly_when_they_run_out(spark):
    rng = random.Random(8)
    totals = {p: (p, 1, rng.randint(1, 60), Decimal(p)) for p in range(40)}
    frame = lambda xs: spark.createDataFrame(list(xs), dashboard.TOTALS)
    asked = []

    def everything():
        asked.append(1)
        return frame(totals.values())

    held_, bound = dashboard._refill(everything(), 6)
    asked.clear()
    best = lambda: sorted((r for r in totals.values() if r[1] > 0), key=lambda r: (-r[2], r[0]))[:3]
    calls = 0
    for step in range(14):
        changed = rng.sample(range(40), 5) if step % 3 else [r[0] for r in held_[:5]]
        for p in changed:
            totals[p] = (p, rng.choice([0, 1, 1]), rng.randint(0, 60) if step < 10 else rng.randint(0, 5), Decimal(step))
        kept = len([r for r in held_ if r[0] not in changed])
        held_, bound = dashboard.follow_top(held_, bound, frame(totals[p] for p in changed), everything, 3, 6)
        assert held_[:3] == [(p, n, u, r.quantize(Decimal("0.01"))) for p, n, u, r in best()]
        assert len(held_) <= 12 and (not asked or kept < 3)
        calls += len(asked)
        asked.clear()
    assert 0 < calls < 10
