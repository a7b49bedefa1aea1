"""Order intake against a plain sequential model of the shop's order loop."""

import json
import re
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shopflow.operators import changes
from shopflow.sources import payloads

PRODUCTS = {1: (2, 1, Decimal("10.00")), 2: (5, 1, Decimal("2.50")), 3: (4, 0, Decimal("7.00"))}


def parse_int(v):
    if v is None:
        return None
    m = re.match(r"^\s*([+-]?)0[xX]([0-9a-fA-F]+)", str(v))
    if m:
        return int(m.group(2), 16) * (-1 if m.group(1) == "-" else 1)
    m = re.match(r"^\s*([+-]?\d+)", str(v))
    return int(m.group(1)) if m else None


def model(orders):
    """The loop: empty cart; per item a product check against stock as it was
    before this order; no valid item; a failing insert (label > 100 chars or a
    non-numeric quantity) rolls the order back; else stock is taken."""
    stock = {k: list(v) for k, v in PRODUCTS.items()}
    out, items, rejects = {}, [], {}
    for seq, emp, body in orders:
        its = (body or {}).get("items") or []
        if not its:
            rejects[seq] = "Cart is empty"
            continue
        name = body.get("customer_name") or "Customer"
        raw = re.sub(r"[<>\"']", "", name.strip())
        t = parse_int(body.get("table_number")) if body.get("table_number") else None
        label = f"[Table {t}] {raw}" if t else raw
        kind = "online" if t else ("walk-in" if emp else "online")
        pushed = []
        for it in its:
            pid = parse_int(it.get("productID"))
            p = stock.get(pid)
            if pid is None or p is None or p[1] != 1 or p[0] <= 0:
                continue
            q = parse_int(it.get("quantity"))
            pushed.append((pid, None if q is None else max(1, q), p[2]))
        if not pushed:
            rejects[seq] = "No valid items in cart"
            continue
        if len(label) > 100 or any(q is None for _, q, _ in pushed):
            rejects[seq] = "Order failed"
            continue
        out[seq] = (label, kind, sum(q * pr for _, q, pr in pushed))
        for pid, q, pr in pushed:
            stock[pid][0] -= q
            items.append((seq, pid, q, pr))
    return out, sorted(items), rejects, {k: v[0] for k, v in stock.items()}


item_st = st.fixed_dictionaries({"productID": st.sampled_from([1, 2, 3, 4, "2", "x"]),
                                 "quantity": st.sampled_from([1, 2, 3, 0, -1, "2x", "x"])})
body_st = st.one_of(st.none(), st.fixed_dictionaries(
    {"customer_name": st.sampled_from(["Ann", "", "  Bo <b> ", "x" * 101]),
     "table_number": st.sampled_from([None, 0, "3", "0"]),
     "items": st.lists(item_st, max_size=3)}))
orders_st = st.lists(st.tuples(body_st, st.sampled_from([None, 7])), min_size=1, max_size=8)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(orders=orders_st)
def test_intake_matches_sequential_model(spark, orders):
    rows = [(i + 1, emp, json.dumps(body) if body is not None else "{bad")
            for i, (body, emp) in enumerate(orders)]
    p = spark.createDataFrame(rows, "order_seq long, EmployeeID long, body string")
    prods = spark.createDataFrame([(k, q, a, pr) for k, (q, a, pr) in PRODUCTS.items()],
                                  "productID long, quantity int, is_available int, price decimal(10,2)")
    h, ln = payloads.read_order_payloads(p)
    out = changes.orders_intake(h, ln, prods)
    want_o, want_i, want_r, want_s = model([(i + 1, emp, body) for i, (body, emp) in enumerate(orders)])
    got_o = {r.orderID: (r.customer_name, r.order_type, r.totalAmount) for r in out["orders"].collect()}
    got_i = sorted((r.order_seq, r.productID, r.quantity, r.price) for r in out["items"].collect())
    got_r = {r.order_seq: r.reason for r in out["rejects"].collect()}
    got_s = {r.productID: r.quantity for r in out["stock"].collect()}
    assert (got_o, got_i, got_r, got_s) == (want_o, want_i, want_r, want_s)
