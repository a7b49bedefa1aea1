"""Carts from action logs against the sequential rule."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shopflow.operators.cart_log import cart_actions

STOCK = {1: 3, 2: 1, 3: 0, 4: -2, 5: 9999}


def model(actions, counter):
    q, out = {}, {}
    for cart, _, product, kind, v in sorted(actions, key=lambda a: (a[1] is None, a[1] or 0, a[3], (v := a[4]) is not None, v or 0)):
        if product not in STOCK:
            continue
        s, key = STOCK[product], (cart, product)
        have, refused = q.get(key, 0), False
        if kind == "add":
            if have:
                refused = have >= s
                have += not refused
            else:
                refused = counter and s <= 0
                have = 0 if refused else 1
        elif kind == "plus" and have:
            refused = have + 1 > s
            have += not refused
        elif kind == "minus" and have:
            have -= 1
        elif kind == "set" and have:
            refused = v is None or not 1 <= v <= s
            have = have if refused else v
        elif kind == "remove":
            have = 0
        q[key] = have
        n, r = out.get(key, (0, 0))
        out[key] = n + 1, r + refused
    return {k: (q[k], *out[k]) for k in out}


def run(spark, actions, counter, buckets):
    p = spark.createDataFrame(list(STOCK.items()), "productID long, quantity int")
    a = spark.createDataFrame(actions, "cart string, seq long, productID long, kind string, value long").repartition(3)
    got = cart_actions(a, p, counter=counter, buckets=buckets).collect()
    return {(r.cart, r.productID): (r.quantity, r.actions, r.refused) for r in got}


def random_log(rng, n, carts=("a", None, "b")):
    kinds = ["add", "add", "plus", "minus", "minus", "set", "remove", "look"]
    return [(rng.choice(carts), i, rng.choice([1, 1, 1, 2, 3, 4, 5, 6]), rng.choice(kinds),
             rng.choice([None, 0, 1, 2, 3, 4, -1, 50])) for i in range(n)]


def test_logs_against_the_rule(spark):
    rng = random.Random(1)
    for n, buckets, counter in ((300, 7, True), (300, 300, False)):
        log = random_log(rng, n)
        assert run(spark, log, counter, buckets) == model(log, counter)


def test_one_cart_of_a_third_of_all_actions(spark):
    rng = random.Random(2)
    log = [("hot", i, 1, rng.choice(["add", "plus", "minus", "minus", "set"]), rng.choice([1, 2, 3, 9])) for i in range(1500)]
    log += [(f"c{i % 700}", 2000 + i, 5, "add", None) for i in range(3000)]
    assert run(spark, log, True, 500) == model(log, True)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["add", "plus", "minus", "set", "remove"]), st.integers(-1, 5)), max_size=14),
       st.integers(2, 20), st.booleans())
def test_any_short_log(spark, steps, buckets, counter):
    log = [("a", i, 1, k, v) for i, (k, v) in enumerate(steps)] + [("a", 99, 4, "add", None)]
    assert run(spark, log, counter, buckets) == model(log, counter)


def test_ties_null_sequences_and_nothing(spark):
    log = [("a", None, 1, "remove", None), ("a", 5, 1, "add", None), ("a", 5, 1, "add", None), ("a", 5, 1, "set", 3)]
    assert run(spark, log, True, 4) == model(log, True) == {("a", 1): (0, 4, 0)}
    assert run(spark, [], True, 4) == {}
