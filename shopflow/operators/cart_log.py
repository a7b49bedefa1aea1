"""Carts from their action log: adds, steps of one, typed quantities and removals.

Each action is a map on the quantity of its cart line, 0 standing for no line, up to the
product's stock s. All of them have the form

    q -> zero                  for q <= upto
    q -> min(q + plus, cap)    for q >  upto

and so has one after the other: for f, then g, quantities that f sends to ``g.upto`` or
below join the first case, and the others get ``min(q + f.plus + g.plus,
min(f.cap + g.plus, g.cap))``. Composing is associative, so actions are folded in runs, runs
are folded in order, and each run then starts from the quantity that the runs before it
give. A cart holding a third of all actions is as many runs as it has ranges of the
sequence. The second pass over a run counts what the shop refuses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopflow.operators.allocation import bucketed

ADD, PLUS, MINUS, SET, REMOVE = "add", "plus", "minus", "set", "remove"  # fixed: kinds of action
FAR = 1 << 40  # above any quantity
RUNS = 256  # ranges folded together on the second level

# (upto, zero, plus, cap) of one action; ``s`` is the stock, ``v`` the typed quantity.
_SAME = "named_struct('upto', 0L, 'zero', 0L, 'plus', 0L, 'cap', {far}L)".format(far=FAR)
_ONE = f"""CASE
  WHEN x.kind = 'add' THEN IF(s > 0 OR free, named_struct('upto', 0L, 'zero', 1L, 'plus', 1L, 'cap', GREATEST(s, 1L)), {_SAME})
  WHEN x.kind = 'plus' THEN named_struct('upto', 0L, 'zero', 0L, 'plus', 1L, 'cap', GREATEST(s, 1L))
  WHEN x.kind = 'minus' THEN named_struct('upto', 1L, 'zero', 0L, 'plus', -1L, 'cap', {FAR}L)
  WHEN x.kind = 'set' THEN IF(x.v >= 1 AND x.v <= s, named_struct('upto', 0L, 'zero', 0L, 'plus', {FAR}L, 'cap', x.v), {_SAME})
  WHEN x.kind = 'remove' THEN named_struct('upto', {FAR}L, 'zero', 0L, 'plus', 0L, 'cap', {FAR}L)
  ELSE {_SAME} END"""


def _value(f: str, q: str) -> str:
    return f"IF({q} <= {f}.upto, {f}.zero, LEAST({q} + {f}.plus, {f}.cap))"


def _then(f: str, g: str) -> str:
    """f, then g. Quantities above ``f.upto`` lie at ``f.cap`` at most after f."""
    return f"""named_struct(
      'upto', IF({f}.cap <= {g}.upto, {FAR}L, GREATEST({f}.upto, LEAST({g}.upto - {f}.plus, {FAR}L))),
      'zero', {_value(g, f + '.zero')},
      'plus', GREATEST(LEAST({f}.plus + {g}.plus, {FAR}L), -{FAR}L),
      'cap', LEAST({f}.cap + {g}.plus, {g}.cap, {FAR}L))"""


def _fold(array: str, one: str) -> str:
    return f"aggregate({array}, {_SAME}, (f, x) -> {_then('f', '(' + one + ')')})"


def cart_actions(actions: DataFrame, products: DataFrame, cart: str = "cart", seq: str = "seq",
                 counter: bool = True, buckets: int | None = None) -> DataFrame:
    """The cart lines that a log leaves: (cart, productID, quantity, actions, refused).

    ``actions``: (cart, seq, productID, kind, value); ``value`` is what was typed (a 'set').
    In a cart, actions count in the order of ``seq`` (ties: by kind, then value).

    * ``add`` starts a line at 1 or raises it by one, ``plus`` and ``minus`` step an existing
      line, ``set`` puts it to a number, ``remove`` drops it; a line at 0 is dropped.
    * Refused, the line staying as it is: a step or an add beyond the stock; a typed number
      below 1, missing, or above the stock; with ``counter``, an add of a product without
      stock (the menu page, ``counter=False``, lets the first one through).
    * Without a line, ``plus``, ``minus``, ``set`` and ``remove`` do nothing and are not
      refusals. Actions on unknown products, and unknown kinds, do nothing.

    Lines left at no quantity are returned with quantity 0. Null sequences come last; a null
    cart is a cart."""
    s = products.select("productID", F.greatest(F.col("quantity").cast("long"), F.lit(0)).alias("s"))
    rows = bucketed(actions.select(cart, F.col(seq).cast("long").alias("_seq"), "productID", "kind",
                                   F.col("value").cast("long").alias("v")), "_seq", buckets)
    key = [F.coalesce(F.col(cart).cast("string"), F.lit("\x00")).alias("_cart"), "productID"]
    step = F.struct(F.col("_seq").isNull().alias("late"), "_seq", "kind", "v")
    free = f"{'false' if counter else 'true'} AS free"
    runs = (rows.groupBy(*key, "_bucket").agg(F.sort_array(F.collect_list(step)).alias("steps"), F.first(cart).alias(cart))
            .join(s, "productID").selectExpr("*", free).withColumn("f", F.expr(_fold("steps", _ONE))))
    # Runs of a range of runs, then the ranges: each fold sees RUNS of them or few.
    part = F.floor(F.col("_bucket") / RUNS).alias("_part")
    by_key = ["_cart", "productID"]
    listed = F.sort_array(F.collect_list(F.struct(F.col("_bucket").alias("at"), "f")))
    parts = runs.select(*by_key, "_bucket", part, "f").groupBy(*by_key, "_part").agg(listed.alias("fs")).withColumn(
        "whole", F.expr(_fold("fs", "x.f")))
    starts = F.expr(f"""aggregate(ps, named_struct('q', 0L, 'out', array_repeat(named_struct('at', 0L, 'q', 0L), 0)),
      (a, x) -> named_struct('q', {_value('x.f', 'a.q')}, 'out', array_append(a.out, named_struct('at', x.at, 'q', a.q)))).out""")
    wholes = parts.groupBy(*by_key).agg(F.sort_array(F.collect_list(F.struct(F.col("_part").cast("long").alias("at"), F.col("whole").alias("f")))).alias("ps"))
    of_part = wholes.select(*by_key, F.explode(starts).alias("o")).select(*by_key, F.col("o.at").alias("_part"), F.col("o.q").alias("q0"))
    inner = F.expr(f"""aggregate(fs, named_struct('q', q0, 'out', array_repeat(named_struct('at', 0, 'q', 0L), 0)),
      (a, x) -> named_struct('q', {_value('x.f', 'a.q')}, 'out', array_append(a.out, named_struct('at', x.at, 'q', a.q)))).out""")
    of_run = parts.join(of_part, [*by_key, "_part"]).select(*by_key, F.explode(inner).alias("o")).select(
        *by_key, F.col("o.at").alias("_bucket"), F.col("o.q").alias("q0"))
    # Second pass: from its start, what each action does and whether it is refused.
    refuses = """CASE
      WHEN x.kind = 'add' THEN (a.q > 0 AND a.q >= s) OR (a.q = 0 AND s <= 0 AND NOT free)
      WHEN x.kind = 'plus' THEN a.q > 0 AND a.q + 1 > s
      WHEN x.kind = 'set' THEN a.q > 0 AND NOT COALESCE(x.v >= 1 AND x.v <= s, false)
      ELSE false END"""
    again = F.expr(f"""aggregate(steps, named_struct('q', q0, 'refused', 0L), (a, x) -> named_struct(
      'q', IF({refuses}, a.q, {_value('(' + _ONE + ')', 'a.q')}), 'refused', a.refused + IF({refuses}, 1L, 0L)))""")
    ends = runs.join(of_run, [*by_key, "_bucket"]).withColumn("end", again)
    return (ends.groupBy(*by_key).agg(
        F.first(cart).alias(cart), F.max(F.struct("_bucket", "end.q"))["q"].alias("quantity"),
        F.sum(F.size("steps")).alias("actions"), F.sum("end.refused").alias("refused"))
        .select(cart, "productID", "quantity", "actions", "refused"))
