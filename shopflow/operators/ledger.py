"""Stock ledger: orders served one after the other while stock is set and goods go on and
off sale in between.

A line is accepted when its product is on sale and its stock is above zero as its order is
checked; all lines of one order see the same stock, the last accepted one may oversell.
A stock set puts the product's stock to a number; availability switches it on or off.
Between two sets stock only falls, so a line's stock is the last set less all requests since
that came while the product was on sale: a prefix sum that restarts at each set.

Sums go in two levels, like in :mod:`~shopflow.operators.allocation`: the sequence is cut
into ranges of about equal counts, windows run inside (product, range), and what a range
hands on (its last switch; its last set and the requests since) is carried over the ranges,
of which a product has at most ``buckets``. No window holds a product's lines as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopflow.operators.allocation import bucketed

_PREV, _HERE = Window.unboundedPreceding, Window.currentRow


def _carried(totals: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """``cols`` over the earlier ranges of each product (one row a product and range)."""
    return totals.select("productID", "_bucket", *[c.alias(n) for n, c in cols.items()])


def stock_ledger(lines: DataFrame, sets: DataFrame, switches: DataFrame, products: DataFrame,
                 seq: str = "order_seq", buckets: int | None = None) -> dict[str, DataFrame]:
    """Decide every line, and the stock in the end.

    ``lines``: (seq, productID, quantity >= 1, ...); ``sets``: (seq, productID, quantity);
    ``switches``: (seq, productID, is_available); ``products``: (productID, quantity,
    is_available, ...) as they stand before. At one sequence number sets and switches come
    before lines; of several sets (switches) of a product there, the greatest counts.
    Changes of unknown products do nothing; null quantities of sets are ignored.

    Returns ``lines`` with ``stock_before`` (the stock when the order was checked; at or below
    zero, less what was asked for in vain; null for unknown products) and ``accepted``,
    and ``stock``: ``products`` with the quantity and availability that are left.
    """
    known = products.select("productID")
    empty = F.lit(None).cast("long")
    asked = lines.select(F.col(seq).cast("long").alias("_seq"), "productID", F.col("quantity").cast("long").alias("_q"),
                         empty.alias("_set"), empty.alias("_on"), F.struct(*lines.columns).alias("_line"))
    kind = asked.schema["_line"].dataType

    def event(df: DataFrame, value: str, name: str) -> DataFrame:
        one = (df.filter(F.col(value).isNotNull() & F.col(seq).isNotNull()).join(known, "productID", "left_semi")
               .groupBy(F.col(seq).cast("long").alias("_seq"), "productID").agg(F.max(F.col(value).cast("long")).alias("_v")))
        cols = {n: F.col("_v") if n == name else empty for n in ("_q", "_set", "_on")}
        return one.select("_seq", "productID", *[c.alias(n) for n, c in cols.items()], F.lit(None).cast(kind).alias("_line"))

    # One event a row; lines of one sequence number have one effect, and a null number its own range.
    events = asked.unionByName(event(sets, "quantity", "_set")).unionByName(event(switches, "is_available", "_on"))
    events = bucketed(events, "_seq", buckets)
    by = Window.partitionBy("productID", "_bucket").orderBy("_seq")
    upto, earlier = by.rangeBetween(_PREV, _HERE), by.rangeBetween(_PREV, -1)
    over = Window.partitionBy("productID").orderBy("_bucket").rowsBetween(_PREV, -1)
    start = products.select("productID", F.col("quantity").cast("long").alias("_stock0"),
                            F.col("is_available").cast("long").alias("_on0"))

    # On sale or not: the last switch of the range, else of the ranges before, else as it stood.
    ranges = events.groupBy("productID", "_bucket").agg(F.max(F.when(F.col("_on").isNotNull(), F.struct("_seq", "_on")))["_on"].alias("_last"))
    before = _carried(ranges, {"_on1": F.last("_last", True).over(over)}).join(start, "productID", "left")
    e = events.withColumns({"_here": F.last("_on", True).over(upto),
                            # sets so far in the range: requests are summed between two of them
                            "_run": F.count("_set").over(upto), "_base": F.last("_set", True).over(upto)})
    e = e.join(before, ["productID", "_bucket"]).withColumn("_sale", F.coalesce("_here", "_on1", "_on0") == 1)
    e = e.withColumn("_want", F.when(F.col("_sale"), F.coalesce("_q", F.lit(0))).otherwise(0)).drop("_here", "_on1", "_on0")

    # Requests since the last set of the range; what the range hands on is its last run.
    run = Window.partitionBy("productID", "_bucket", "_run").orderBy("_seq").rangeBetween(_PREV, -1)
    e = e.withColumn("_since", F.coalesce(F.sum("_want").over(run), F.lit(0)))
    runs = e.groupBy("productID", "_bucket", "_run").agg(F.sum("_want").alias("_sum"), F.max("_base").alias("_base"))
    last = runs.groupBy("productID", "_bucket").agg(F.max(F.struct("_run", "_sum", "_base")).alias("_l"))
    # Over the ranges: runs are numbered by the sets seen, and sums are taken within a number.
    sets_seen = F.sum(F.col("_l._run")).over(over.rowsBetween(_PREV, _HERE))
    chain = last.select("productID", "_bucket", sets_seen.alias("_n"), "_l").withColumn(
        "_tail", F.sum("_l._sum").over(Window.partitionBy("productID", "_n").orderBy("_bucket").rowsBetween(_PREV, _HERE)))
    handed = F.struct(F.col("_tail").alias("used"), F.last("_l._base", True).over(over.rowsBetween(_PREV, _HERE)).alias("base"))
    chain = chain.withColumn("_handed", handed)
    into = _carried(chain, {"_in": F.lag("_handed").over(Window.partitionBy("productID").orderBy("_bucket"))})

    whole = F.col("_run") == 0  # no set in the range yet: what came before counts too
    stock = F.when(whole, F.coalesce("_in.base", "_stock0") - F.coalesce("_in.used", F.lit(0))).otherwise(F.col("_base"))
    decided = (e.filter(F.col("_line").isNotNull()).join(into, ["productID", "_bucket"])
               .withColumn("stock_before", stock - F.col("_since"))
               .withColumn("accepted", F.coalesce(F.col("_sale") & (F.col("stock_before") > 0), F.lit(False))))

    # What is left: the last set (or the first stock) less what was accepted since.
    done = decided.filter("accepted").groupBy("productID", "_bucket", "_run").agg(F.sum("_q").alias("_sold"))
    ends = chain.groupBy("productID").agg(F.max("_n").alias("_sets"), F.max(F.struct("_bucket", "_handed"))["_handed"]["base"].alias("_base"))
    numbered = chain.select("productID", "_bucket", (F.col("_n") - F.col("_l._run")).alias("_n0"))
    sold = (done.join(numbered, ["productID", "_bucket"]).withColumn("_sets", F.col("_n0") + F.col("_run"))
            .join(ends.select("productID", "_sets"), ["productID", "_sets"], "left_semi")
            .groupBy("productID").agg(F.sum("_sold").alias("_sold")))
    on = ranges.groupBy("productID").agg(F.max(F.when(F.col("_last").isNotNull(), F.struct("_bucket", "_last")))["_last"].alias("_on"))
    left = ends.select("productID", "_base").join(sold, "productID", "left").join(on, "productID", "left")
    after = (products.join(left, "productID", "left")
             .withColumn("quantity", (F.coalesce("_base", F.col("quantity").cast("long")) - F.coalesce("_sold", F.lit(0))).cast("long"))
             .withColumn("is_available", F.coalesce("_on", F.col("is_available").cast("long")).cast("int"))
             .drop("_base", "_sold", "_on"))
    return {"lines": decided.select("_line.*", "stock_before", "accepted"), "stock": after.select(*products.columns)}
