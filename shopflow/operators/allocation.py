"""Sequential stock allocation as a set-based job.

Orders are served in ``order_seq`` order. A line is accepted while the
product's remaining stock is above zero when its order is checked; all lines of
one order see the same (pre-order) stock, and the last accepted order may
oversell. Because every accepted quantity is >= 1, remaining stock only falls,
so "stock minus all earlier requests > 0" equals the sequential rule.

The prefix sum "all earlier requests of this product" is computed in two
levels so that one product holding a large share of all lines is never a
single window partition:

1. the order sequence is cut into at most ``buckets`` ranges of about equal line
   counts, from a histogram of equal-width cells (one small aggregate);
2. lines are shuffled once, by (product, bucket); a window over that
   partitioning gives the demand of earlier orders inside the bucket (a range
   frame ending one below the current sequence, so lines of one order see
   the same stock);
3. bucket totals (one row per product and bucket; partial sums combine
   map-side) get an exclusive running sum over buckets (at most ``buckets``
   rows per product) and the product's stock, and are joined to the lines on
   (product, bucket), by which the lines are dealt already. No join or
   exchange of lines is by product alone.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_PREV = Window.unboundedPreceding


def _bucket_splits(df: DataFrame, col: str, buckets: int) -> list[float]:
    """Bucket bounds on ``col`` at about equal counts: the counts of at most
    ``CELLS`` equal-width cells between its least and greatest value, one row each,
    are cut into ``buckets`` runs. Values of one cell stay together."""
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    if lo is None or lo == hi or buckets < 2:
        return [float("-inf"), float(lo or 0), float("inf")]  # Bucketizer needs >= 3 splits
    width = max(1, -(-(hi - lo + 1) // CELLS))
    cells = df.where(F.col(col).isNotNull()).groupBy(F.floor((F.col(col) - lo) / width).alias("c")).agg(
        F.count(F.lit(1)).alias("n")).orderBy("c").collect()
    size = sum(r.n for r in cells) / buckets
    splits, n = [], 0
    for r in cells:
        if n >= size * (len(splits) + 1):
            splits.append(float(lo + r.c * width))
        n += r.n
    return [float("-inf")] + (splits or [float(lo)]) + [float("inf")]


CELLS = 1 << 16
MAX_BUCKETS = 1 << 16


def default_buckets(df: DataFrame) -> int:
    """Sequence buckets: 4 per shuffle partition, between 64 and 65,536. A product
    holding a third of 600 billion lines then has about 3 million lines per
    window partition, and the per-product window over bucket totals has at
    most 65,536 rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return min(MAX_BUCKETS, max(64, 4 * n))


def bucketed(requests: DataFrame, seq: str = "order_seq", buckets: int | None = None,
             splits_from: DataFrame | None = None) -> DataFrame:
    """``requests`` plus ``_bucket``, the range of their sequence (``seq`` must be
    integral). Bounds come from the sequence values of ``splits_from`` (default:
    ``requests``), e.g. the lines before a join."""
    from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

    if not isinstance(requests.schema[seq].dataType, (ByteType, ShortType, IntegerType, LongType)):
        raise ValueError(f"{seq} must be an integral sequence (the frame ends at seq - 1)")
    buckets = buckets or default_buckets(requests)
    splits = _bucket_splits(splits_from if splits_from is not None else requests, seq, buckets)
    # A null sequence gets a bucket of its own, the last.
    return Bucketizer(splits=splits, inputCol="_seqd", outputCol="_bucket", handleInvalid="keep").transform(
        requests.withColumn("_seqd", F.col(seq).cast("double"))).drop("_seqd").withColumn(
        "_bucket", F.coalesce(F.col("_bucket").cast("int"), F.lit(len(splits) - 1)))


def demand_before(requests: DataFrame, seq: str = "order_seq", per_product: DataFrame | None = None) -> DataFrame:
    """``requests`` lines (with ``_bucket``) plus ``before`` = the product's requested
    quantity in all earlier orders, and the columns of ``per_product`` (unique
    productID; null where it lacks the product). Those are joined to the bucket
    totals, so the lines are dealt once, by (product, bucket)."""
    earlier = Window.partitionBy("productID", "_bucket").orderBy(F.col(seq)).rangeBetween(_PREV, -1)
    x = requests.withColumn("_ioff", F.coalesce(F.sum("quantity").over(earlier), F.lit(0)))
    # Bucket totals straight from the lines: partial sums combine map-side, so
    # only (product, bucket) partials are shuffled, not the lines again.
    bt = requests.groupBy("productID", "_bucket").agg(F.sum("quantity").alias("_btot"))
    wb = Window.partitionBy("productID").orderBy("_bucket").rowsBetween(_PREV, -1)
    bo = bt.select("productID", "_bucket", F.coalesce(F.sum("_btot").over(wb), F.lit(0)).alias("_boff"))
    if per_product is not None:
        bo = bo.join(per_product, "productID", "left")
    return (x.join(bo, ["productID", "_bucket"], "inner")
            .withColumn("before", F.col("_boff") + F.col("_ioff")).drop("_ioff", "_boff"))


def decide(requests: DataFrame, stock: DataFrame, seq: str = "order_seq") -> DataFrame:
    """Decide bucketed request lines against ``stock`` (productID, quantity,
    is_available, ...): ``stock_before``, ``accepted`` and stock's further columns."""
    s = stock.withColumnsRenamed({"quantity": "_stock", "is_available": "_avail"})
    d = demand_before(requests, seq, s)
    remaining = F.col("_stock") - F.col("before")
    return (d.withColumn("stock_before", remaining)
            .withColumn("accepted", F.coalesce((F.col("_avail") == 1) & (remaining > 0), F.lit(False)))
            .drop("_stock", "_avail", "before"))


def stock_allocation(requests: DataFrame, stock: DataFrame, seq: str = "order_seq",
                     buckets: int | None = None, splits_from: DataFrame | None = None) -> DataFrame:
    """Decide every request line.

    ``requests``: (seq, productID, quantity, ...) lines; ``stock``: (productID,
    quantity, is_available). Returns the request lines with ``stock_before``
    (remaining stock when the order was checked; null for unknown products)
    and ``accepted``.
    """
    lines = bucketed(requests, seq, buckets, splits_from)
    return decide(lines, stock.select("productID", "quantity", "is_available"), seq).select(
        *requests.columns, "stock_before", "accepted")


def stock_after(stock: DataFrame, decided: DataFrame) -> DataFrame:
    """Products with quantity reduced by their accepted quantities."""
    sold = (decided.filter(F.col("accepted")).groupBy("productID")
            .agg(F.sum("quantity").alias("_sold")))
    return (stock.join(sold, "productID", "left")
            .withColumn("quantity", (F.col("quantity") - F.coalesce(F.col("_sold"), F.lit(0))).cast("long"))
            .drop("_sold"))
