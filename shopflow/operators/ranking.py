"""Global row numbers without a single-partition window.

``row_number().over(Window.orderBy(...))`` moves every row into one task. Here
the rows are range-sorted across partitions and the sorted frame is
checkpointed; ``monotonically_increasing_id`` then numbers the rows within their
partitions without a shuffle, and the partitions' row counts (one row each) give
the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_row_number(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` plus a 1-based position ``name`` (long) in the total order ``order``
    (which must be a strict order, i.e. end in a unique key)."""
    s = df.orderBy(*order).checkpoint().withColumn("_id", F.monotonically_increasing_id())
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = s.groupBy(part.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: bounded by the partition count, safe to broadcast.
    offs = counts.select("_pid", F.coalesce(
        F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_off"))
    return (s.withColumn("_pid", part).join(F.broadcast(offs), "_pid", "inner")
            .withColumn(name, place + F.col("_off") + 1).drop("_pid", "_id", "_off"))
