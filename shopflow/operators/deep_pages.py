"""Pages at any offset of the order list by a map of counts.

The map holds how many orders each day has. A page's offset is looked up in it, which
gives the day where the page starts. Where that day has more than ``zone_rows`` rows, it is
counted again by finer ranges of the time (then, among equal times, of the order id), each
time within the range just found, until few enough are left. Only rows from there to the
day where the page ends are read and sorted, and a task keeps at most ``zone_rows`` + limit
of them, whatever the offset.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopflow.operators.filters import page_bounds

ZONE_ROWS = 65536
FAN_BITS = 12  # a count is by at most 2^12 + 1 ranges
_EPOCH = _dt.datetime(1970, 1, 1)
_DAY = 86_400_000_000


def day_counts(orders: DataFrame) -> DataFrame:
    """(day, rows) of orders or of any filtered list of them; a null day is a day too."""
    return orders.groupBy(F.to_date("orderDateTime").alias("day")).agg(F.count(F.lit(1)).alias("rows"))


def add_counts(*maps: DataFrame) -> DataFrame:
    """The map of several lists together; a map with negative rows takes orders out."""
    both = maps[0]
    for m in maps[1:]:
        both = both.unionByName(m)
    return both.groupBy("day").agg(F.sum("rows").alias("rows")).filter("rows <> 0")


def total_rows(counts: DataFrame) -> DataFrame:
    """The number of orders of the list, as one row, without reading them."""
    return counts.agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("result_count"))


def _time(micros: int) -> Column:
    return F.lit((_EPOCH + _dt.timedelta(microseconds=micros)).isoformat(" ")).cast("timestamp_ntz")


def _between(lo: int, hi: int) -> Column:
    return F.col("orderDateTime").between(_time(lo), _time(hi))


def _narrow(df: DataFrame, key: Column, within, lo: int, hi: int, skip: int, zone_rows: int):
    """The range of ``key`` in lo..hi, from its upper end, where ``skip`` rows have gone by:
    (lo, hi, rows, rows to skip in it)."""
    rows = None
    while lo < hi and (rows is None or rows > zone_rows):
        bits = max(0, (hi - lo).bit_length() - FAN_BITS)
        counts = df.filter(within(lo, hi)).groupBy(F.shiftright(key, bits).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        for k, n in sorted(map(tuple, counts.collect()), reverse=True):
            if skip < n:
                break
            skip -= n
        lo, hi, rows = max(lo, k << bits), min(hi, ((k + 1) << bits) - 1), n
    return lo, hi, rows, skip


def orders_page_at(orders: DataFrame, counts: DataFrame | None = None, limit=None, offset=None,
                   zone_rows: int = ZONE_ROWS) -> DataFrame:
    """The page of :func:`shopflow.operators.filters.orders_page`, newest first, found by the
    list's own map (``counts``, taken here by a count where none is given). Orders without a
    time come last. The map must be the list's: one of an older state gives another page."""
    lim, off = page_bounds(limit, offset)
    order = F.col("orderDateTime").desc(), F.col("orderID").desc()
    days = (day_counts(orders) if counts is None else counts).collect()  # one row a day
    days = sorted(((r.day, r.rows) for r in days), key=lambda d: (d[0] is not None, d[0] or _dt.date.min), reverse=True)
    first, skip = 0, off
    while first < len(days) and skip >= days[first][1]:
        skip -= days[first][1]
        first += 1
    if first == len(days) or lim <= 0:
        return orders.limit(0)
    last, seen = first, days[first][1] - skip
    while seen < lim and last + 1 < len(days):
        last += 1
        seen += days[last][1]
    day, rows = days[first]
    t, i = F.col("orderDateTime"), F.col("orderID")
    start = F.lit(True)  # newest end of the page's rows
    if day is not None:
        lo = (day - _EPOCH.date()).days * _DAY
        hi = lo + _DAY - 1
        if rows > zone_rows:
            lo, hi, rows, skip = _narrow(orders, F.unix_micros(t.cast("timestamp")), _between, lo, hi, skip, zone_rows)
        start = t.isNull() | (t <= _time(hi))
        same = t.eqNullSafe(_time(hi))
    else:
        lo = hi = 0
        same, start = t.isNull(), t.isNull()
    if lo == hi and rows > zone_rows:  # many orders of one time: go on by their ids
        equal = orders.filter(same)
        a, b = equal.agg(F.min("orderID"), F.max("orderID")).first()
        _, top, _, skip = _narrow(equal, i.cast("long"), lambda x, y: i.between(x, y), a, b, skip, zone_rows)
        start &= ~same | (i <= top)
    end = days[last][0]
    if end is not None:
        start &= t >= _time((end - _EPOCH.date()).days * _DAY)
    return orders.filter(start).orderBy(*order).offset(skip).limit(lim)
