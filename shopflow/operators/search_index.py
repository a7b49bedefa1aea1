"""Trigram index of the order list's search: posting lists by range of rows.

A range is ``RANGE_ROWS`` rows of one file. The index holds, for each trigram of an order
id or a folded customer name, the ranges where it occurs. A search intersects the lists
of its pattern's trigrams, by field, and reads only files that keep a range; the LIKE
predicate then decides as without the index. Files that the index does not know (added
later) are always read, so an old index costs time, not rows. Patterns without three
letters in a row between wildcards read everything.

Rows of a range lie in one task, so the postings are combined before the shuffle. What
reaches the driver are names of files, which it lists for the scan anyway. How many files
a search leaves out depends on the trigrams: those of ids or rare names are in few files,
those of a word in every name (as "Guest") are in all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopflow.operators.filters import fold, like_pattern, search_predicate

GRAM = 3
RANGE_ROWS = 65536


def _grams(text: Column) -> Column:
    n = F.length(text)
    every = F.transform(F.sequence(F.lit(1), n - GRAM + 1), lambda i: F.substring(text, i, F.lit(GRAM)))
    return F.array_distinct(F.when(n >= GRAM, every).otherwise(F.array().cast("array<string>")))


def postings(orders: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(field, gram, file, part) of orders read from Parquet files: in which ranges each
    trigram occurs. Rows with an empty ``field`` list all ranges. Null names have no trigrams."""
    at = orders.select(F.col("_metadata.file_path").alias("file"),
                       F.expr(f"_metadata.row_index div {range_rows}").alias("part"),
                       F.col("orderID").cast("string").alias("id"), fold(F.coalesce("customer_name", F.lit(""))).alias("name"))

    def of(field: str, grams: Column) -> Column:
        return F.transform(grams, lambda g: F.struct(F.lit(field).alias("field"), g.alias("gram")))

    here = F.array(F.struct(F.lit("").alias("field"), F.lit("").alias("gram")))
    keys = F.concat(of("id", _grams(F.col("id"))), of("name", _grams(F.col("name"))), here)
    return at.select("file", "part", F.explode(keys).alias("k")).select("k.field", "k.gram", "file", "part").distinct()


def write_index(orders: DataFrame, path: str, range_rows: int = RANGE_ROWS) -> None:
    """Write the postings by ranges of trigrams, so that a lookup reads a few row groups."""
    p = postings(orders, range_rows)
    p.repartitionByRange("field", "gram", "file").sortWithinPartitions("field", "gram").write.mode("overwrite").parquet(path)


def pattern_grams(pattern: str) -> list[str]:
    """Trigrams that every match of a LIKE pattern contains (``\\`` escapes)."""
    runs, i = [""], 0
    while i < len(pattern):
        c = pattern[i]
        if c in "%_":
            runs.append("")
        else:
            if c == "\\":
                i += 1
            runs[-1] += pattern[i:i + 1]
        i += 1
    return sorted({r[k:k + GRAM] for r in runs for k in range(len(r) - GRAM + 1)})


def _ranges(index: DataFrame, field: str, grams: list[str]) -> DataFrame:
    """Ranges that hold all the trigrams."""
    found = index.filter((F.col("field") == field) & F.col("gram").isin(grams))
    return found.groupBy("file", "part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams)).select("file")


def files_left_out(index: DataFrame, search: str) -> list[str]:
    """Indexed files without a row that the search could match."""
    p = like_pattern(search)
    ids, names = pattern_grams(p), pattern_grams(p.lower())
    if not ids or not names:
        return []
    some = _ranges(index, "id", ids).unionByName(_ranges(index, "name", names)).distinct()
    known = index.filter("field = ''").select("file").distinct()
    return [r.file for r in known.join(some, "file", "left_anti").collect()]


def orders_search(orders: DataFrame, index: DataFrame, search: str) -> DataFrame:
    """The rows of :func:`shopflow.operators.filters.orders_search`, reading only files that
    can hold one. ``orders`` must be read from the files themselves (or filters on them)."""
    out = files_left_out(index, search)
    found = orders.filter(~F.col("_metadata.file_path").isin(out)) if out else orders
    return found.filter(search_predicate(search))
