"""Checks of new rows against tables that are too large to shuffle for them.

The keys of a table are kept as a Bloom filter: a bitmap of ``bits`` bits, held as a table
of 4 KB blocks that Spark builds by a map-side combined aggregate. New keys look up their
bits in it, a join of the new keys with at most ``bits`` / 32,768 rows. A key with a clear
bit is not in the table. The others are looked for in it: the few candidates are sent to
where the table lies, which is scanned for its key column and not shuffled (more than
``SEND_KEYS`` of them make a shuffle join). Answers are exact whatever the filter says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HASHES = 5
BLOCK = 32768
SEND_KEYS = 1 << 20  # candidate keys broadcast at most


def _places(key: str, bits: int):
    """The bits of a key, from 1."""
    return F.array(*[F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(bits)) + 1 for i in range(HASHES)])


def key_filter(table: DataFrame, key: str, bits: int = 1 << 30) -> DataFrame:
    """(block, bits, size): the Bloom filter of the keys, 128 MB at the most by default.
    Null keys are no keys. Ten bits a key let about 1 % of absent keys through."""
    place = table.filter(F.col(key).isNotNull()).select(F.explode(_places(key, bits)).alias("p"))
    return place.groupBy(F.bitmap_bucket_number("p").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).withColumn("size", F.lit(bits).cast("long"))


def may_exist(keys: DataFrame, key: str, held: DataFrame) -> DataFrame:
    """The distinct keys that have all their bits set."""
    size = held.select("size").first()
    if size is None:
        return keys.select(key).limit(0)
    bit = keys.filter(F.col(key).isNotNull()).select(key).distinct().select(
        key, F.explode(_places(key, size["size"])).alias("p")).select(
        key, F.bitmap_bucket_number("p").alias("block"), F.bitmap_bit_position("p").alias("at"))
    byte = "cast(conv(hex(substring(bits, cast(at div 8 as int) + 1, 1)), 16, 10) as int)"
    found = bit.join(held, "block").filter(F.expr(f"(shiftright({byte}, cast(at % 8 as int)) & 1) = 1"))
    return found.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == HASHES).select(key)


def _among(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """(key, rows) of the table for some keys."""
    keys = keys.persist()
    some = F.broadcast(keys) if keys.count() <= SEND_KEYS else keys
    return table.select(key).join(some, key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("rows"))


def clashing_keys(new: DataFrame, table: DataFrame, key: str, name: str, held: DataFrame) -> DataFrame:
    """Keys of new rows that are not unique once they are added: (table_name, key_column,
    key_value, rows), as the full check reports them. Null keys are left out."""
    own = new.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    there = _among(table, may_exist(own, key, held), key)
    return own.unionByName(there).groupBy(key).agg(F.sum("rows").alias("rows")).filter("rows > 1").select(
        F.lit(name).alias("table_name"), F.lit(key).alias("key_column"), F.col(key).cast("string").alias("key_value"), "rows")


def dangling_keys(new: DataFrame, parent: DataFrame, key: str, name: str, held: DataFrame,
                  nullable: bool = False) -> DataFrame:
    """New rows whose key has no parent row: (reference, key_value, rows) as in the full check."""
    own = (new.filter(F.col(key).isNotNull()) if nullable else new).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    there = _among(parent, may_exist(own, key, held), key)
    return own.join(there.select(key), key, "left_anti").select(
        F.lit(name).alias("reference"), F.col(key).cast("string").alias("key_value"), "rows")
