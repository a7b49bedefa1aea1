"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash and served in that order, again from
the start for every repeat. A copy's virtual finish time is the source's words served
up to its end divided by the source's target. All copies are sorted by it over a range
partitioning, and the order is truncated when the total budget is served: virtual time
1, when every source has got its target. Of the copy that a source is serving then, the
words served so far are taken.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shopflow.llm.common import map_rows, read_table, row_key, stage_table

WEIGHTS = (5, 2, 1)  # by source in code point order, repeating
MAX_REPEATS = 3
UNFOLD = 1 << 14  # equal rows written out by one task


def sizes(docs: DataFrame) -> DataFrame:
    """(rk, doc_id, source, size) for every input row; size is the number of words."""

    def run(b: pa.RecordBatch) -> dict:
        return {n: b.column(i) for i, n in enumerate(("rk", "doc_id", "source"))} | {
            "size": [len((t or b"").split()) for t in b.column(3).to_pylist()]}

    return map_rows(docs.select(row_key("doc_id", "source", "text").alias("rk"),
                                F.col("doc_id").cast("long").alias("doc_id"),
                                F.col("source").cast("string").alias("source"),
                                F.col("text").cast("binary").alias("t")),
                    run, "rk long, doc_id long, source string, size long")


def targets(rows: DataFrame, budget: int | None = None, weights: tuple = WEIGHTS,
            max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target, goal) from (source, size) rows: the budget (default: all
    words) shared by weight, at most ``max_repeats`` times a source's size; what a capped
    source leaves is reshared by weight until no target is above its cap. ``goal`` is the
    target in whole words.

    One row per source; the sharing is a running sum over sources in the order in which
    they reach their caps, so it needs no loop: the k sources with the least size per
    weight are capped, where k is the first at which the next one is not."""
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source (names, not documents): windows over them are small
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.array(*map(F.lit, weights))
    s = s.withColumn("w", F.element_at(w, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    s = s.withColumn("cap", F.col("source_size") * max_repeats)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    total = F.lit(budget).cast("double") if budget is not None else F.sum("source_size").over(every).cast("double")
    s = (s.withColumn("left", F.greatest(F.lit(0.0), total - F.coalesce(F.sum("cap").over(before), F.lit(0))))
         .withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
         .withColumn("rate", F.col("left") / F.col("w_left")))
    # from the first source on that stays under its cap, the rate is the same for all
    first = F.min(F.when(F.col("rate") * F.col("w") < F.col("cap"), F.struct("place", "rate"))).over(every)
    s = s.withColumn("place", F.row_number().over(fill)).withColumn("open", first)
    s = s.select("source", "source_size", F.when(
        F.col("open").isNull() | (F.col("place") < F.col("open.place")), F.col("cap").cast("double"))
        .otherwise(F.col("open.rate") * F.col("w")).alias("target"))
    # whole words: roundings of the running sum, so that the goals add up to the budget
    upto = F.round(F.sum("target").over(by_name.rowsBetween(Window.unboundedPreceding, 0))).cast("long")
    return s.withColumn("upto", upto).withColumn(
        "goal", F.col("upto") - F.coalesce(F.lag("upto").over(by_name), F.lit(0))).drop("upto")


def running_sum(df: DataFrame, order: list[Column], value: str, out: str, group: str | None = None) -> DataFrame:
    """``df`` globally sorted by ``order`` with ``out``: the sum of ``value`` over the rows
    before each one (of its ``group``). Range partitions are sorted and summed on their
    own; only one number per partition (and group) is carried between them."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = stage_table(df.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()), "mix-order")
    own = ["__p"] + ([group] if group else [])
    sums = parts.groupBy(*own).agg(F.sum(value).alias("__v"))
    earlier = Window.partitionBy(*([group] if group else [F.lit(0)])).orderBy("__p").rowsBetween(
        Window.unboundedPreceding, -1)
    sums = sums.withColumn("__base", F.coalesce(F.sum("__v").over(earlier), F.lit(0))).drop("__v")
    inner = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = parts.withColumn("__in", F.coalesce(F.sum(value).over(inner), F.lit(0))).alias("a").join(
        sums.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in own])
    return joined.select(*[F.col(f"a.{c}") for c in df.columns],
                         (F.col("a.__in") + F.col("b.__base")).alias(out))


def schedule(docs: DataFrame, budget: int | None = None, weights: tuple = WEIGHTS,
             max_repeats: int = MAX_REPEATS) -> tuple[DataFrame, DataFrame]:
    """(copies, rows). ``rows`` has one row per input row: rk (hash of doc_id, source and
    text), doc_id, source, size, source_size, target. ``copies`` has the copies that the
    mix serves: rk, doc_id, place (which of several equal rows), repeat, finish, served,
    offset (words of the mix before this copy).

    Documents of size 0 (null or empty texts) are never served. Equal rows are served
    one after the other. A null source is a source of its own, last in order; an empty
    table gives empty results. Other columns are ignored."""
    rows = stage_table(sizes(docs), "mix-sizes")
    share = stage_table(targets(rows, budget, weights, max_repeats), "mix-targets")
    named = rows.alias("r").join(share.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select(
        "r.*", "t.source_size", "t.target", "t.goal")
    # equal rows (same rk) are one entry with their number, unfolded again below
    entries = named.where("size > 0").groupBy("rk", "doc_id", "source", "size", "source_size", "target", "goal").agg(
        F.count("*").alias("n"))
    entries = entries.withColumn("all", F.col("size") * F.col("n")).withColumn(
        "shuffle", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    order = [F.col("source").asc_nulls_last(), F.col("shuffle"), F.col("rk")]
    queue = running_sum(entries, order, "all", "before", "source")
    start = F.col("before") + F.col("place") * F.col("size") + F.col("repeat") * F.col("source_size")
    served = (queue.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
              .withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
              .withColumn("start", start).where(F.col("start") < F.col("goal"))
              .select("rk", "doc_id", "source", "size", "place", "repeat",
                      F.least(F.lit(1.0), (F.col("start") + F.col("size")) / F.col("target")).alias("finish"),
                      F.least(F.col("size"), F.col("goal") - F.col("start")).alias("served")))
    order = [F.col(c).asc_nulls_last() for c in ("finish", "source", "repeat", "rk", "place")]
    copies = running_sum(served, order, "served", "offset")
    return copies, named


def mix(docs: DataFrame, budget: int | None = None, weights: tuple = WEIGHTS,
        max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words the mix
    takes of it, repeats counted). Equal rows share what is taken of them evenly."""
    copies, rows = schedule(docs, budget, weights, max_repeats)
    taken = copies.groupBy("rk").agg(F.sum("served").alias("t"))
    # equal rows as one entry, unfolded in blocks: no task holds them all
    same = ["rk", "doc_id", "size", "source_size", "target"]
    entries = rows.groupBy(*same).agg(F.count("*").alias("n")).join(taken, "rk", "left").withColumn(
        "t", F.coalesce("t", F.lit(0)))
    blocks = entries.withColumn("b", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / UNFOLD)))).repartition("rk", "b")
    last = F.least(F.col("n"), (F.col("b") + 1) * UNFOLD)
    return blocks.withColumn("k", F.explode(F.sequence(F.col("b") * UNFOLD + 1, last))).select(
        "doc_id", "size", "source_size", "target",
        (F.floor(F.col("t") / F.col("n")) + (F.col("k") <= F.col("t") % F.col("n")).cast("long")).cast("long")
        .alias("taken"))


def mixed_documents(docs: DataFrame, budget: int | None = None, weights: tuple = WEIGHTS,
                    max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix as documents: each copy of which at least half was served, as a row with
    all columns of ``docs``; texts stay whole, so a source ends within half a document
    of its target."""
    copies, _ = schedule(docs, budget, weights, max_repeats)
    n = copies.where(F.col("served") * 2 >= F.col("size")).groupBy("rk").agg(F.count("*").alias("__n"))
    # of equal rows, the first k get one copy more; they are numbered by the parts of the
    # table they lie in, so a row that is a third of it is numbered in many tasks
    keyed = stage_table(docs.withColumn("__rk", row_key("doc_id", "source", "text")).withColumn(
        "__p", F.spark_partition_id()), "mix-rows").join(n.withColumnRenamed("rk", "__rk"), "__rk")
    own = keyed.groupBy("__rk", "__p").agg(F.count("*").alias("__c"))
    of_key = Window.partitionBy("__rk")
    own = own.withColumn("__m", F.sum("__c").over(of_key)).withColumn("__base", F.coalesce(F.sum("__c").over(
        of_key.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    here = F.row_number().over(Window.partitionBy("__rk", "__p").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))
    rows = keyed.withColumn("__k", here).join(own, ["__rk", "__p"]).withColumn("__k", F.col("__k") + F.col("__base"))
    times = F.floor(F.col("__n") / F.col("__m")) + (F.col("__k") <= F.col("__n") % F.col("__m")).cast("long")
    return rows.withColumn("__t", times).where("__t > 0").withColumn(
        "__i", F.explode(F.sequence(F.lit(1), F.col("__t")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents at 100 % of their words."""
    return mix(read_table(spark, sf_dir, "documents"))


# The same in SQL: documents in order of the MD5 of their ids, three rounds of each source.
OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS n,
         CASE (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source),
rates AS (  -- words per weight of the sources below their caps: that of the first such
  SELECT MAX(rate) AS rate FROM (
    SELECT (CAST((SELECT SUM(n) FROM s) AS DOUBLE) - COALESCE(SUM(3 * n) OVER b, 0))
           / ((SELECT SUM(w) FROM s) - COALESCE(SUM(w) OVER b, 0)) AS rate, n, w
    FROM s WINDOW b AS (ORDER BY 3 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) r
  WHERE rate * w < 3 * n),
t AS (
  SELECT source, n, LEAST(CAST(3 * n AS DOUBLE), COALESCE((SELECT rate FROM rates) * w, 3 * n)) AS target FROM s),
g AS (
  SELECT *, CAST(ROUND(SUM(target) OVER (ORDER BY source NULLS LAST)) AS BIGINT) AS upto FROM t),
goals AS (SELECT source, n, target, upto - COALESCE(LAG(upto) OVER (ORDER BY source NULLS LAST), 0) AS goal FROM g),
q AS (
  SELECT doc_id, source, size, CAST(COALESCE(SUM(size) OVER (
    PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b
  FROM d)
SELECT doc_id, size, n AS source_size, target,
       GREATEST(0, LEAST(size, goal - b)) + GREATEST(0, LEAST(size, goal - b - n))
         + GREATEST(0, LEAST(size, goal - b - 2 * n)) AS taken
FROM q JOIN goals ON q.source IS NOT DISTINCT FROM goals.source
"""
