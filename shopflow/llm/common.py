"""Helpers shared by the operators: staging tables, Arrow mapping, connected components."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shopflow.session import scratch_path, ship_package


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: later jobs read files that every executor sees, so a lost
    executor costs only its running tasks. The folder lies under
    ``spark.checkpoint.dir`` and may be deleted when the job's result is written."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs whose results are staged: it does so once
    nothing refers to them any more, which a collection on the driver finds out."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[dict] | dict | None],
             schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with a function of one record batch that returns columns
    (a dict of lists or arrays) for ``schema``, an iterable of such dicts, or None."""
    ship_package(df.sparkSession)
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    out = to_arrow_schema(fields)

    def column(values, kind: pa.DataType) -> pa.Array:
        if isinstance(values, pa.Array):
            return values if values.type == kind else values.cast(kind)
        return pa.array(values, type=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = fn(b)
            for cols in [got] if isinstance(got, dict) else got or ():
                yield pa.RecordBatch.from_arrays([column(cols[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, fields)


def row_key(*names: str) -> Column:
    """A 64-bit hash of the columns. Spark's hash passes over nulls, so where they stand is
    hashed too: (1, null, 'a') and (1, 'a', null) differ."""
    return F.xxhash64(*names, *[F.col(n).isNull() for n in names])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: (node, root), root the smallest node id.

    Alternates large-star and small-star steps until the edges are a set of stars.
    Every step is a grouped minimum (combined map-side) and a join, so a hub with a
    third of all edges is never gathered in one task; each round is written to the
    shared folder. Nodes without an edge to another node do not appear."""
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .where("u <> v").distinct())
    e, before = stage_table(e, "edges"), None
    while True:
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v > m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = stage_table(small, "edges")


def stars(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each linked position with the lowest position it reaches (fewer edges than rows)."""
    low = np.arange(n)
    while len(i):
        m = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        np.minimum.at(new, low[i], m)
        np.minimum.at(new, low[j], m)
        new = new[new]
        if (new == low).all():
            break
        low = new
    at = np.flatnonzero(low != np.arange(n))
    return at, low[at]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
