"""A keyed table that a stream maintains: a batch reads and rewrites only its own part.

Rows are dealt to hash buckets by key. A batch reads the buckets of its keys, replaces those
keys' rows and writes these buckets anew under its batch id; a small manifest, put in place
by a rename after the data, names the version of each bucket. So

* what a trigger reads follows the keys of its batch, not the table: a bucket holds about
  ``rows_per_bucket`` rows, since the buckets double (one rewrite of the table, which the
  rows added since have paid for) whenever they hold more on average;
* a retried batch starts from the manifest before it and overwrites what it had written;
* folders don't pile up: versions that neither this batch's manifest nor the one before
  names are deleted, bucket by bucket.

All of it lies in shared storage and is reached through Hadoop's file system.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_BUCKET = 1 << 16
FIRST_BUCKETS = 16


class KeyedState:
    """The rows of ``schema`` (DDL) by ``key``. Several rows may share a key: a write
    replaces all rows of the keys it brings. A null key is a key like any other."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str,
                 rows_per_bucket: int = ROWS_PER_BUCKET, buckets: int = FIRST_BUCKETS):
        self.spark, self.path, self.key = spark, path, key
        self.schema = T.StructType.fromDDL(schema)
        self.rows_per_bucket, self.first_buckets = rows_per_bucket, buckets

    # ------------------------------------------------------------ files
    def _path(self, name: str = ""):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        p, fs = self._path("manifest")
        if not fs.exists(p):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(p)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _load(self, number: int) -> dict:
        p, fs = self._path(f"manifest/{number}.json")
        stream = fs.open(p)
        found = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        return found | {"held": {int(b): v for b, v in found["held"].items()}}

    def started(self) -> bool:
        return bool(self._manifests())

    def manifest(self, before: int | None = None) -> dict:
        """{buckets, held: {bucket: [version, rows]}} as of the last batch (before ``before``)."""
        numbers = [n for n in self._manifests() if before is None or n < before]
        return self._load(numbers[-1]) if numbers else {"buckets": self.first_buckets, "held": {}}

    def _commit(self, number: int, manifest: dict) -> None:
        target, fs = self._path(f"manifest/{number}.json")
        draft, _ = self._path(f"manifest/{number}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        fs.delete(target, False)
        fs.rename(draft, target)

    def _retire(self, number: int) -> None:
        """Delete versions and manifests that only batches before the last one name."""
        numbers = [n for n in self._manifests() if n <= number]
        kept = [self._load(n) for n in numbers[-2:]]
        named = {(v, b) for m in kept for b, (v, _) in m["held"].items()}
        for n in numbers[:-2]:
            for b, (v, _) in self._load(n)["held"].items():
                if (v, b) not in named:
                    p, fs = self._path(f"v={v}/_b={b}")
                    fs.delete(p, True)
            p, fs = self._path(f"manifest/{n}.json")
            fs.delete(p, False)
        live = {v for v, _ in named}
        p, fs = self._path()
        for x in fs.listStatus(p):
            name = x.getPath().getName()
            if name.startswith("v=") and int(name[2:]) < number and int(name[2:]) not in live:
                fs.delete(x.getPath(), True)

    # ------------------------------------------------------------ rows
    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def _rows(self, manifest: dict, buckets) -> DataFrame:
        paths = [f"{self.path}/v={manifest['held'][b][0]}/_b={b}" for b in buckets if b in manifest["held"]]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _touched(self, rows: DataFrame, buckets: int) -> list[int]:
        return [r.b for r in rows.select(self._bucket(buckets).alias("b")).distinct().collect()]

    def rows(self, before: int | None = None) -> DataFrame:
        """The whole table as of the last batch (before ``before``)."""
        m = self.manifest(before)
        return self._rows(m, sorted(m["held"]))

    def read(self, keys: DataFrame, before: int) -> DataFrame:
        """What is held for the keys of a batch: their buckets' rows, as of the batch before."""
        m = self.manifest(before)
        return self._rows(m, self._touched(keys, m["buckets"]))

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Replace the rows of the keys that ``rows`` brings."""
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).persist()
        try:
            self._write(rows, batch_id)
        finally:
            rows.unpersist()

    def _write(self, rows: DataFrame, batch_id: int) -> None:
        m = self.manifest(batch_id)
        n = m["buckets"]
        while sum(r for _, r in m["held"].values()) > n * self.rows_per_bucket:
            n *= 2
        grown = n > m["buckets"]
        touched = self._touched(rows, n)
        if not touched and not grown:
            self._commit(batch_id, {"buckets": n, "held": m["held"]})
            self._retire(batch_id)
            return
        old = [b for b in (sorted(m["held"]) if grown else touched) if b in m["held"]]
        if old:
            same = F.col(f"o.{self.key}").eqNullSafe(F.col(f"k.{self.key}"))
            rows = self._rows(m, old).alias("o").join(
                rows.select(self.key).distinct().alias("k"), same, "left_anti").unionByName(rows)
        target = f"{self.path}/v={batch_id}"
        rows.withColumn("_b", self._bucket(n)).repartition("_b").write.mode("overwrite").partitionBy("_b").parquet(target)
        held = {} if grown else {b: v for b, v in m["held"].items() if b not in touched}
        written = self.spark.read.schema(T.StructType([T.StructField("_b", T.IntegerType())])).parquet(target)
        for r in written.groupBy("_b").count().collect():
            held[r["_b"]] = [batch_id, r["count"]]
        self._commit(batch_id, {"buckets": n, "held": held})
        self._retire(batch_id)
