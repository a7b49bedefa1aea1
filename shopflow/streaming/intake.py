"""Order intake as a stream: payload files arrive, stock is kept across micro-batches.

Stock is a keyed state with one row a product that has been asked for; a batch reads and
rewrites only the buckets of its products, and reads ``products`` for those it has not met.
Within a batch the set-based intake decides (a hot product is dealt over sequence buckets),
so any cut of the files into batches, in the order of their sequence, gives the result of
one batch over all of them. Outputs lie under their batch id and a retried batch starts from
the stock before it, so nothing is taken twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.functions.scalars import js_int
from shopflow.operators import changes
from shopflow.session import scratch_path
from shopflow.sources import payloads
from shopflow.streaming.live import _run
from shopflow.streaming.state import KeyedState

STOCK = "productID long, quantity long, is_available int, price decimal(10,2)"
OUTPUTS = ("orders", "items", "rejects")


def payload_stream(spark: SparkSession, directory: str, glob: str = "*.json", max_files: int | None = None) -> DataFrame:
    """Files of one JSON body a line, in the order of their times."""
    r = spark.readStream.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.text(directory)


def stock_state(spark: SparkSession, base: str) -> KeyedState:
    return KeyedState(spark, f"{base}/stock", "productID", STOCK)


def run_live_intake(spark: SparkSession, lines: DataFrame, products: DataFrame, name: str,
                    trigger: dict | None = None) -> str:
    """Serve the orders of a payload stream; returns the folder of ``orders``, ``items`` and
    ``rejects`` (by batch) and of the stock. Orders of a later batch come after those of an
    earlier one, whatever their sequence. A body without a sequence is rejected under null."""
    base = scratch_path(spark, name)
    shelf = products.select("productID", F.col("quantity").cast("long").alias("quantity"), "is_available",
                            F.col("price").cast("decimal(10,2)").alias("price"))

    def step(batch: DataFrame, batch_id: int) -> None:
        # Everything below reads the parsed bodies, so each is parsed once, not its text kept.
        docs = payloads.parse_lines(batch).persist()
        kept = [docs]
        try:
            serve(docs, batch_id, kept)
        finally:
            for frame in reversed(kept):
                frame.unpersist()

    def serve(docs: DataFrame, batch_id: int, kept: list[DataFrame]) -> None:
        stock = stock_state(docs.sparkSession, base)
        headers, asked = payloads.read_order_payloads(docs)
        wanted = (asked.select(js_int(F.col("productID")).alias("productID")).filter("productID IS NOT NULL")
                  .distinct().persist())
        kept.append(wanted)
        held = stock.read(wanted, batch_id).join(wanted, "productID", "left_semi")
        new = shelf.join(wanted, "productID", "left_semi").join(held.select("productID"), "productID", "left_anti")
        out = changes.orders_intake(headers, asked, held.unionByName(new))
        kept.append(out["by_order"].persist())  # read by the orders and by three kinds of rejects
        for kind in OUTPUTS:
            out[kind].write.mode("overwrite").parquet(f"{base}/{kind}/batch_id={batch_id}")
        stock.write(out["stock"], batch_id)

    _run(lines, step, name, spark, trigger, mode="append", keep=False)
    return base


def taken(spark: SparkSession, base: str, kind: str) -> DataFrame:
    """What the stream wrote of a kind (``OUTPUTS``), with its batch."""
    return spark.read.parquet(f"{base}/{kind}")


def stock_now(spark: SparkSession, base: str, products: DataFrame) -> DataFrame:
    """Products with the stock that the stream left."""
    left = stock_state(spark, base).rows().select("productID", F.col("quantity").alias("_left"))
    return (products.join(left, "productID", "left")
            .withColumn("quantity", F.coalesce(F.col("_left"), F.col("quantity")).cast("long")).drop("_left"))
