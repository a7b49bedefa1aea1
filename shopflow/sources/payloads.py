"""Order payloads: JSON request bodies -> order header and line frames.

Body shape: ``{customer_name, table_number, items: [{productID, quantity}]}``.
Values are read as text (a JSON number arrives as its text), so the intake job
can apply ``parseInt`` rules itself. Malformed text, ``{}`` and a missing or
empty ``items`` array all give ``has_items = false`` (rejected as an empty cart).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAYLOAD = T.StructType([
    T.StructField("customer_name", T.StringType()),
    T.StructField("table_number", T.StringType()),
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("productID", T.StringType()),
        T.StructField("quantity", T.StringType()),
    ]))),
])


# Number tokens with an exponent, after the keys read as text.
_EXPONENT = r'"(quantity|productID|table_number)"\s*:\s*-?[0-9]+(\.[0-9]+)?[eE][+-]?[0-9]+'
_SOME_EXPONENT = r"[0-9][eE][+-]?[0-9]"  # in each of those, and quickly looked for
_NUMBERS = ("table_number double, items array<struct<productID: double, quantity: double>>")
LINE = T.StructType([T.StructField("order_seq", T.LongType()), T.StructField("EmployeeID", T.LongType()), *PAYLOAD])


def parse_payloads(payloads: DataFrame, body: str = "body", schema: T.StructType = PAYLOAD) -> DataFrame:
    """Add the parsed ``doc`` struct (null fields for malformed text). A number written with
    an exponent becomes its plain digits, as a JSON reader would hand it to ``parseInt``."""
    doc = F.from_json(F.col(body), schema, {"mode": "PERMISSIVE"})
    return payloads.withColumn("doc", doc).withColumn(
        "doc", F.when(F.col(body).rlike(_SOME_EXPONENT) & F.col(body).rlike(_EXPONENT), _plain(F.col("doc"), F.from_json(F.col(body), _NUMBERS)))
        .otherwise(F.col("doc")))


def _plain(doc: Column, numbers: Column) -> Column:
    """``doc`` with the texts of exponent numbers replaced by digits; texts in quotes stay
    (as a number they read null)."""
    def digits(text: Column, number: Column) -> Column:
        return F.when(text.rlike("[eE]") & number.isNotNull(), number.cast("decimal(38,6)").cast("string")).otherwise(text)

    items = F.transform(F.arrays_zip(doc["items"].alias("t"), numbers["items"].alias("n")), lambda z: F.struct(
        digits(z["t"]["productID"], z["n"]["productID"]).alias("productID"),
        digits(z["t"]["quantity"], z["n"]["quantity"]).alias("quantity")))
    return (doc.withField("table_number", digits(doc["table_number"], numbers["table_number"]))
            .withField("items", F.when(doc["items"].isNotNull(), items)))


def read_order_payloads(payloads: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """``payloads`` (order_seq, body, EmployeeID) -> (headers, lines).

    headers: order_seq, customer_name, table_number, EmployeeID, has_items.
    lines: order_seq, line_pos, productID, quantity (text). ``posexplode`` runs
    per row inside the scan stage; no shuffle. A frame that has been parsed already
    (with ``doc``) isn't parsed again.
    """
    p = payloads if "doc" in payloads.columns else parse_payloads(payloads, body)
    headers = p.select(
        "order_seq", F.col("doc.customer_name").alias("customer_name"),
        F.col("doc.table_number").alias("table_number"), "EmployeeID",
        F.coalesce(F.size(F.col("doc.items")) > 0, F.lit(False)).alias("has_items"))
    lines = p.select("order_seq", F.posexplode(F.col("doc.items")).alias("line_pos", "item")).select(
        "order_seq", "line_pos", F.col("item.productID").alias("productID"),
        F.col("item.quantity").alias("quantity"))
    return headers, lines


def parse_lines(lines: DataFrame, body: str = "value") -> DataFrame:
    """One body a line -> (order_seq, EmployeeID, doc). The sequence of a line that is no
    JSON is looked for in its text, so that its reject names the order."""
    seq = F.regexp_extract(F.col(body), r'"order_seq"\s*:\s*"?([0-9]{1,18})', 1)
    p = parse_payloads(lines, body, LINE)
    return p.select(F.coalesce(F.col("doc.order_seq"), F.when(seq != "", seq).cast("long")).alias("order_seq"),
                    F.col("doc.EmployeeID").alias("EmployeeID"), "doc")


def read_payload_files(spark, path: str) -> DataFrame:
    """JSON-lines files of payloads with ``order_seq`` and ``EmployeeID`` fields, parsed
    once, for :func:`read_order_payloads`."""
    return parse_lines(spark.read.text(path))
