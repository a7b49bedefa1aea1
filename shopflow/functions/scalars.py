"""Scalar column functions (built-in Spark expressions only; all JVM-side).

Each returns a ``Column`` so it composes inside ``select``/``filter`` and stays
inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- dates
def to_day(ts) -> Column:
    """MySQL ``DATE(ts)``."""
    return F.to_date(_c(ts))


def days_back(as_of, n: int) -> Column:
    """``DATE_SUB(as_of, INTERVAL n DAY)``."""
    return F.date_sub(F.to_date(F.lit(str(as_of))), int(n))


def month_label(ts) -> Column:
    """``DATE_FORMAT(ts, '%Y-%m')``."""
    return F.date_format(_c(ts), "yyyy-MM")


def iso_week_label(ts) -> Column:
    """ISO year + ISO week: ``YYYY-Www``."""
    c = _c(ts)
    return F.concat(F.extract(F.lit("YEAROFWEEK"), c).cast("string"), F.lit("-W"),
                    F.lpad(F.weekofyear(c).cast("string"), 2, "0"))


def seconds_between(ts, as_of_ts) -> Column:
    """Whole seconds from ``ts`` to ``as_of_ts`` (floor, like ``Math.floor(ms/1000)``)."""
    return F.floor(F.unix_timestamp(_c(as_of_ts).cast("timestamp"))
                   - F.unix_timestamp(_c(ts).cast("timestamp"))).cast("long")


def elapsed_wait(ts, as_of_ts) -> Column:
    """Kitchen waiting time: ``Ns`` under a minute, ``Nm Ns`` under an hour, else ``Nh Nm``."""
    s = seconds_between(ts, as_of_ts)
    return (F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
            .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m "),
                                     (s % 60).cast("string"), F.lit("s")))
            .otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h "),
                                F.floor((s % 3600) / 60).cast("string"), F.lit("m"))))


def relative_age(ts, as_of_ts) -> Column:
    """Dashboard age: ``Ns ago`` / ``Nm ago`` / ``Nh ago`` within a day, else the
    ISO date."""
    s = seconds_between(ts, as_of_ts)
    return (F.when(s < 60, F.concat(s.cast("string"), F.lit("s ago")))
            .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m ago")))
            .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h ago")))
            .otherwise(F.date_format(_c(ts), "yyyy-MM-dd")))


# ---------------------------------------------------------------- strings
# Fixed: the characters of JavaScript's ``\\s`` and ``trim`` (Java's ``\\s`` is ASCII
# only), as the inside of a character class.
JS_SPACE = (r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF")


def js_trim(c) -> Column:
    """JavaScript ``String.trim``: strips all leading/trailing whitespace (Spark's
    ``trim`` strips spaces only)."""
    return F.regexp_replace(_c(c), rf"\A[{JS_SPACE}]+|[{JS_SPACE}]+\z", "")


def strip_markup_chars(c) -> Column:
    """Remove ``< > " '`` characters."""
    return F.regexp_replace(_c(c), "[<>\"']", "")


def contains_ci(c, text: str) -> Column:
    """``lower(c).includes(lower(text))``: literal, no wildcards."""
    return F.lower(_c(c)).contains(text.lower())


def product_image_path(image) -> Column:
    """Absolute, ``http`` or ``../`` paths are kept, others get ``../`` in front;
    null or empty image gives null."""
    c = _c(image)
    keep = c.startswith("http") | c.startswith("/") | c.startswith("../")
    return (F.when(c.isNull() | (c == ""), F.lit(None).cast("string"))
            .when(keep, c).otherwise(F.concat(F.lit("../"), c)))


# ---------------------------------------------------------------- numbers
def js_int(c) -> Column:
    """JavaScript ``parseInt`` (no radix): leading optional sign and digits after
    leading whitespace ("3abc" -> 3, "3.7" -> 3, " -2" -> -2, "0x1A" -> 26);
    null when there are none (NaN). Clean integer text takes the plain cast;
    only other text goes through the regular expressions."""
    s = _c(c).cast("string")
    hexm = F.regexp_extract(s, rf"\A[{JS_SPACE}]*([+-]?)0[xX]([0-9a-fA-F]+)", 2)
    hexv = F.conv(hexm, 16, 10).try_cast("long") * F.when(
        F.regexp_extract(s, rf"\A[{JS_SPACE}]*([+-]?)0[xX]", 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    m = F.regexp_extract(s, rf"\A[{JS_SPACE}]*([+-]?\d+)", 1)
    slow = (F.when(hexm != "", hexv)
            .when(m == "", F.lit(None).cast("long")).otherwise(m.try_cast("long")))
    # A plain cast accepts only whole integer text (whitespace trimmed), where it
    # agrees with parseInt; everything else is null there and takes ``slow``.
    return F.coalesce(s.try_cast("long"), slow)


def js_float(c, dtype: str = "decimal(22,6)") -> Column:
    """JavaScript ``parseFloat`` on money text: the leading decimal number
    (optional exponent) after whitespace, else null; read as an exact decimal."""
    s = _c(c).cast("string")
    m = F.regexp_extract(s, rf"\A[{JS_SPACE}]*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", 1)
    return F.when(m == "", F.lit(None).cast(dtype)).otherwise(m.try_cast(dtype))


def at_least_one(n) -> Column:
    """``Math.max(1, n)``; NaN (null) stays null."""
    c = _c(n)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.greatest(F.lit(1), c))


def money_text(c, currency: str = "") -> Column:
    """``toFixed(2)`` with thousands separators and optional currency sign."""
    return F.concat(F.lit(currency), F.format_number(_c(c).cast("decimal(38,2)"), 2))


# ---------------------------------------------------------------- conditionals
def default_if_falsy(c, default) -> Column:
    """JavaScript ``x || default`` by the column's type: null, the empty string, a number
    0 or NaN and false take the default; text such as "0" is kept."""
    col = _c(c)
    text = col.cast("string")
    not_text = F.typeof(col) != "string"
    zero = (text.try_cast("double") == 0) | text.isin("NaN", "false")
    falsy = col.isNull() | (text == "") | (not_text & F.coalesce(zero, F.lit(False)))
    return F.when(falsy, F.lit(default)).otherwise(col)


def default_if_null(c, default) -> Column:
    """JavaScript ``x ?? default`` / SQL ``COALESCE``."""
    return F.coalesce(_c(c), F.lit(default))


# ---------------------------------------------------------------- inventory / misc
def stock_level(q) -> Column:
    """Out (<= 0) / Low (1..10) / Good (> 10)."""
    c = _c(q)
    return F.when(c <= 0, "Out").when(c <= 10, "Low").otherwise("Good")


def stock_bar_pct(q) -> Column:
    """Bar width %: Out 100, Low min(q*10,100), Good min(q*2,100)."""
    c = _c(q)
    return (F.when(c <= 0, F.lit(100)).when(c <= 10, F.least(c * 10, F.lit(100)))
            .otherwise(F.least(c * 2, F.lit(100))))


def hash_secret(c) -> Column:
    """SHA-256 hex of a secret."""
    return F.sha2(_c(c).cast("string"), 256)
