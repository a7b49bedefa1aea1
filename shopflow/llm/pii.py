"""Personal data: regular expressions propose spans, checksums confirm them, words
nearby adjust their score. DataFrame expressions only.

A kind's spans come from two columns that Java's matcher makes alike: the matches and
the pieces of text between them; their lengths in code points add up to the positions.
Texts are cut into blocks of ``BLOCK`` code points once, so that a part of a text is found
without counting from its start, and lists grow by runs of ``RUN`` entries (``_fold``): a
text with many spans takes time in proportion to its length.

The patterns match what the plain forms in ``FORMS`` match, leftmost and without
overlap, but are written so that they take linear time and no recursion on very long
runs: a run is entered at its start only (or where the last match ended), runs are
possessive, and a repeated group is avoided by first replacing, character for
character, what would end it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.llm.common import read_table

# Fixed forms of the base kinds, in their listed order.
FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE = tuple(FORMS)
KINDS = (*BASE, "iban", "ssn")

# Characters of an IBAN by country: the registry's, and the countries' that use the form without it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(rf"(?:{'|'.join(c.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())

# kind: (pattern, replacement made before matching or None, text must match this at all)
_RULES = {
    # a dot that no label character follows can't be part of a domain; "_" is, like the
    # dot, part of the local part only
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++",
              (r"\.(?![A-Za-z0-9-])", "_"), r"@[A-Za-z0-9-]"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", None, None),
    # blanks or dashes next to each other end a number
    "card": (r"[0-9][0-9 -]*[0-9]", (r"(?<=[ -])[ -]|[ -](?=[ -])", "x"), r"[0-9](?:[ -]?[0-9]){12}"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", None, r"\+[0-9]"),
    # ends where the country's length says; only the head is consumed (_HEADS), so that one
    # the checksum turns down hides none that starts inside it
    "iban": (rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=({_IBAN})(?![A-Za-z0-9]))[A-Z]{{2}}[0-9]{{2}}", None, None),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", None, None),
}

_HEADS = {"iban": 4}  # kinds whose pattern looks ahead to the match (group 1): what it consumes

# Scores: of a confirmed span, and what a context word within CONTEXT code points adds.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.5, "iban": 0.9, "ssn": 0.4}
CONTEXT = 40
BLOCK = 1024
RUN = 128
CONTEXT_BONUS = 0.3
MIN_SCORE = 0.5  # of kinds beside the base ones
CONTEXT_WORDS = {
    "email": ["mail", "contact", "write to"],
    "ip": ["ip", "address", "host", "server"],
    "card": ["card", "credit", "debit", "visa", "payment"],
    "phone": ["phone", "call", "tel", "mobile", "fax"],
    "iban": ["iban", "bank", "account", "transfer"],
    "ssn": ["ssn", "social security", "taxpayer"],
}
_SPAN = "struct<kind:string,start:int,end:int,match:string,score:double>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def value(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        double = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, double).otherwise(d)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i))
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks leaves 1 when divided by 97."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    def step(a: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (a * 100 + c - 55) % 97).otherwise((a * 10 + c - 48) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _confirmed(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
        return m.rlike(rf"\A{part}\.{part}\.{part}\.{part}\z")
    if kind == "card":
        return F.when(n.between(13, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return mod97(F.replace(m, F.lit(" "), F.lit("")))
    if kind == "ssn":
        return ~m.rlike("^(?:000|666|9)") & ~m.rlike("-00-|-0000$")
    return F.lit(True)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _cut(blocks: Column, start: Column, length: Column) -> Column:
    """A part of the text, from a position counted from 0."""
    first = F.floor(start / BLOCK).cast("int")
    some = F.slice(blocks, first + 1, F.floor((start + length) / BLOCK).cast("int") - first + 1)
    return F.substring(F.array_join(some, ""), start - first * BLOCK + 1, length)


def _fold(items: Column, state: Column, of: str, step) -> Column:
    """The array<``of``> that ``step(state, item)`` -> (new state, entry or null) makes of the
    items, nulls left out. Entries are added to the array of a run of items, and runs to an
    array of runs."""
    none = F.array().cast(f"array<{of}>")

    def add(a: Column, x: Column) -> Column:
        def put(r: Column) -> Column:
            more = F.when(r["entry"].isNull(), a["out"]).otherwise(F.array_append(a["out"], r["entry"]))
            return F.struct(r["state"].alias("state"), more.alias("out"))
        new, entry = step(a["state"], x)
        return _let(F.struct(new.alias("state"), entry.alias("entry")), put)

    def run(every: Column):
        def of_run(a: Column, k: Column) -> Column:
            one = F.aggregate(F.slice(every, k * RUN + 1, RUN), F.struct(a["state"].alias("state"), none.alias("out")), add)
            return _let(one, lambda r: F.struct(r["state"].alias("state"), F.array_append(a["out"], r["out"]).alias("out")))
        return of_run

    zero = F.struct(state.alias("state"), F.array().cast(f"array<array<{of}>>").alias("out"))
    return _let(items, lambda every: F.aggregate(
        F.sequence(F.lit(0), F.floor(F.size(every) / RUN).cast("int")), zero, run(every), lambda a: F.flatten(a["out"])))


def _score(kind: str, blocks: Column, start: Column, end: Column) -> Column:
    first = F.greatest(start - CONTEXT, F.lit(0))
    near = F.lower(_cut(blocks, first, end - first + CONTEXT))
    words = r"(?<![a-z])(?:" + "|".join(CONTEXT_WORDS[kind]) + ")"
    return F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(near.rlike(words), CONTEXT_BONUS).otherwise(0.0))


def kind_spans(kind: str, text: Column, blocks: Column) -> Column:
    """Array of the confirmed spans of one kind, by position."""
    pattern, change, gate = _RULES[kind]
    t = F.regexp_replace(text, *change) if change else text
    pairs = F.arrays_zip(F.split(t, pattern, -1).alias("piece"),
                         F.regexp_extract_all(t, F.lit(pattern), F.lit(1 if kind in _HEADS else 0)).alias("match"))

    def place(a: Column, x: Column):
        start = a["pos"] + F.length(x["piece"])
        end = start + F.length(x["match"])
        found, after = x["match"].isNotNull() & _confirmed(kind, x["match"]), end
        if kind in _HEADS:  # a span starts after the one before
            found &= a["last"] <= start
            after = F.when(x["match"].isNotNull(), start + _HEADS[kind])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"),
                        _cut(blocks, start, F.length(x["match"])).alias("match"), F.lit(0.0).alias("score"))
        return F.struct(F.coalesce(after, start).alias("pos"), F.when(found, end).otherwise(a["last"]).alias("last")), F.when(found, span)

    found = _fold(pairs, F.struct(F.lit(0).alias("pos"), F.lit(0).alias("last")), _SPAN, place)
    return F.when(text.rlike(gate or pattern), found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _scored(kind: str, blocks: Column, spans: Column) -> Column:
    scored = F.transform(spans, lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"),
        _score(kind, blocks, s["start"], s["end"]).alias("score")))
    return scored if kind in BASE else F.filter(scored, lambda s: s["score"] >= MIN_SCORE)


def find(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with ``out``: an array of spans (kind, start, end, match, score) by kind in
    the order of ``KINDS``, then start. Positions count code points, the end is exclusive.

    Null and empty texts have no spans; spans of different kinds may overlap. Every row
    is judged on its own, so repeated rows and further columns stay as they are (a column
    already named ``out`` is replaced)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.withColumn(out, _let(_blocks(text), lambda b: F.concat(
        *[_scored(k, b, kind_spans(k, text, b)) for k in KINDS])))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; where spans overlap, one
    tag of the first replaces what they cover together. Null texts stay null."""
    text = F.col(f"`{text_col}`")
    spans = F.array_sort(F.col("__spans"), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
                         .otherwise(b["end"] - a["end"]))
    # what lies after the last span is written by a last, empty one at the text's end
    ends = F.array_append(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("tag"))),
        F.struct(F.length(text).alias("start"), F.length(text).alias("end"), F.lit("").alias("tag")))

    def step(b: Column):
        return lambda pos, s: (F.greatest(pos, s["end"]), F.when(
            s["start"] >= pos, F.concat(_cut(b, pos, s["start"] - pos), s["tag"])))

    masked = _let(_blocks(text), lambda b: F.array_join(_fold(ends, F.lit(0), "string", step(b)), ""))
    found = find(docs, text_col, "__spans")
    return found.withColumn(text_col, F.when(F.size("__spans") > 0, masked).otherwise(text)).drop("__spans")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: counts and digest of the base kinds, all spans."""
    found = find(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "found")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), F.sha2(_listed(base), 256).alias("base_sha256"),
                        _listed(F.col("found")).alias("spans"))
