"""Quality rules with cross-document line frequency.

Per document: word, symbol and repetition measures. Across documents: every line is
normalised (ASCII lower case, words joined by one space) and hashed; a line found in
more than ``max_docs`` documents of one host is boilerplate there and is removed.
Documents are counted by the hash of all their normalised lines in order, so that copies
of one text count once and any other difference between two documents counts. A document
that loses more than ``max_removed`` of its words is rejected as depleted.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.llm.common import map_rows, read_table, row_key, stage_table

SEED = 42  # of XXH64, as Spark's xxhash64() has it
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
MAX_DOCS_PER_HOST = 20
MAX_REMOVED = 0.7

SYMBOLS = b"#*$%&|<>"
_NOT_COUNTED = bytes(range(0x80, 0xC0)) + b" \t\n\x0b\x0c\r"  # UTF-8 continuation bytes and blanks

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def measure(text: bytes) -> dict:
    """The base measures of one text, its lines' hashes and word counts, and the hash of
    all of them in order, equal for copies of one text only."""
    words = text.split()
    grams = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(grams)) < len(grams):
        count = Counter(grams)
        at = np.flatnonzero(np.fromiter((count[g] > 1 for g in grams), bool, len(grams)))
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[at + k] = True
        repeated = int(covered.sum())
    seen: set[bytes] = set()
    dup, norms, sizes = 0, [], []
    for line in text.split(b"\n"):
        own = line.lower().split()
        if own:
            dup += line in seen
            seen.add(line)
            norms.append(b" ".join(own))
            sizes.append(len(own))
    return {"n_words": len(words), "word_chars": len(text.translate(None, _NOT_COUNTED)),
            "n_symbols": len(text) - len(text.translate(None, SYMBOLS)), "n_dup_lines": dup,
            "n_repeat_words": repeated, "line_h": [_hash(n) for n in norms], "line_n": sizes,
            "sig": _hash(b"\n".join(norms))}


def _hash(norm: bytes) -> int:
    h = xxhash.xxh64_intdigest(norm, SEED)
    return h - (1 << 64) if h >> 63 else h


def _row_key() -> Column:
    return row_key("doc_id", "source", "text")


def measures(docs: DataFrame) -> DataFrame:
    """One row per input row: ``rk`` (hash of doc_id, source and text), doc_id, host
    (hash of source; null is a host of its own), the measures and the lines."""
    names = [x.split()[0] for x in MEASURES.split(", ")] + ["line_h", "line_n", "sig"]

    def run(b: pa.RecordBatch) -> dict:
        got = [measure(t or b"") for t in b.column(3).to_pylist()]
        return {n: b.column(i) for i, n in enumerate(("rk", "doc_id", "host"))} | {
            n: [g[n] for g in got] for n in names}

    return map_rows(docs.select(_row_key().alias("rk"), F.col("doc_id").cast("long").alias("doc_id"),
                                F.xxhash64("source").alias("host"), F.col("text").cast("binary").alias("t")),
                    run, f"rk long, doc_id long, host long, {MEASURES}, "
                         "line_h array<long>, line_n array<int>, sig long")


def line_removals(rows: DataFrame, max_docs: int = MAX_DOCS_PER_HOST) -> DataFrame:
    """(rk, removed_words, drops): the words lost to, and the hashes of, lines found in
    more than ``max_docs`` documents of the host. Only rows that lose a line appear.

    (host, line, document) is made distinct before counting, so a line of a third of all
    documents is combined per task and then spread by its documents."""
    lines = rows.dropDuplicates(["rk"]).select(
        "rk", "host", "sig", F.explode(F.arrays_zip("line_h", "line_n")).alias("l")).select(
        "rk", "host", "sig", F.col("l.line_h").alias("h"), F.col("l.line_n").alias("n"))
    common = (lines.select("host", "h", "sig").distinct().groupBy("host", "h").count()
              .where(F.col("count") > max_docs).select("host", "h"))
    return lines.join(common, ["host", "h"]).groupBy("rk").agg(
        F.sum("n").alias("removed_words"), F.collect_set("h").alias("drops"))


def verdicts(docs: DataFrame, max_docs: int = MAX_DOCS_PER_HOST,
             max_removed: float = MAX_REMOVED) -> DataFrame:
    """One row per input row: rk, doc_id, the measures, base_failed, removed_words, drops, kept.

    Null and empty texts have no words and fail the base rules. Repeated rows get equal
    verdicts and count once. Null sources form one host. Other columns are ignored;
    an empty table gives an empty result."""
    rows = stage_table(measures(docs), "quality")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    return (rows.drop("line_h", "line_n", "sig", "host")
            .join(line_removals(rows, max_docs), "rk", "left")
            .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
            .withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed")
                        & (F.col("removed_words") <= max_removed * F.col("n_words"))))


def _normalised(line: Column) -> Column:
    lower = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat_ws(" ", F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def clean(docs: DataFrame, max_docs: int = MAX_DOCS_PER_HOST,
          max_removed: float = MAX_REMOVED) -> DataFrame:
    """The kept documents without their boilerplate lines; other columns unchanged."""
    v = verdicts(docs, max_docs, max_removed).select("rk", "kept", "drops").dropDuplicates(["rk"])
    names = docs.columns
    text = F.when(F.col("v.drops").isNull(), F.col("d.text")).otherwise(F.array_join(F.filter(
        F.split("d.text", "\n", -1),
        lambda line: ~F.array_contains("v.drops", F.xxhash64(_normalised(line)))), "\n"))
    return (docs.withColumn("__rk", _row_key()).alias("d")
            .join(v.alias("v"), F.col("d.__rk") == F.col("v.rk")).where("v.kept")
            .select(*[text.alias("text") if n == "text" else F.col(f"d.`{n}`") for n in names]))


def op10_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict of all documents; a document's host is its source."""
    return verdicts(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.col("removed_words").cast("long").alias("removed_words"))


# The same question in SQL: the lines themselves in place of their hashes.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
OP10_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, '') AS host, coalesce(text, '') AS t,
         {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
grams AS (
  SELECT r, i, list_slice(w, i, i + 2) AS g FROM d, unnest(range(1, greatest(len(w) - 1, 1))) AS u(i)),
twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1),
rep AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2]) AS u(k) GROUP BY r),
raw AS (
  SELECT r, host, doc_id, i, l, {_WORDS.format(_LOWER.format("l"))} AS lw
  FROM (SELECT r, host, doc_id, unnest(string_split(t, chr(10))) AS l,
               generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d)),
line AS (
  SELECT r, host, doc_id, i, l, len(lw) AS n, array_to_string(lw, ' ') AS norm FROM raw WHERE len(lw) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM line GROUP BY r),
sig AS (SELECT r, string_agg(norm, chr(10) ORDER BY i) AS s FROM line GROUP BY r),
common AS (
  SELECT host, norm FROM line JOIN sig USING (r) GROUP BY host, norm
  HAVING count(DISTINCT s) > {MAX_DOCS_PER_HOST}),
gone AS (SELECT r, sum(n) AS n FROM line JOIN common USING (host, norm) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words)
         AND 10 * removed_words <= {round(10 * MAX_REMOVED)} * n_words AS kept, removed_words
FROM m
"""
