"""SimHash near-duplicates found with pivot distance tables.

Every text gets a 64-bit SimHash. Equal fingerprints are one class. Between classes,
each fingerprint gets a table of Hamming distances to many reference fingerprints
(pivots): the zero word, one word per two-bit block, and a set of seeded random words.
Two fingerprints at distance d differ by at most d in every table coordinate.

The block pivots also give the join its keys: distance to a block's word minus
distance to zero depends only on that block, so each differing bit changes one such
coordinate. With at most k differing bits at least one of k + 1 groups of coordinates
is equal throughout, and joining on each group loses no pair. Pairs that meet are
discarded by the largest coordinate difference and the survivors are verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shopflow.llm.common import components, map_rows, read_table, row_key, ship_package, stage_table, stars

SEED = 42
BLOCK_BITS = 2
RUN_CAP = 8192  # rows of one key compared in one task; a hotter key is split into pairs of chunks


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of the ASCII-lower-cased words of ``text`` as an unsigned 64-bit integer.

    Shingles of ``shingle`` space-joined words, repeats included, hashed by XXH64 with
    seed 42; a bit is 1 when set in over half the hashes. Fewer words: one shingle of
    them all; none (or null): 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    h64, join = xxhash.xxh64_intdigest, b" ".join
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 65536):
        part = words[lo:lo + 65536 + shingle - 1]
        rows = zip(*(part[i:] for i in range(shingle))) if len(words) > shingle else [words]
        h = np.fromiter((h64(join(r), SEED) for r in rows), np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(rk, doc_id, fp), one row per input row: ``rk`` is a hash of id and text, ``fp`` the
    fingerprint as a signed long."""

    def run(b: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t, shingle) for t in b.column(2).to_pylist()], np.uint64)
        return {"rk": b.column(0), "doc_id": b.column(1), "fp": pa.array(fps.view(np.int64))}

    return map_rows(docs.select(_row_key(id_col, text_col).alias("rk"), F.col(id_col).cast("long").alias("doc_id"),
                                F.col(text_col).cast("binary").alias("t")),
                    run, "rk long, doc_id long, fp long")


def _row_key(id_col: str, text_col: str) -> Column:
    return row_key(id_col, text_col)


def pivots(n_random: int = 16) -> np.ndarray:
    """Reference fingerprints: zero, one word per block, ``n_random`` seeded random words."""
    blocks = [((1 << BLOCK_BITS) - 1) << i for i in range(0, 64, BLOCK_BITS)]
    rnd = [xxhash.xxh64_intdigest(str(i), SEED) for i in range(n_random)]
    return np.array([0, *blocks, *rnd], np.uint64)


def pivot_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances, one row per fingerprint and one column per reference."""
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def group_keys(table: np.ndarray, groups: int) -> np.ndarray:
    """One key per fingerprint and group of block coordinates, from the pivot table."""
    n = 64 // BLOCK_BITS
    coord = (table[:, 1:n + 1] - table[:, :1] + BLOCK_BITS).astype(np.int64) // 2
    cuts = np.linspace(0, n, groups + 1).astype(int)
    return np.stack([coord[:, a:b] @ ((BLOCK_BITS + 1) ** np.arange(b - a, dtype=np.int64))
                     for a, b in zip(cuts[:-1], cuts[1:])], 1)


def _survivors(fps, i, j, refs, max_bits):
    """The pairs (i, j) that pass the pivot tables and then the exact distance."""
    tab = pivot_table(fps, refs)
    keep = []
    for lo in range(0, len(i), 1 << 18):
        x, y = i[lo:lo + (1 << 18)], j[lo:lo + (1 << 18)]
        for c in range(0, len(refs), 7):  # a few coordinates at a time: most pairs go at once
            ok = np.abs(tab[x, c:c + 7] - tab[y, c:c + 7]).max(1) <= max_bits
            x, y = x[ok], y[ok]
        ok = np.bitwise_count(fps[x] ^ fps[y]) <= max_bits
        keep.append((x[ok], y[ok]))
    return [np.concatenate(k) if k else np.empty(0, np.int64) for k in zip(*keep)] or [np.empty(0, np.int64)] * 2


def _run_links(fps: np.ndarray, run: np.ndarray, chunk: np.ndarray, pair: np.ndarray,
               refs: np.ndarray, max_bits: int):
    """Star edges between the rows of each run (equal ``run``). ``pair`` marks runs in
    which only rows of different ``chunk`` are compared (a split hot key)."""
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    ends = np.r_[starts[1:], len(run)]
    size = np.repeat(ends - starts, ends - starts)
    end = np.repeat(ends, ends - starts)
    at = np.arange(len(run))
    found = []
    for d in range(1, 64):  # short runs: all of them at one offset together
        i = at[(size <= 64) & (at + d < end)]
        if not len(i):
            break
        j = i + d
        ok = ~pair[i] | (chunk[i] != chunk[j])
        found.append(_survivors(fps, i[ok], j[ok], refs, max_bits))
    for s, e in zip(starts, ends):
        if e - s > 64:
            own = []
            for r in range(s, e - 1, 256):
                i, j = np.meshgrid(np.arange(r, min(r + 256, e)), np.arange(r + 1, e), indexing="ij")
                ok = (i < j) & (~pair[i] | (chunk[i] != chunk[j]))
                own.append(_survivors(fps, i[ok], j[ok], refs, max_bits))
            a, b = stars(e - s, *(np.concatenate(x) - s for x in zip(*own)))
            found.append((a + s, b + s))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def link_fingerprints(classes: DataFrame, max_bits: int = 2, n_random: int = 16,
                      run_cap: int = RUN_CAP) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints (column ``fp``) within
    ``max_bits``: every linked pair is connected through them; a run of many close
    fingerprints gives a star, not all its pairs."""
    spark = classes.sparkSession
    ship_package(spark)
    refs, groups = pivots(n_random), max_bits + 1

    def keyed(b: pa.RecordBatch) -> dict:
        fps = b.column(0).to_numpy(zero_copy_only=False)
        keys = group_keys(pivot_table(fps.view(np.uint64), refs), groups)
        return {"g": np.tile(np.arange(groups, dtype=np.int32), len(fps)),
                "key": keys.reshape(-1), "fp": np.repeat(fps, groups)}

    keys = stage_table(map_rows(classes.select("fp"), keyed, "g int, key long, fp long"), "pivot-keys")
    sizes = (keys.groupBy("g", "key").count().where("count > 1")
             .withColumn("s", F.ceil(F.col("count") / run_cap).cast("int")).drop("count"))
    rows = (keys.join(sizes, ["g", "key"])
            .withColumn("c", F.expr("cast(pmod(xxhash64(fp), s) as int)"))
            .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
            .select("g", "key", "fp", "c", F.least("c", "o").alias("p"), F.greatest("c", "o").alias("q")))
    rows = rows.repartition("g", "key", "p", "q").sortWithinPartitions("g", "key", "p", "q", "fp")

    def links(batches):
        def flush(t):
            k = [t[n].to_numpy() for n in ("g", "key", "p", "q")]
            new = np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in k])]
            fps = t["fp"].to_numpy()
            i, j = _run_links(fps.view(np.uint64), np.cumsum(new), t["c"].to_numpy(), k[2] != k[3], refs, max_bits)
            for lo in range(0, len(i), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(fps[x[lo:lo + 100_000]]) for x in (i, j)], ["a", "b"])

        held = None  # rows since the last complete run
        for b in batches:
            t = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b]).combine_chunks()
            k = [t[n].to_numpy() for n in ("g", "key", "p", "q")]
            new = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in k])) + 1
            if not len(new):
                held = t
                continue
            yield from flush(t.slice(0, new[-1]).combine_chunks())
            held = t.slice(new[-1])
        if held is not None and held.num_rows:
            yield from flush(held.combine_chunks())

    return rows.mapInArrow(links, "a long, b long")


def _groups(docs: DataFrame, shingle: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their fingerprints, and (fp, root) with a root for each component."""
    rows = stage_table(fingerprints(docs, shingle), "simhash")
    classes = rows.select("fp").distinct()
    roots = components(link_fingerprints(classes, max_bits)).withColumnRenamed("node", "fp")
    return rows, classes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every input row.

    Null or empty texts, and texts without a word, have fingerprint 0 and link like any
    other. Repeated rows stay repeated and share a component. A row with a null doc_id
    links like any other but gives no component id; a component of such rows alone has
    a null id. Other columns are ignored; an empty table gives an empty result."""
    rows, roots = _groups(docs, shingle, max_bits)
    ids = rows.groupBy("fp").agg(F.min("doc_id").alias("low")).join(roots, "fp").groupBy("root").agg(
        F.min("low").alias("component_id"))
    return rows.join(roots.join(ids, "root").drop("root"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The document with the smallest doc_id of each group, in all columns unchanged. A null
    doc_id comes after all others; of rows with one doc_id, one row stays: of different texts,
    that with the smallest row key, of one text, that with the smallest hash of all columns."""
    rows, roots = _groups(docs, shingle, max_bits)
    last = F.lit((1 << 63) - 1)
    best = F.min(F.struct(F.coalesce("doc_id", last).alias("id"), "rk"))
    first = rows.groupBy("fp").agg(best.alias("b")).join(roots, "fp").groupBy("root").agg(
        F.min("b").alias("b")).select(F.col("b.id").alias("__id"), F.col("b.rk").alias("__rk"))
    one = Window.partitionBy("__id", "__rk").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    keyed = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), last), "__rk": _row_key("doc_id", "text")})
    return keyed.join(first, ["__id", "__rk"], "left_semi").withColumn("__k", F.row_number().over(one)).where(
        "__k = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents: 3-word shingles, at most 2 differing bits."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), 3, 2).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
