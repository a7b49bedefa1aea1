"""Suffix-array deduplication of text that repeats across documents.

Every byte covered by a string of ``min_len`` bytes that also starts in a document with a
smaller id is removed; the first document keeps it.

The suffixes are dealt to buckets in one shuffle: a suffix goes to the bucket of the least
hash among the byte grams of its first ``min_len`` bytes, so equal strings meet in one
bucket, and the suffixes of a run of positions with the same least gram travel as one
block of text. Grams that are the least of very many blocks are counted beforehand; their
suffixes travel one by one and are dealt by a hash of all ``min_len`` bytes, which equal
strings share too, so no gram makes a large bucket. Blocks that are equal byte for byte are combined first, per task and then
per bucket: all but the smallest document's are later copies. In a bucket, the suffixes
left are sorted; the previous and next entries with a smaller document in suffix order,
with the common prefixes on the way, give each suffix its longest previous factor, and
where that reaches ``min_len`` the suffix's bytes are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.llm.common import drop_shuffles, read_table, stage_table
from shopflow.session import ship_package

MIN_LEN = 50
GRAM = 12  # bytes of a gram
CHUNK_BYTES = 8 << 20  # text whose blocks a task holds before it sends them
PIECE_BYTES = 1 << 18  # text hashed at a time
PART_BYTES = 32 << 20  # of blocks that a task of the second stage reads, about
BUCKET_BYTES = 4 << 20  # text of a bucket's suffixes, about
HOT_BLOCKS = 1 << 15  # blocks of a gram from which its suffixes are dealt one by one
COUNTERS = 1 << 20  # grams that a task counts at a time
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the ``GRAM`` bytes at each position of ``data`` (uint8)."""
    n = len(data) - GRAM + 1
    words = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,))
    h = words[:n] * _M1
    h ^= h >> np.uint64(29)
    h += words[GRAM - 8:GRAM - 8 + n]
    h *= _M2
    h ^= h >> np.uint64(32)
    h *= _M1
    return h


def window_min(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    got, m = 1, h
    while got < width:
        step = min(got, width - got)
        m = np.minimum(m[:len(m) - step], m[step:])
        got += step
    return m


def blocks(data: bytes, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least gram, start, end) of the runs of suffixes of ``data`` with the same least gram:
    a run's suffixes start at [start, end), its text is data[start : end + min_len - 1]."""
    return _runs(gram_hashes(np.frombuffer(data, np.uint8)), min_len)


def _runs(h: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = window_min(h, min_len - GRAM + 1)
    start = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
    return m[start], start, np.r_[start[1:], len(m)]


def block_keys(gram: np.ndarray, first: np.ndarray, last: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A key that equal blocks share, from their least, first and last gram's hash and size."""
    return (gram ^ (first * _M1)) * _M2 + last + size.astype(np.uint64)


def later_copies(key: np.ndarray, doc: np.ndarray, equal) -> np.ndarray:
    """The places whose key an earlier place of a smaller document has, with the same bytes
    (``equal(i, j)``). Places are in order of documents; only those whose keys meet are compared."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    if not len(k):
        return order
    new = np.r_[True, k[1:] != k[:-1]]
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    at = np.flatnonzero(~new & (doc[first] < doc[order]))
    return np.array([i for i, j in zip(order[at].tolist(), first[at].tolist()) if equal(i, j)], np.int64)


def whole_hashes(h: np.ndarray, at: np.ndarray, min_len: int) -> np.ndarray:
    """A hash of the ``min_len`` bytes at each of ``at``, from the gram hashes ``h`` of the text."""
    key = h[at].copy()
    for k in (*range(GRAM, min_len - GRAM, GRAM), min_len - GRAM):
        key = (key ^ (key >> np.uint64(31))) * _M2 + h[at + k]
    return key


def _pieces(doc: int, tag: int, text: bytes, min_len: int) -> Iterator[tuple[int, int, int, bytes]]:
    for at in range(0, len(text) - min_len + 1, PIECE_BYTES):
        yield doc, tag, at, text[at:at + PIECE_BYTES + min_len - 1]


def pack(doc, tag, start, size, texts) -> bytes:
    """Blocks as one compressed binary: their document, tag, start, size and text."""
    doc, tag = np.array(doc, np.int64), np.array(tag, np.int64)
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
    start, size = np.array(start, np.int64), np.array(size, np.int32)
    head = np.array([len(doc), len(first)], np.int64).tobytes()
    count = np.diff(np.r_[first, len(doc)]).astype(np.int32)
    flat = b"".join([head, np.diff(doc[first], prepend=0).tobytes(), tag[first].tobytes(), count.tobytes(),
                     np.ascontiguousarray(start.astype(np.int64)).tobytes(), size.tobytes(), *texts])
    return zstandard.ZstdCompressor(level=5).compress(flat)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    flat = zstandard.ZstdDecompressor().decompress(blob)
    n, k = np.frombuffer(flat, np.int64, 2)
    at, out = 16, []
    for kind, m in ((np.int64, k), (np.int64, k), (np.int32, k), (np.int64, n), (np.int32, n)):
        out.append(np.frombuffer(flat, kind, m, at))
        at += m * np.dtype(kind).itemsize
    doc, tag, count, start, size = out
    return np.repeat(np.cumsum(doc), count), np.repeat(tag, count), start, size, flat[at:]


# ---- suffix order in a bucket

def previous_smaller(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each i, the nearest j < i, not before first[i], with value[j] < value[i]; else -1.
    All places jump along the answers of others until none moves."""
    prev = np.arange(len(value)) - 1
    todo = np.arange(len(value))
    while len(todo):
        out = prev[todo] < first[todo]
        prev[todo[out]] = -1
        todo = todo[~out]
        todo = todo[value[prev[todo]] >= value[todo]]
        hop = prev[prev[todo]]
        prev[todo] = hop
    return prev


def longest_previous_factors(suffix: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Longest previous factor of each suffix, at most the rows' width in bytes: the longest
    common prefix with a suffix of a document with a smaller id. ``suffix`` holds the first
    bytes of each as big-endian words, one column a word."""
    order = np.lexsort((doc, *suffix.T[::-1]))
    s, d = suffix[order], doc[order]
    n, width = s.shape
    differ = s[1:] ^ s[:-1]
    column = np.argmax(differ != 0, 1)
    word = differ[np.arange(n - 1), column]
    zeros = np.zeros(n - 1, np.int64)  # leading equal bytes of the first differing word
    for k in range(1, 8):
        zeros += word < (np.uint64(1) << np.uint64(64 - 8 * k))
    lcp = np.where(word == 0, width * 8, column * 8 + zeros)
    lpf = np.zeros(n, np.int64)
    for back in (False, True):
        v, c = (d[::-1], lcp[::-1]) if back else (d, lcp)
        found = previous_smaller(v, np.zeros(n, np.int64))
        has = np.flatnonzero(found >= 0)
        best = np.zeros(n, np.int64)
        if len(has):
            best[has] = _range_min(c, found[has], has)
        lpf = np.maximum(lpf, best[::-1] if back else best)
    out = np.empty(n, np.int64)
    out[order] = lpf
    return out


def _range_min(c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(c[lo:hi]) of each pair lo < hi, from minima over powers of two."""
    span = hi - lo
    out = np.empty(len(lo), c.dtype)
    table, width = c, 1
    while True:
        now = (span >= width) & (span < 2 * width)
        out[now] = np.minimum(table[lo[now]], table[hi[now] - width])
        if (span < 2 * width).all():
            return out
        table = np.minimum(table[:len(table) - width], table[width:])
        width *= 2


def _suffix_words(data: np.ndarray, at: np.ndarray, min_len: int) -> np.ndarray:
    """The first ``min_len`` bytes of the suffixes at ``at`` as big-endian words."""
    words = np.ndarray((len(data) - 7,), ">u8", data.tobytes(), strides=(1,))
    cols = [words[at + k].astype(np.uint64) for k in range(0, min_len - 7, 8)]
    if rest := min_len % 8:
        cols.append(words[at + min_len - 8].astype(np.uint64) << np.uint64(64 - 8 * rest))
    return np.stack(cols, 1)


def bucket_removals(doc, tag, start, size, text: bytes, min_len: int):
    """(doc, tag, start, end) of the byte ranges to remove, found among a bucket's blocks."""
    ends = np.cumsum(size, dtype=np.int64)
    starts = ends - size
    order = np.argsort(doc, kind="stable")
    data = np.frombuffer(text + b"\0" * 64, np.uint8)
    h = gram_hashes(data)
    inside = np.arange(len(h)) < ends[-1]
    inside[(ends[:, None] - np.arange(1, GRAM)).ravel()] = False
    low = np.minimum.reduceat(np.where(inside, h, _TOP), starts)
    s_at, e_at = starts[order].tolist(), ends[order].tolist()
    key = block_keys(low, h[starts], h[ends - GRAM], size)[order]
    later = order[later_copies(key, doc[order], lambda i, j: text[s_at[i]:e_at[i]] == text[s_at[j]:e_at[j]])]
    out = []
    if len(later):  # copies of a block of a smaller document
        out.append((doc[later], tag[later], start[later], start[later] + size[later]))
    left = np.setdiff1d(np.arange(len(doc)), later)
    if len(left):  # suffixes of blocks whose least gram is in several documents
        left = left[_in_several(low[left], doc[left])]
    if len(left):
        n = size[left] - min_len + 1
        own = np.repeat(left, n)
        at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + starts[own]
        # then those whose whole first min_len bytes are (by a hash; the order below decides)
        many = _in_several(whole_hashes(h, at, min_len), doc[own])
        own, at = own[many], at[many]
        if len(own):
            lpf = longest_previous_factors(_suffix_words(data, at, min_len), doc[own])
            hit = lpf >= min_len
            own, at = own[hit], at[hit]
            if len(own):
                new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)])
                last = np.r_[new[1:], len(own)] - 1
                b = own[new]
                lo, hi = start[b] + at[new] - starts[b], start[b] + at[last] - starts[b] + min_len
                out.append((doc[b], tag[b], lo, hi))
    if not out:
        return [np.empty(0, np.int64)] * 4
    return _merge(*(np.concatenate(x) for x in zip(*out)))


def _in_several(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which rows have a key that rows of another document have too."""
    order = np.argsort(key, kind="stable")
    k, d = key[order], doc[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    both = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
    out = np.empty(len(key), bool)
    out[order] = np.repeat(both, np.diff(np.r_[first, len(k)]))
    return out


def _merge(doc, tag, lo, hi):
    """Ranges of a document that overlap or touch, as one."""
    if not len(doc):
        return doc, tag, lo, hi
    order = np.lexsort((lo, tag, doc))
    doc, tag, lo, hi = doc[order], tag[order], lo[order], hi[order]
    new_doc = np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]
    # running maximum of the ends within a document: shift each document beyond the one before
    group = np.cumsum(new_doc) - 1
    shift = group * (int(hi.max()) + 2)
    reach = np.maximum.accumulate(hi + shift)
    new = np.r_[True, lo[1:] + shift[1:] > reach[:-1]]
    first = np.flatnonzero(new)
    return doc[first], tag[first], lo[first], (reach - shift)[np.r_[first[1:], len(doc)] - 1]


# ---- jobs

def hot_grams(docs: DataFrame, min_len: int) -> tuple[np.ndarray, int]:
    """The grams (in order) that are the least of more than ``HOT_BLOCKS`` blocks, and the number
    of suffixes of those blocks. Equal blocks of a task's chunk count once, and a gram with one
    block in a task isn't counted there: a passage is no reason to split its gram. A task keeps
    ``COUNTERS`` grams; when it meets more, all counts fall by that of the first one too many,
    so a gram loses at most a task's blocks / ``COUNTERS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, taken = [], 0
        grams, counts, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def count():
            nonlocal grams, counts, sums
            gram, size, key = (np.concatenate(c) for c in zip(*held))
            one = np.unique(key, return_index=True)[1]
            grams, at = np.unique(np.concatenate([grams, gram[one]]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, np.ones(len(one))])).astype(np.int64)
            sums = np.bincount(at, np.concatenate([sums, size[one]])).astype(np.int64)
            if len(grams) > COUNTERS:
                least = np.partition(counts, len(counts) - COUNTERS - 1)[len(counts) - COUNTERS - 1]
                kept = counts > least
                sums = (sums * (1 - least / counts)).astype(np.int64)[kept]
                grams, counts = grams[kept], counts[kept] - least

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for _, _, _, piece in _pieces(0, 0, text, min_len):
                    h = gram_hashes(np.frombuffer(piece, np.uint8))
                    g, a, b = _runs(h, min_len)
                    held.append((g, b - a, block_keys(g, h[a], h[b - 1 + min_len - GRAM], b - a)))
                    taken += len(piece)
                    if taken >= CHUNK_BYTES:
                        count()
                        held, taken = [], 0
        if held:
            count()
        many = np.flatnonzero(counts > 1)
        for at in range(0, len(many), 1 << 16):
            c = many[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(x[c]) for x in (grams.view(np.int64), counts, sums)],
                                             ["gram", "n", "suffixes"])

    rows = docs.select("text").mapInArrow(run, "gram long, n long, suffixes long").groupBy("gram").agg(
        F.sum("n").alias("n"), F.sum("suffixes").alias("suffixes")).where(F.col("n") > HOT_BLOCKS).collect()
    return np.sort(np.array([r.gram for r in rows], np.int64).view(np.uint64)), sum(r.suffixes for r in rows)


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _send(docs: DataFrame, n_buckets: int, min_len: int, hot: np.ndarray) -> DataFrame:
    """(kind, bucket, blob): blocks for a bucket (kind 0), and removals that a task has found
    among its own documents (kind 1: blocks without text). Blocks of the grams ``hot`` are
    sent as one block a suffix, dealt by the hash of its ``min_len`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def row(kind, bucket, blob):
            return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([bucket], pa.int64()),
                                               pa.array([blob], pa.binary())], ["kind", "bucket", "blob"])

        def flush():
            held.sort(key=lambda x: x[:2])
            found, singles, raw, taken = [], [], [], 0
            for doc, tag, text in held:
                for d, t, off, piece in _pieces(doc, tag, text, min_len):
                    h = gram_hashes(np.frombuffer(piece, np.uint8))
                    g, a, b = _runs(h, min_len)
                    e, p = b + min_len - 1, len(raw)
                    split = _among(g, hot)
                    whole = np.stack([np.full(len(g), v) for v in (p, d, t, off)])
                    found.append((g, block_keys(g, h[a], h[e - GRAM], b - a), *whole, a, e, split))
                    n = (b - a)[split]
                    x = np.repeat(a[split], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    singles.append((whole_hashes(h, x, min_len), *(np.full(len(x), v) for v in (p, d, t, off)), x,
                                    np.repeat(np.flatnonzero(split), n)))
                    raw.append(piece)
                    taken += len(piece) + len(x) * min_len
                    if taken >= CHUNK_BYTES:
                        yield from send(found, singles, raw)
                        found, singles, raw, taken = [], [], [], 0
            if raw:
                yield from send(found, singles, raw)

        def send(found, singles, raw):
            def same_bytes(*spots):
                p, u, v = (c.tolist() for c in spots)
                return lambda i, j: raw[p[i]][u[i]:v[i]] == raw[p[j]][u[j]:v[j]]

            base = np.cumsum([0, *(len(f[0]) for f in found[:-1])])
            block = np.concatenate([s[-1] + b for s, b in zip(singles, base)])
            singles = [s[:-1] for s in singles]
            gram, key, piece, doc, tag, off, a, e, split = (np.concatenate(c) for c in zip(*found))
            gone = np.zeros(len(gram), bool)
            gone[later_copies(key, doc, same_bytes(piece, a, e))] = True
            out = [(doc[gone], tag[gone], (off + a)[gone], (off + e)[gone])]
            keep = ~gone & ~split
            s_key, s_piece, s_doc, s_tag, s_off, x = (np.concatenate(c)[~gone[block]] for c in zip(*singles))
            y = x + min_len
            again = np.zeros(len(x), bool)
            again[later_copies(s_key, s_doc, same_bytes(s_piece, x, y))] = True
            out.append((s_doc[again], s_tag[again], (s_off + x)[again], (s_off + y)[again]))
            d, t, lo, hi = _merge(*(np.concatenate(c) for c in zip(*out)))
            for at in range(0, len(d), 1 << 16):
                s = slice(at, at + (1 << 16))
                yield row(1, -1, pack(d[s], t[s], lo[s], (hi - lo)[s], []))
            new = ~again
            key, piece, doc, tag, off, a, e = (np.concatenate([u[keep], v[new]]) for u, v in (
                (gram, s_key), (piece, s_piece), (doc, s_doc), (tag, s_tag), (off, s_off), (a, x), (e, y)))
            bucket = (key % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(bucket.astype(np.uint16) if n_buckets < 1 << 16 else bucket, kind="stable")
            bucket, piece, doc, tag, off, a, e = (c[order] for c in (bucket, piece, doc, tag, off, a, e))
            start, size = off + a, e - a
            cut = np.flatnonzero(np.r_[True, np.diff(bucket) != 0, True]) if len(order) else []
            for i, j in zip(cut[:-1], cut[1:]):
                o = slice(i, j)
                texts = [raw[p][u:v] for p, u, v in zip(piece[o].tolist(), a[o].tolist(), e[o].tolist())]
                yield row(0, int(bucket[i]), pack(doc[o], tag[o], start[o], size[o], texts))

        for batch in batches:
            for doc, tag, text in zip(*(c.to_pylist() for c in batch.columns)):
                held.append((doc, tag, text))
                n += len(text)
                if n >= CHUNK_BYTES:
                    yield from flush()
                    held, n = [], 0
        yield from flush()

    return docs.mapInArrow(run, "kind int, bucket long, blob binary")


def _removals(sent: DataFrame, n_parts: int, min_len: int) -> DataFrame:
    """(doc_id, tag, lo, hi): byte ranges to remove, from a task's own and the buckets'."""

    def rows(doc, tag, lo, hi):
        for s in range(0, len(doc), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c[s:s + 100_000], np.int64)) for c in (doc, tag, lo, hi)],
                                             ["doc_id", "tag", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush():
            got = [unpack(b) for b in held]
            cols = [np.concatenate([x[k] for x in got]) for k in range(4)]
            yield from rows(*bucket_removals(*cols, b"".join(x[4] for x in got), min_len))

        for batch in batches:
            for i in range(batch.num_rows):
                kind, bucket, blob = (batch.column(c)[i].as_py() for c in range(3))
                if kind:
                    doc, tag, lo, size, _ = unpack(blob)
                    yield from rows(doc, tag, lo, lo + size)
                    continue
                if bucket != now and held:
                    yield from flush()
                    held = []
                now = bucket
                held.append(blob)
        if held:
            yield from flush()

    dealt = sent.repartition(n_parts, "kind", F.when(F.col("kind") == 0, F.col("bucket")).otherwise(
        F.xxhash64("blob"))).sortWithinPartitions("kind", "bucket")
    return dealt.mapInArrow(run, "doc_id long, tag long, lo long, hi long")


def dedup(docs: DataFrame, min_len: int = MIN_LEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): one row per input row, ``kept`` the bytes
    left, ``n_spans`` the maximal removed runs.

    Null texts are empty; texts under ``min_len`` bytes lose nothing. Rows with the same
    doc_id don't remove each other's text, and repeated rows get equal results. Rows with a
    null doc_id are in no order: they stay whole and remove nothing. Other columns are
    ignored; an empty table gives an empty result."""
    if min_len < 2 * GRAM:
        raise ValueError(f"min_len must be at least {2 * GRAM}")
    spark = docs.sparkSession
    ship_package(spark)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    facts = own.groupBy("doc_id").agg(F.count_distinct(F.xxhash64("text")).alias("texts"),
                                      F.sum(F.octet_length("text")).alias("b")).agg(
        F.max("texts"), F.sum("b")).first()
    # only where rows with one id have different texts is there need to tell them apart
    tag = F.xxhash64("text") if (facts[0] or 0) > 1 else F.lit(0).cast("long")
    own = own.withColumn("tag", tag)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    long = own.where((F.octet_length("text") >= min_len) & F.col("doc_id").isNotNull()).select("doc_id", "tag", "text")
    hot, singles = hot_grams(long, min_len)
    sent = 4 * (facts[1] or 0) + singles * min_len
    n_parts = max(n_parts, sent // PART_BYTES)
    n_buckets = max(n_parts, sent // BUCKET_BYTES)
    found = stage_table(_removals(_send(long, n_buckets, min_len, hot), n_parts, min_len), "suffix-removals")
    drop_shuffles(spark)

    def squeeze(batches):
        for b in batches:
            yield b.set_column(2, "text", pa.array(
                [zstandard.ZstdCompressor(level=1).compress(t) for t in b.column(2).to_pylist()], pa.binary()))

    # ranges by document: a range list is as long as its document at most
    ranges = found.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("lo", "hi")).alias("r")).select(
        "doc_id", "tag", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"))
    packed = own.select("doc_id", "tag", "text").mapInArrow(squeeze, "doc_id long, tag long, text binary")
    joined = packed.join(ranges, ["doc_id", "tag"], "left").select("doc_id", "text", "lo", "hi")

    def cut(batches):
        for b in batches:
            out = []
            for doc, text, lo, hi in zip(*(c.to_pylist() for c in b.columns)):
                text = zstandard.ZstdDecompressor().decompress(text, max_output_size=0)
                out.append((doc, len(text), *remove(text, lo or [], hi or [])))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def remove(text: bytes, lo: list[int], hi: list[int]) -> tuple[int, int, bytes]:
    """(removed bytes, maximal removed runs, bytes left) without the ranges lo[i]:hi[i]."""
    kept, at, runs, gone = [], 0, 0, 0
    for a, b in sorted(zip(lo, hi)):
        if a > at or not runs:
            kept.append(text[at:a])
            runs += 1
            gone += b - a
        elif b > at:
            gone += b - at
        at = max(at, b)
    return gone, runs, b"".join([*kept, text[at:]])




def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their later copies of 50-byte strings."""
    return dedup(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
