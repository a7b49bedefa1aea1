"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within squared distance 2 - 2c. After a rotation that
spreads this distance, the vectors are split into blocks of few dimensions, and each
block gets its share of the squared distance as a budget: a pair within the whole has at
least one block within its share. So each block is range-joined on its own and the pairs
found are verified exactly.

A block's range join cuts its space into the leaves of a tree. A vector has one home leaf
and visits every leaf that its budget's ball reaches, so it meets the home of each vector
within the budget once. A pair that several blocks find belongs to the first of them.
Links are counted and joined to components in the tasks that find them: a task gives one
row per vector, whatever number of pairs it has seen. A leaf with very many home vectors
is split into chunks, each of which gets all the leaf's visitors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.llm.common import components, map_rows, read_table, stage_table, stars
from shopflow.session import ship_package

MIN_COSINE = 0.95
BLOCK_DIMS = 8
SAMPLE_ROWS = 4096  # vectors that place the trees' cuts; results don't depend on them
LEAF_ROWS = 4096  # wished number of vectors in a leaf
CHUNK_ROWS = 8192  # home vectors of a leaf that one task holds
MAX_DEPTH = 7
SEED = 7


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of ``v`` at length 1, in double precision."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def rotate(u: np.ndarray) -> np.ndarray:
    """An orthogonal transform: seeded signs and a Walsh-Hadamard transform, twice. Made of
    sums and differences alone, so a vector has the same image in every task."""
    n = 1 << max(0, u.shape[1] - 1).bit_length()
    x = np.zeros((len(u), n))
    x[:, :u.shape[1]] = u
    signs = np.random.default_rng(SEED).choice([-1.0, 1.0], (2, n))
    for s in signs:
        x = x * s
        h = 1
        while h < n:
            y = x.reshape(len(x), n // (2 * h), 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
            h *= 2
        x = x / np.sqrt(n)
    return x


class Blocks:
    """The blocks of rotated vectors, their budgets and their trees."""

    def __init__(self, sample: np.ndarray, min_cosine: float, depth: int):
        x = rotate(unit(sample))
        n = x.shape[1]
        self.cuts = list(range(0, n, min(BLOCK_DIMS, n))) + [n]
        total = 2 - 2 * min_cosine
        self.budget = [total * (b - a) / n * (1 + 1e-9) + 1e-12 for a, b in self.parts()]
        self.trees = [self._tree(x[:, a:b], depth) for a, b in self.parts()]
        self.min_cosine = min_cosine

    def parts(self) -> list[tuple[int, int]]:
        return list(zip(self.cuts[:-1], self.cuts[1:]))

    def _tree(self, x: np.ndarray, depth: int):
        """Nested (axis, cut, low, high); None is a leaf. Cuts at the median of the widest axis."""
        if depth == 0 or len(x) < 16:
            return None
        axis = int(np.argmax(x.std(0)))
        cut = float(np.median(x[:, axis]))
        low = x[:, axis] <= cut
        if low.all() or not low.any():
            return None
        return axis, cut, self._tree(x[low], depth - 1), self._tree(x[~low], depth - 1)

    def leaves(self, x: np.ndarray, block: int, reach: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf): the home leaf of each row, or all leaves that the budget's ball reaches."""
        rows, found = [], []

        def walk(node, at, over, number):
            if not len(at):
                return
            if node is None:
                rows.append(at)
                found.append(np.full(len(at), number))
                return
            axis, cut, low, high = node
            c = x[at, axis]
            for child, away, k in ((low, np.maximum(c - cut, 0), 1), (high, np.maximum(cut - c, 0), 2)):
                if reach:  # squared distance to the child's box, by axis
                    o = over.copy()
                    o[:, axis] = np.maximum(o[:, axis], away * away)
                    go = o.sum(1) <= self.budget[block]
                else:
                    o, go = over, (c <= cut) == (k == 1)
                walk(child, at[go], o[go], 2 * number + k)

        walk(self.trees[block], np.arange(len(x)), np.zeros(x.shape) if reach else np.zeros((len(x), 0)), 0)
        return np.concatenate(rows), np.concatenate(found)


def _matrix(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix): the lists of ``dim`` finite components that aren't all zero."""
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten()
    kind = np.float32 if pa.types.is_float32(flat.type) else np.float64
    flat = flat.to_numpy(zero_copy_only=False).astype(kind)
    rows = np.flatnonzero(size == dim) if dim else np.empty(0, np.int64)
    m = flat[(np.cumsum(size) - size)[rows][:, None] + np.arange(dim)] + kind(0)
    ok = np.isfinite(m).all(1) & (m != 0).any(1)
    return rows[ok], m[ok]



def _vectors(raw: pa.Array, dim: int) -> np.ndarray:
    rows = raw.to_pylist()
    kind = np.float32 if rows and len(rows[0]) == 4 * dim else np.float64
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), dim)


def _links(visits: DataFrame, blocks: Blocks, dim: int) -> DataFrame:
    """(id, links, root): for each group (block, leaf, chunk), the vectors that it links, the
    number of vectors each visitor links to, and a vector that stands for its component."""

    def match(home, guests, block):
        (hid, hn, hu, hx), (gid, _, gu, gx) = home, guests
        a, b = blocks.parts()[block]
        gb, hb = gx[:, a:b].astype(np.float32), hx[:, a:b].astype(np.float32)
        near = ((gb * gb).sum(1)[:, None] + (hb * hb).sum(1)[None] - 2 * gb @ hb.T) <= blocks.budget[block] + 1e-5
        i, j = np.nonzero(near)
        keep = []
        for lo in range(0, len(i), 1 << 15):
            p, q = i[lo:lo + (1 << 15)], j[lo:lo + (1 << 15)]
            ok = gid[p] != hid[q]
            p, q = p[ok], q[ok]
            for k, (a, b) in enumerate(blocks.parts()[:block + 1]):  # in this block and none before
                d = gx[p, a:b] - hx[q, a:b]
                inside = (d * d).sum(1) <= blocks.budget[k]
                ok = inside if k == block else ~inside
                p, q = p[ok], q[ok]
            ok = (gu[p] * hu[q]).sum(1) >= blocks.min_cosine
            keep.append((p[ok], q[ok]))
        return [np.concatenate(c) for c in zip(*keep)] if keep else ([], [])

    def row(ids, links, roots):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64()),
                                           pa.array(roots, pa.int64())], ["id", "links", "root"])

    def load(b: pa.RecordBatch, at: np.ndarray):
        u = unit(_vectors(b.column(6).take(pa.array(at)), dim))
        return b.column(4).to_numpy()[at], b.column(5).to_numpy()[at], u, rotate(u)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, home = None, None
        for b in batches:
            key = np.stack([b.column(c).to_numpy().astype(np.int64) for c in range(4)], 1)  # block, leaf, chunk, guest
            cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1), True])
            for s, e in zip(cut[:-1], cut[1:]):
                group, guest = tuple(key[s, :3]), key[s, 3]
                if group != now:
                    now, home = group, None
                if not guest:  # the home vectors come first
                    own = load(b, np.arange(s, e))
                    home = own if home is None else [np.concatenate(x) for x in zip(home, own)]
                    continue
                if home is None:
                    continue
                for lo in range(s, e, 512):
                    guests = load(b, np.arange(lo, min(lo + 512, e)))
                    i, j = match(home, guests, int(group[0]))
                    if len(i):
                        nodes, at = np.unique(np.r_[guests[0][i], home[0][j]], return_inverse=True)
                        links = np.zeros(len(nodes), np.int64)
                        np.add.at(links, at[:len(i)], home[1][j])
                        low = np.arange(len(nodes))
                        x, y = stars(len(nodes), at[:len(i)], at[len(i):])
                        low[x] = y
                        yield row(nodes, links, nodes[low])

    return visits.mapInArrow(run, "id long, links long, root long")


def near_duplicates(vectors: DataFrame, min_cosine: float = MIN_COSINE, id_col: str = "vec_id",
                    vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Equal vectors are one class while searching; each counts as a link of the others.
    Vectors link with those of their length; each length is joined on its own. Vectors that
    are null, zero, hold null or non-finite components, or have a null id link with nothing
    and are their own component.
    Other columns are ignored; an empty table gives an empty result."""
    if not 0.5 <= min_cosine <= 1:
        raise ValueError("min_cosine must be from 0.5 to 1")
    spark = vectors.sparkSession
    ship_package(spark)
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    size = F.coalesce(F.size("v"), F.lit(0))
    sizes = sorted(r.n for r in own.select(size.alias("n")).distinct().collect())  # lengths, not rows
    parts = [_of_length(own.where(size == n), n, min_cosine) for n in sizes if n > 0]
    out = own.where(size <= 0).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                      F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    for part in parts:
        out = out.unionByName(part)
    return out


def _of_length(own: DataFrame, dim: int, min_cosine: float) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors (vec_id, v) that all have ``dim`` entries."""
    spark = own.sparkSession

    def read(b: pa.RecordBatch) -> dict:
        rows, m = _matrix(b.column(1), dim)
        raw = np.full(b.num_rows, None, object)
        raw[rows] = [r.tobytes() for r in m]
        return {"vec_id": b.column(0), "v": list(raw)}

    rows = stage_table(map_rows(own, read, "vec_id long, v binary"), "vectors")
    sound = F.col("v").isNotNull() & F.col("vec_id").isNotNull()
    classes = stage_table(rows.where(sound).groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")),
                          "vector-classes")
    total = classes.count()
    if total == 0:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.lit(True).alias("kept"))
    sample = classes.orderBy(F.xxhash64("id")).limit(SAMPLE_ROWS).collect()
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(total / LEAF_ROWS)))))
    blocks = Blocks(_vectors(pa.array([bytes(r.v) for r in sample]), dim), min_cosine, depth)

    def homes(b: pa.RecordBatch) -> dict:
        x = rotate(unit(_vectors(b.column(0), dim)))
        found = [(k, *np.unique(blocks.leaves(x[:, a:z], k, False)[1], return_counts=True))
                 for k, (a, z) in enumerate(blocks.parts())]
        return {"block": np.concatenate([np.full(len(n), k) for k, _, n in found]),
                "leaf": np.concatenate([leaf for _, leaf, _ in found]), "n": np.concatenate([n for *_, n in found])}

    # a number for each block and leaf: at most 2 ** MAX_DEPTH a block
    chunks = {(r.block, r.leaf): -(-r.n // CHUNK_ROWS) for r in map_rows(
        classes.select("v"), homes, "block int, leaf int, n long").groupBy("block", "leaf").agg(
        F.sum("n").alias("n")).collect()}

    def visit(b: pa.RecordBatch) -> Iterator[dict]:
        ids, n, raw = b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(0)
        x = rotate(unit(_vectors(raw, dim)))
        for k, (a, z) in enumerate(blocks.parts()):
            for guest in (0, 1):
                at, leaf = blocks.leaves(x[:, a:z], k, bool(guest))
                of = np.array([chunks.get((k, int(y)), 0) for y in leaf])
                if guest:
                    at, leaf = np.repeat(at, of), np.repeat(leaf, of)
                    chunk = np.arange(len(at)) - np.repeat(np.cumsum(of) - of, of)
                else:
                    chunk = (ids[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(
                        np.int64) % of
                for lo in range(0, len(at), 50_000):
                    s = slice(lo, lo + 50_000)
                    yield {"block": np.full(len(at[s]), k), "leaf": leaf[s], "chunk": chunk[s],
                           "guest": np.full(len(at[s]), guest), "id": ids[at[s]], "n": n[at[s]],
                           "v": raw.take(pa.array(at[s]))}

    visits = map_rows(classes.select("v", "id", "n"), visit,
                      "block int, leaf int, chunk int, guest int, id long, n long, v binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(chunks))
    dealt = visits.repartition(parts, "block", "leaf", "chunk").sortWithinPartitions("block", "leaf", "chunk", "guest")
    found = stage_table(_links(dealt, blocks, dim), "vector-links")
    roots = components(found, "id", "root").withColumnRenamed("node", "id").withColumnRenamed("root", "low")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    by_class = classes.join(links, "id", "left").join(roots, "id", "left").select(
        "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("low", "id").alias("low"))
    named = rows.where(sound).join(by_class, "v").select("vec_id", "links", "low").unionByName(
        rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("low")))
    return named.select("vec_id", F.col("links").alias("n_links"), F.col("low").alias("component_id"),
                        F.coalesce(F.col("vec_id") == F.col("low"), F.lit(True)).alias("kept"))


def op5_embed_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine >= 0.95 links of all embeddings."""
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
