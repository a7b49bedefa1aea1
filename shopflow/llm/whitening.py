"""Whitening of embeddings by shifted Cholesky QR.

The centred rows of the fit list are a tall matrix A. A pass over them sums the Gram matrix
of the rows as they stand, its Cholesky factor R orthogonalises them by a triangular solve,
and the next pass starts from the rows so solved. The first factor is shifted, which keeps
it positive definite however close to dependent the columns are; later passes mend what the
shift left, until the Gram matrix is the identity. The product of the factors is the R of
A = QR, and its singular value decomposition gives the components without ever squaring
their condition. Where columns depend on each other (fewer vectors than dimensions, a
constant dimension) a later pass keeps the directions that its Gram matrix has.

Only Gram matrices of one vector length leave the tasks: summed in 32 tasks, then in one,
so the driver gets one matrix a length however many tasks there were.

Vectors that are null or hold null or non-finite entries are left out; zero vectors and
repeated rows stay. Vectors of different lengths are fitted apart, each length on its own.
An empty vector has no component and gives no row. Entries beyond 2^46 in absolute value
count as 2^46. Components without variance have ``whitened`` null and ``explained`` 0 (null
where nothing varies, as with a single distinct vector). A ``deviation`` beyond the range of
a long is null. An empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from shopflow.llm.common import map_rows, read_table, stage_table

SCALE, OFFSET = 64, 1_000_000
LIMIT = float(1 << 46)
SLOTS = 32  # tasks that add up the tasks' matrices
BLOCK = 1 << 19  # entries worked on together
PASSES = 8
ORTHOGONAL = 1e-13  # per dimension: the distance from the identity that ends the passes
DEPENDENT = 1e-12  # of the largest eigenvalue of an orthogonalised Gram matrix: no direction


def whole(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The usable vectors of a column by length: (positions, entries as long x)."""
    sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(pc.cast(col.flatten(), pa.float64()), math.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    ok = (bad[ends] == bad[ends - sizes]) & (sizes > 0)
    for d in np.unique(sizes[ok]):
        at = np.flatnonzero(ok & (sizes == d))
        step = max(1, BLOCK // int(d))
        for i in range(0, len(at), step):
            rows = at[i:i + step]
            c = flat[(ends[rows] - d)[:, None] + np.arange(d)]
            yield rows, np.floor(SCALE * np.clip(c, -LIMIT, LIMIT)).astype(np.int64) + OFFSET


def packed(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The rows of the fit list in a batch, by length."""
    raw = batch.column(0).to_pylist()
    sizes = np.array([len(r) // 8 for r in raw], np.int64)
    for d in np.unique(sizes):
        at, step = np.flatnonzero(sizes == d), max(1, BLOCK // int(d))
        for i in range(0, len(at), step):
            yield np.frombuffer(b"".join(raw[k] for k in at[i:i + step]), "<i8").reshape(-1, int(d))


def distances(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - total, exact: as longs, or as Python integers where those would not hold it."""
    most = max(map(abs, total), default=0) + n * (int(np.abs(x).max()) if x.size else 0)
    if most < 1 << 62:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    return (distances(x, n, total) / n).astype(np.float64)


def squares(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """The sum of squared distances of each row, None beyond a long."""
    d = distances(x, n, total)
    if d.dtype != object and (not d.size or int(np.abs(d).max()) ** 2 * d.shape[1] < 1 << 62):
        return (d * d).sum(1).tolist()
    sums = (d.astype(object) ** 2).sum(1)
    return [int(s) if s < 1 << 63 else None for s in sums]


def solve_right(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """q with q @ r = a, for an upper triangular r: column after column."""
    q = np.empty_like(a)
    for j in range(r.shape[1]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


@dataclass
class Pass:
    """One factor: rows are solved by ``upper``, or turned to ``basis`` where that is set."""

    upper: np.ndarray
    basis: np.ndarray | None = None

    def apply(self, a: np.ndarray) -> np.ndarray:
        return solve_right(a, self.upper) if self.basis is None else a @ self.basis


def factor(gram: np.ndarray, n: int, first: bool) -> Pass | None:
    """The factor of a Gram matrix; None where the rows are orthogonal already."""
    d = len(gram)
    if first:
        shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * np.trace(gram)
        return Pass(np.linalg.cholesky(gram + shift * np.eye(d)).T)
    if np.abs(gram - np.eye(d)).max() <= ORTHOGONAL * d:
        return None
    values, vectors = np.linalg.eigh(gram)
    kept = values > DEPENDENT * values[-1]
    if kept.all():
        return Pass(np.linalg.cholesky(gram).T)
    root = np.sqrt(values[kept])
    return Pass(root[:, None] * vectors[:, kept].T, vectors[:, kept] / root)


def summed(fit: DataFrame, value: Callable[[np.ndarray], np.ndarray | None], kind: str = "<f8") -> dict[int, np.ndarray]:
    """The sum of ``value`` (an array of ``kind``, or None) over the fit list, by length."""
    schema = "d int, slot int, m binary"

    def of_tasks(batches: Iterable[pa.RecordBatch], rows: Callable) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for d, v in rows(b):
                sums[d] = sums[d] + v if d in sums else v
        slot = TaskContext.get().partitionId() % SLOTS
        keys = sorted(sums)
        yield pa.RecordBatch.from_pydict({
            "d": pa.array(keys, pa.int32()), "slot": pa.array([slot] * len(keys), pa.int32()),
            "m": pa.array([sums[d].tobytes() for d in keys], pa.binary())})

    def of_fit(b: pa.RecordBatch):
        for x in packed(b):
            v = value(x)
            if v is not None:
                yield x.shape[1], v.ravel()

    def of_sums(b: pa.RecordBatch):
        for d, m in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            yield d, np.frombuffer(m, kind)

    parts = fit.mapInArrow(lambda it: of_tasks(it, of_fit), schema)
    for slots in (SLOTS, 1):
        parts = parts.repartition(slots, "slot").mapInArrow(lambda it: of_tasks(it, of_sums), schema)
    return {r.d: np.frombuffer(r.m, kind) for r in parts.collect()}


@dataclass
class Whitening:
    """What was learned of the vectors of one length ``d``: ``n`` distinct ones with the sums
    ``total``, and for each component its direction, variance and share of the whole."""

    d: int
    n: int
    total: list[int]
    directions: np.ndarray
    variance: np.ndarray
    explained: list[float | None]
    identity_error: float = 0.0

    def apply(self, x: np.ndarray) -> np.ndarray:
        """The whitened coordinates of rows, NaN for components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = centred(x, self.n, self.total) @ self.directions.T / np.sqrt(self.variance)
        out[:, self.variance == 0] = np.nan
        return out


def fit_list(df: DataFrame, col: str) -> DataFrame:
    """Each distinct vector x once, packed as little-endian longs, in the shared folder."""
    def run(b: pa.RecordBatch) -> Iterable[dict]:
        for _, x in whole(b.column(0)):
            yield {"x": [r.astype("<i8").tobytes() for r in x]}

    return stage_table(map_rows(df.select(col), run, "x binary").distinct(), "whitening-fit")


def fit(df: DataFrame, col: str = "embedding", k: int = 16) -> dict[int, Whitening]:
    """The whitening of up to ``k`` components for each length of the vectors in ``col``."""
    x_list = fit_list(df, col)

    def sums(x: np.ndarray) -> np.ndarray:  # high and low parts apart: no overflow below 2^36 rows
        return np.concatenate([[len(x)], (x >> 20).sum(0), (x & (1 << 20) - 1).sum(0)]).astype("<i8")

    size: dict[int, tuple[int, list[int]]] = {}
    for d, s in summed(x_list, sums, "<i8").items():
        high, low = s[1:d + 1].tolist(), s[d + 1:].tolist()
        size[d] = int(s[0]), [h * (1 << 20) + v for h, v in zip(high, low)]
    passes: dict[int, list[Pass]] = {d: [] for d in size}
    open_ = set(size)
    for step in range(PASSES):
        def gram(x: np.ndarray, todo=frozenset(open_)) -> np.ndarray | None:
            d = x.shape[1]
            if d not in todo:
                return None
            q = centred(x, *size[d])
            for p in passes[d]:
                q = p.apply(q)
            return q.T @ q

        for d, g in summed(x_list, gram).items():
            g = g.reshape(math.isqrt(len(g)), -1)
            p = factor(g, size[d][0], step == 0) if np.trace(g) > 0 else None
            if p is None:
                open_.discard(d)
            else:
                passes[d] = [*passes[d], p]
        if not open_:
            break
    models = {d: decompose(d, *size[d], passes[d], k) for d in size}

    def check(x: np.ndarray) -> np.ndarray:
        m = models[x.shape[1]]
        w = m.apply(x)[:, m.variance > 0]
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    for d, s in summed(x_list, check).items():
        r = int((models[d].variance > 0).sum())
        mean, cov = s[:r] / size[d][0], s[r:].reshape(r, r) / size[d][0]
        models[d].identity_error = float(np.abs(cov - np.outer(mean, mean) - np.eye(r)).max(initial=0.0))
    return models


def decompose(d: int, n: int, total: list[int], passes: list[Pass], k: int) -> Whitening:
    """The components from the singular value decomposition of the composed factors."""
    r = np.eye(d)
    for p in passes:
        r = p.upper @ r
    singular, right = np.linalg.svd(r)[1:] if passes else (np.zeros(d), np.eye(d))
    variance = np.concatenate([singular, np.zeros(d - len(singular))]) ** 2 / n
    variance[variance <= 1e-20 * variance.max(initial=0)] = 0
    k = min(k, d)
    turn = np.sign(right[np.arange(d), np.abs(right).argmax(1)])
    share = [float(v / variance.sum()) if variance.any() else None for v in variance[:k]]
    return Whitening(d, n, total, (right * turn[:, None])[:k], variance[:k], share)


def whiten(df: DataFrame, models: dict[int, Whitening], col: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row for each usable vector and component: (key, component, n, deviation, whitened,
    explained, identity_error). Vectors of a length that was not fitted give no row."""
    held = df.sparkSession.sparkContext.broadcast(models)  # directions: k x length each

    def run(b: pa.RecordBatch) -> Iterable[dict]:
        for at, x in whole(b.column(1)):
            m = held.value.get(x.shape[1])
            if m is None:
                continue
            k, w = len(m.variance), m.apply(x).ravel()
            yield {key: b.column(0).take(pa.array(np.repeat(at, k))),
                   "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(at)),
                   "n": np.full(len(w), m.n),
                   "deviation": [s for s in squares(x, m.n, m.total) for _ in range(k)],
                   "whitened": pa.array(w, mask=np.isnan(w)),
                   "explained": m.explained * len(at),
                   "identity_error": np.full(len(w), m.identity_error)}

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df.select(key, col), run, f"`{key}` {kind}, component int, n long, deviation long, "
                                              "whitened double, explained double, identity_error double")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened by the first 16 components of the distinct ones."""
    df = read_table(spark, sf_dir, "embeddings")
    return whiten(df, fit(df))
