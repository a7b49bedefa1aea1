import math

import numpy as np
import pytest
from conftest_llm import SF, clash

from shopflow.llm import whitening as W


def brute(rows, k=16):
    """{position: [(component, n, deviation, whitened, explained)]} from the centred matrix."""
    ok = [i for i, (_, v) in enumerate(rows)
          if v and all(c is not None and math.isfinite(c) for c in v)]
    out = {}
    for d in {len(rows[i][1]) for i in ok}:
        at = [i for i in ok if len(rows[i][1]) == d]
        x = {i: tuple(math.floor(64 * c) + 1_000_000 for c in rows[i][1]) for i in at}
        fit = sorted(set(x.values()))
        n, total = len(fit), [sum(c) for c in zip(*fit)]
        b = np.array([[(n * c - s) / n for c, s in zip(r, total)] for r in fit])
        sing, right = np.linalg.svd(b)[1:]
        e = (np.concatenate([sing, np.zeros(d)])[:d] ** 2 / n)[:k]
        vec = right.T[:, :k]
        for i in at:
            dist = [n * c - s for c, s in zip(x[i], total)]
            w = np.array(dist) / n @ vec / np.sqrt(np.maximum(e, 1e-300))
            out[i] = [(c + 1, n, sum(t * t for t in dist), w[c], e[c], b.var(0).sum()) for c in range(len(e))]
    return out


def check(spark, rows, df=None, flat=1e-16):
    df = df if df is not None else spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in W.whiten(df, W.fit(df)).collect():
        got.setdefault(r.vec_id, []).append(r)
    want = {rows[i][0]: v for i, v in brute(rows).items()}
    assert got.keys() == want.keys()
    signs = {}
    for key, found in got.items():
        assert [r.component for r in sorted(found, key=lambda r: r.component)] == [c[0] for c in want[key]]
        for r, (c, n, dev, w, e, trace) in zip(sorted(found, key=lambda r: r.component), want[key]):
            assert (r.n, r.deviation) == (n, dev if dev < 1 << 63 else None)
            if e <= flat * trace:
                assert r.whitened is None and r.explained in (0.0, None)
                continue
            assert math.isclose(r.explained, e / trace, rel_tol=1e-7) and r.identity_error < 1e-9
            sign = signs.setdefault((n, c), np.sign(w * r.whitened) or 1)
            assert math.isclose(r.whitened, sign * w, rel_tol=1e-6, abs_tol=1e-6)
    return got


def test_given_vectors(spark):
    given = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in given.collect()]
    check(spark, rows, clash(given, "x", "d", "slot", "m", "n", "component"))
    assert W.op13_whitening(spark, SF).count() == 16 * len(rows)


def test_edges_and_lengths(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=20).tolist()) for i in range(60)]
    rows += [(100 + i, (rng.normal(size=5) * 3).tolist()) for i in range(40)]
    rows += [(200, None), (201, []), (202, [0.0] * 20), (203, [None] + [1.0] * 19), (204, [math.nan] + [1.0] * 19),
             (205, [math.inf] * 5), (206, rows[3][1]), (207, [1.0] * 3)]
    got = check(spark, rows)
    assert got[207][0].whitened is None and got[207][0].explained is None and got[207][0].n == 1


def test_repeated_rows_stay_and_count_once(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows + rows[:1] * 500, "vec_id long, embedding array<float>")
    out = W.whiten(df, W.fit(df))
    assert out.count() == 6 * 530 and {r.n for r in out.select("n").distinct().collect()} == {30}


def test_nearly_and_wholly_dependent_dimensions(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(300, 12)) * 1000
    a[:, 5] = 7.0  # constant
    a[:, 6] = a[:, 1]  # equal
    a[:, 7] = a[:, 2] + rng.integers(0, 2, 300) / 64  # apart by one step
    rows = [(i, r.tolist()) for i, r in enumerate(a)]
    got = check(spark, rows)
    assert sum(r.whitened is None for r in got[0]) == 2
    few = [(i, rng.normal(size=30).tolist()) for i in range(9)]  # fewer vectors than dimensions
    assert sum(r.whitened is not None for r in check(spark, few)[0]) == 8


def test_wide_spread_of_variances(spark):
    rng = np.random.default_rng(4)
    scale = 10.0 ** np.arange(0, -7, -1) * 1e6
    rows = [(i, r.tolist()) for i, r in enumerate(rng.normal(size=(400, 7)) * scale)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = W.fit(df)[7]
    assert model.identity_error < 1e-6 and (model.variance > 0).all()
    x = np.array([[math.floor(64 * c) for c in r] for _, r in rows], float)
    want = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2 / 400
    assert np.allclose(model.variance, want, rtol=1e-7)


def test_numbers_beyond_longs():
    x = np.array([[1 << 52, 3], [-(1 << 52), 5]])
    n = 1 << 20
    assert W.distances(x, n, [1, 2]).tolist() == [[n * a - b for a, b in zip(r, (1, 2))] for r in x.tolist()]
    assert W.squares(x, n, [1, 2]) == [None, None] and W.squares(x[:, 1:], 10, [3]) == [27 ** 2, 47 ** 2]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert W.whiten(df, W.fit(df)).count() == 0
    none = spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")
    assert W.whiten(none, W.fit(none)).count() == 0


@pytest.mark.parametrize("d", [1, 3, 9])
def test_triangular_solve(d):
    rng = np.random.default_rng(d)
    r = np.triu(rng.normal(size=(d, d))) + 3 * np.eye(d)
    a = rng.normal(size=(20, d))
    assert np.allclose(W.solve_right(a, r) @ r, a)
