import numpy as np
import pytest
from conftest_llm import SF, clash

from shopflow.llm import embed_pigeonhole as E


def brute(rows, least=0.95):
    n = max((len(v) for _, v in rows if v), default=0)
    ok = [i is not None and v is not None and None not in v and bool(np.isfinite(v).all()) and any(v) for i, v in rows]
    u = np.array([np.pad(np.array(v, float) / np.linalg.norm(np.array(v, float)), (0, n - len(v))) if g else np.zeros(n)
                  for (_, v), g in zip(rows, ok)])
    size = np.array([len(v) if g else 0 for (_, v), g in zip(rows, ok)])
    link = (u @ u.T >= least) & np.outer(ok, ok) & (size[:, None] == size[None])
    np.fill_diagonal(link, False)
    ids = [i for i, _ in rows]
    low = list(ids)
    while True:
        new = [min([low[k], *(low[j] for j in np.flatnonzero(link[k]))]) if ok[k] else ids[k] for k in range(len(ids))]
        if new == low:
            break
        low = new
    return sorted(((i, int(link[k].sum()), c, i == c) for k, (i, c) in enumerate(zip(ids, low))), key=str)


def run(df, **kw):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df, **kw).collect()), key=str)


def near(rng, base, cosine):
    """A vector at this cosine from ``base``."""
    x = rng.normal(size=len(base))
    x -= x @ base / (base @ base) * base
    return cosine * base / np.linalg.norm(base) + np.sqrt(1 - cosine ** 2) * x / np.linalg.norm(x)


def vectors(dim=64, n=300, seed=1):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dim) * rng.uniform(0.1, 9) for _ in range(n)]
    rows += [near(rng, rows[k % 40], c) for k in range(300) for c in (0.93, 0.9499, 0.9501, 0.99, 1.0)[k % 5:k % 5 + 1]]
    rows += [near(rng, rows[0], 0.985) for _ in range(80)] + [rows[1]] * 30
    return [(1000 + 3 * i, [float(x) for x in np.float32(v)]) for i, v in enumerate(rows)]


@pytest.mark.parametrize("leaf, chunk, dim", [(4096, 8192, 64), (40, 8192, 64), (30, 10, 64), (60, 50, 20)])
def test_links_with_trees_and_chunks(spark, monkeypatch, leaf, chunk, dim):
    monkeypatch.setattr(E, "LEAF_ROWS", leaf)
    monkeypatch.setattr(E, "CHUNK_ROWS", chunk)
    rows = vectors(dim)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert run(df) == brute(rows)


def test_given_vectors_and_edges(spark):
    given = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    v = given[0][1]
    edge = [(9000, None), (9001, []), (9002, [0.0] * 64), (9003, [None] + v[1:]), (9004, [float("nan")] + v[1:]),
            (9005, [float("inf")] + v[1:]), (9006, v[:63]), (9007, [x * 2 for x in v]), given[3], (9008, [-0.0] * 64),
            (9009, [1e-30 * x for x in v]), (9010, [1e30 * x for x in v])]
    rows = given + edge
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "v", "id", "n", "links", "label")
    assert run(df) == brute(rows)
    assert run(df.limit(0)) == []
    lone = spark.createDataFrame([(1, None), (None, None)], "vec_id long, embedding array<double>")
    assert run(lone) == sorted([(1, 0, 1, True), (None, 0, None, True)], key=str)


def test_rotation_keeps_distances_and_budgets_add_up():
    rng = np.random.default_rng(3)
    u = E.unit(rng.normal(size=(50, 48)))
    x = E.rotate(u)
    assert np.allclose(x @ x.T, u @ u.T) and (E.rotate(u[7:9]) == x[7:9]).all()
    b = E.Blocks(rng.normal(size=(200, 48)), 0.95, 3)
    assert np.isclose(sum(b.budget), 0.1) and b.parts()[-1][1] == 64


def test_a_ball_reaches_the_homes_of_all_in_it():
    rng = np.random.default_rng(4)
    b = E.Blocks(rng.normal(size=(500, 64)), 0.95, 5)
    x = E.rotate(E.unit(rng.normal(size=(400, 64))))[:, :8]
    y = x + rng.normal(size=x.shape) * 0.02
    near_ = ((x - y) ** 2).sum(1) <= b.budget[0]
    home = dict(zip(*b.leaves(y, 0, False)))
    reach = set(zip(*b.leaves(x, 0, True)))
    assert near_.any() and all((i, home[i]) in reach for i in np.flatnonzero(near_))


def test_every_length_is_joined(spark):
    rng = np.random.default_rng(6)
    base = {d: rng.normal(size=d) for d in (2, 3, 40)}
    rows = [(100 * d + k, near(rng, base[d], (0.99, 0.9, 1.0)[k % 3]).tolist()) for d in base for k in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    assert run(df) == brute(rows)
