import numpy as np
import pytest
import xxhash
from conftest_llm import clash

from shopflow.llm import simhash_pivots as S


def plain(text, k=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    ones = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def groups(keys, fps, bits=2):
    low = list(range(len(fps)))
    while True:
        new = [min(low[j] for j in range(len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= bits) for i in range(len(fps))]
        if new == low:
            break
        low = new
    best = {}
    for i, r in enumerate(low):
        if keys[i] is not None:
            best[r] = min(keys[i], best.get(r, keys[i]))
    return [best.get(r) for r in low]


def test_documents_and_edges(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fps = [plain(t) for _, t in rows]
    want = sorted(zip([d for d, _ in rows], fps, groups([d for d, _ in rows], fps)))
    got = sorted((r.doc_id, r.fp % (1 << 64), r.component_id)
                 for r in S.near_duplicates(clash(docs, "fp", "component_id", "rk", "key")).collect())
    assert got == want
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for *_, c in want})


def test_spark_hash_is_the_same(spark):
    h = spark.sql("select xxhash64('one two three') h").first().h
    assert h % (1 << 64) == plain("One TWO three")


def test_null_ids_and_empty(spark, no_docs):
    df = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (None, "x y z w"), (None, "x y z w"), (3, "")],
                               "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (None, None), (None, None), (3, 3)], key=str)
    assert sorted((r.text for r in S.keep_one(df).collect())) == ["", "a b c d", "x y z w"]
    assert S.near_duplicates(no_docs).count() == 0 and S.keep_one(no_docs).count() == 0


@pytest.mark.parametrize("cap", [8192, 20])
def test_links_of_close_fingerprints(spark, cap):
    """Chains and clusters within two bits, with hot keys split into chunks or not."""
    rng = np.random.default_rng(5)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 60)}
    for base in list(fps)[:6]:
        x = base
        for _ in range(60):
            x ^= 1 << int(rng.integers(64)) | 1 << int(rng.integers(64))
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in S.link_fingerprints(df, 2, run_cap=cap).collect()]
    low = {x: x for x in fps}
    for _ in range(len(fps)):
        new = dict(low)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == low:
            break
        low = new
    assert [low[x] for x in fps] == groups(fps, fps)


def test_pivot_coordinates_bound_the_distance():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    refs = S.pivots()
    assert np.abs(S.pivot_table(a, refs) - S.pivot_table(b, refs)).max() <= 1
    ka, kb = S.group_keys(S.pivot_table(a, refs), 3), S.group_keys(S.pivot_table(b, refs), 3)
    assert ((ka == kb).sum(1) >= 2).all()


def test_rows_alike_but_for_other_columns(spark):
    df = spark.createDataFrame([(1, "a b c d", k) for k in range(50)] + [(1, "a b c d", None)], "doc_id long, text string, n int")
    first = [S.keep_one(df.repartition(n)).collect() for n in (2, 5)]
    assert len(first[0]) == 1 and first[0] == first[1]
