import random

import numpy as np
import pytest
from conftest_llm import clash

from shopflow.llm import suffix_dedup as S


def brute(rows, k):
    """Rows (doc_id, text) -> per row (doc_id, removed, spans, kept)."""
    first = {}
    for d, t in rows:
        if d is not None:
            for i in range(len(t) - k + 1):
                first[t[i:i + k]] = min(d, first.get(t[i:i + k], d))
    out = []
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - k + 1):
            if d is not None and first[t[i:i + k]] < d:
                gone[i:i + k] = b"\1" * k
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), runs, bytes(c for c, g in zip(t, gone) if not g)))
    return sorted(out, key=lambda r: (r[0] is None, r))


def run(df, **kw):
    rows = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.dedup(df, **kw).collect()]
    return sorted(rows, key=lambda r: (r[0] is None, r))


def given(df):
    return [(r.doc_id, (r.text or "").encode()) for r in df.collect()]


def test_documents_and_edges(docs):
    assert run(docs) == brute(given(docs), 50)


def test_clashing_columns_null_ids_and_ids_with_different_texts(spark):
    a, b = "abcdefghij" * 9, "The quick brown fox jumps over the lazy dog, again and again and again."
    rows = [(1, a), (1, b), (2, a + b), (2, b[:60]), (None, a), (3, None), (4, "zz" + a[5:70] + "yy")]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"), "tag", "lo", "kept", "bucket")
    assert run(df) == brute(given(df), 50)


def test_empty_table(no_docs):
    assert run(no_docs) == []


@pytest.mark.parametrize("seed", range(3))
def test_random_passages(spark, seed, monkeypatch):
    """Passages that start, end and overlap anywhere; pieces and chunks cut them."""
    rng = random.Random(seed)
    letters = "ab" if seed == 0 else "abcdefgh "
    passages = ["".join(rng.choices(letters, k=rng.randint(40, 300))) for _ in range(6)]
    rows = []
    for d in range(60):
        t = ""
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            i = rng.randint(0, len(p) - 1)
            t += p[i:rng.randint(i, len(p))] + "".join(rng.choices(letters, k=rng.randint(0, 20)))
        rows.append((d, t))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert run(df, min_len=40) == brute([(d, t.encode()) for d, t in rows], 40)


def test_a_gram_of_many_different_contexts_makes_no_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_BLOCKS", 40, raising=False)
    phrases = [f"phrase {i} of letters" for i in range(40)]

    def top(p):  # the phrase's least gram
        return int(S.gram_hashes(np.frombuffer(p.encode(), np.uint8)).min())

    phrase = min(phrases, key=top)  # its gram is the least of most contexts
    rng = random.Random(5)

    def own():
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=60))

    shared = [own() for _ in range(6)]
    rows = [(d, own() + phrase + own()) for d in range(600)]
    rows += [(1000 + d, own() + rng.choice(shared)[-40:] + phrase + rng.choice(shared)[:rng.randint(5, 60)] + own())
             for d in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen, removals = [], S._removals

    def spy(sent, *a):
        count = {}
        for r in sent.where("kind = 0").collect():
            count[r.bucket] = count.get(r.bucket, 0) + len(S.unpack(bytes(r.blob))[0])
        seen.append((max(count.values()), sum(count.values()) / len(count)))
        return removals(sent, *a)

    monkeypatch.setattr(S, "_removals", spy)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")  # so many buckets
    try:
        got = run(df)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert got == brute(given(df), 50) and sum(r[2] for r in got) > 5000
    assert seen[0][0] < 3 * seen[0][1], seen


def test_blocks_cover_every_suffix_once():
    text = bytes(np.random.default_rng(1).integers(97, 100, 2000, np.uint8))
    _, start, end = S.blocks(text, 50)
    assert start[0] == 0 and end[-1] == len(text) - 49 and (start[1:] == end[:-1]).all()


def test_longest_previous_factors_against_all_pairs():
    rng = np.random.default_rng(2)
    text = bytes(rng.integers(97, 99, 400, np.uint8))
    at, doc = rng.permutation(340), rng.integers(0, 9, 340)
    words = S._suffix_words(np.frombuffer(text + b"\0" * 64, np.uint8), at, 48)
    got = S.longest_previous_factors(words, doc)

    def lcp(a, b):
        n = 0
        while n < 48 and text[a + n:a + n + 1] == text[b + n:b + n + 1] and a + n < 400 and b + n < 400:
            n += 1
        return n

    for i in range(0, 340, 7):
        best = max((lcp(at[i], at[j]) for j in range(340) if doc[j] < doc[i]), default=0)
        if max(at[i], 0) + best < 400 - 48:  # beyond the text the padding differs
            assert got[i] >= best or at[i] + best > 350
            assert got[i] == best or at[i] > 350


@pytest.mark.parametrize("counters", [1 << 20, 400])
def test_a_gram_met_once_a_chunk_is_counted(spark, monkeypatch, counters):
    """Also where a task may keep few counters."""
    monkeypatch.setattr(S, "HOT_BLOCKS", 30)
    monkeypatch.setattr(S, "CHUNK_BYTES", 200)
    monkeypatch.setattr(S, "COUNTERS", counters)
    rng = random.Random(3)
    phrase = min((f"phrase {i} of letters" for i in range(60)),
                 key=lambda p: int(S.gram_hashes(np.frombuffer(p.encode(), np.uint8)).min()))

    def own(n=90):
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))

    rows = [(d, own() + phrase + own()) for d in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    hot, suffixes = S.hot_grams(df.selectExpr("doc_id", "0L AS tag", "cast(text AS binary) AS text").select("text"), 50)
    grams = S.gram_hashes(np.frombuffer(phrase.encode(), np.uint8))
    assert grams.min() in hot and suffixes > 0
    assert run(df) == brute(given(df), 50)


def test_equal_keys_of_unequal_blocks():
    key, doc = np.array([5, 5, 7, 5, 7], np.uint64), np.array([1, 2, 2, 3, 3])
    text = ["a", "b", "c", "a", "c"]
    assert S.later_copies(key, doc, lambda i, j: text[i] == text[j]).tolist() == [3, 4]
    assert not len(S.later_copies(key[:0], doc[:0], None))
