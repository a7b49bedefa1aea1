import re

from conftest_llm import clash

from shopflow.llm import mixing as M


def share(sizes):
    """{source: words} -> {source: target}, by repeated resharing."""
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        rest = sum(w[s] for s in names if s not in capped)
        t = {s: 3.0 * sizes[s] if s in capped else left * w[s] / rest for s in names}
        over = {s for s in names if s not in capped and t[s] > 3 * sizes[s]}
        if not over:
            return t
        capped |= over


def check(df, rows):
    size = {}
    for d, t, s in rows:
        size[s] = size.get(s, 0) + len(re.findall("[^\x20\x09-\x0D]+", t or ""))
    goal = share(size)
    got = M.mix(df).collect()
    assert len(got) == len(rows)
    want = sorted((d, len(re.findall("[^\x20\x09-\x0D]+", t or "")), size[s], round(goal[s], 6)) for d, t, s in rows)
    assert sorted((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in got) == want
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    for s in size:
        taken = sum(r.taken for r in got if (r.source_size, r.target) == (size[s], goal[s]))
        same = sum(1 for x in size if (size[x], goal[x]) == (size[s], goal[s]))
        assert abs(taken - same * goal[s]) <= same * (1 + len(size))
    assert sum(r.taken for r in got) <= sum(size.values())
    assert sorted(map(tuple, got)) == sorted(map(tuple, M.mix(df.repartition(3)).collect()))


def test_documents_and_edges(docs):
    check(clash(docs, "size", "taken", "rk", "place", "offset"), [(r.doc_id, r.text, r.source) for r in docs.collect()])


def test_capped_sources_and_repeated_rows(spark):
    rows = [(1, "a b c", "a"), (2, "a", "a"), (3, "x " * 900, "b"), (4, "y " * 500, "c"), (5, "z", "d"),
            (5, "z", "d"), (5, "z", "d"), (6, "q " * 40, None), (7, None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(df, rows)


def test_order_of_the_mix(spark, docs):
    copies, _ = M.schedule(docs)
    rows = sorted(copies.collect(), key=lambda r: r.offset)
    assert [r.offset for r in rows] == [sum(x.served for x in rows[:i]) for i in range(len(rows))]
    assert [r.finish for r in rows] == sorted(r.finish for r in rows) and rows[-1].finish == 1.0


def test_mixed_documents_are_whole(docs):
    from collections import Counter

    given = {(r.doc_id, r.text): r for r in docs.collect()}
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    assert all(given[r.doc_id, r.text] == r for r in rows)
    own = Counter((r.doc_id, r.text) for r in docs.collect())
    assert all(n <= 3 * own[k] for k, n in Counter((r.doc_id, r.text) for r in rows).items())


def test_empty_table(no_docs):
    assert M.mix(no_docs).count() == 0 and M.mixed_documents(no_docs).count() == 0


def test_null_and_text_swapped_are_two_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, "a", None), (2, "a b", "x")], "doc_id long, text string, source string")
    got = sorted((r.doc_id, r.size, r.taken) for r in M.mix(df).collect())
    assert all(t == 0 for _, n, t in got if n == 0) and [g[:2] for g in got] == [(1, 0), (1, 1), (2, 2)]


def test_a_row_repeated_very_often(spark, monkeypatch):
    monkeypatch.setattr(M, "UNFOLD", 1000)
    df = spark.range(100_000).selectExpr("7L AS doc_id", "'one two' AS text", "'s' AS source", "id AS extra").unionAll(
        spark.range(5).selectExpr("id AS doc_id", "'x y z' AS text", "'t' AS source", "id AS extra"))
    r = M.mix(df).selectExpr("count(*) AS n", "sum(taken) AS t", "max(if(doc_id = 7 AND size = 2, taken, 0)) AS most").first()
    assert r.n == 100_005 and abs(r.t - 200_015) <= 2 and r.most <= 6
    kept = M.mixed_documents(df)
    assert kept.columns == df.columns
    assert abs(kept.selectExpr("sum(size(split(text, ' '))) AS n").first().n - 200_015) <= 8
