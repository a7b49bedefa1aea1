import re
from collections import Counter

import pytest

import corpus_pipeline as C
from shopflow.llm import pii
from shopflow.llm.common import components, stage_table
from test_bpe import want
from test_quality import brute as quality_brute
from test_simhash import groups, plain


@pytest.fixture(scope="module")
def steps(spark, docs):
    """The input of each stage, and the result."""
    out = [docs]
    for name, stage in C.STAGES:
        out.append(stage_table(stage(spark, out[-1], None), f"test-{name}"))
    return [df.collect() for df in out]


def test_stages_against_brute_force(steps, docs):
    given, good, single, masked, mixed, tokens = steps
    kept = {r[0] for r in quality_brute([(r.doc_id, r.text, r.source) for r in given], 20) if r[-1]}
    assert {r.doc_id for r in good} == kept and len(good) > 100
    best = groups([r.doc_id for r in good], [plain(r.text) for r in good])
    assert sorted(r.doc_id for r in single) == sorted(set(best))
    assert sorted(r.doc_id for r in masked) == sorted(r.doc_id for r in single)
    texts = {r.doc_id: r.text for r in single}
    for r in masked:
        if not re.search(r"@|[0-9]", texts[r.doc_id]):
            assert r.text == texts[r.doc_id]
        for m in re.finditer(pii.FORMS["email"], r.text):
            raise AssertionError(m.group())
    rows = {r.doc_id: r for r in masked}
    assert all(rows[r.doc_id] == r for r in mixed)
    size = Counter()
    for r in masked:
        size[r.source] += len(r.text.encode().split())
    words = sum(len(r.text.encode().split()) for r in mixed)
    assert abs(words - sum(size.values())) <= 0.15 * sum(size.values())
    assert Counter(r.doc_id for r in tokens) == Counter(r.doc_id for r in mixed)
    for r in tokens:
        ids, back = want(rows[r.doc_id].text)
        assert r.n_tokens == len(ids) and back == rows[r.doc_id].text


def test_columns_and_empty_table(spark, no_docs):
    df = no_docs
    for _, stage in C.STAGES:
        out = stage(spark, df, None)
        assert out.count() == 0
        if stage is not C.STAGES[-1][1]:
            assert out.dtypes == df.dtypes
            df = out


def test_extra_columns_stay(spark, docs):
    from conftest_llm import clash

    df = clash(docs.limit(80), "kept", "rk", "fp", "spans", "size", "taken", "ids")
    for _, stage in C.STAGES[:-1]:
        df = stage(spark, df, None)
        assert df.columns[-7:] == ["kept", "rk", "fp", "spans", "size", "taken", "ids"]
    assert {r.ids for r in df.collect()} == {"extra"}


def test_entry_registers_all(spark):
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11)) and "pipeline" in names
    assert {"op10_quality_lines", "op4_fair_mix"} <= {*names}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(90, 91)],
                                   [(5, 3), (3, 5), (9, 3), (-4, 9)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(len(edges)):
        for a, b in edges:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    assert got == low
