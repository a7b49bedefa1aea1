import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import clash

from shopflow.llm import collocations as C


def brute(rows, least=30, top=2000):
    f, n, out = {}, Counter(), []
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.setdefault(lang, Counter()).update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        within = Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    within[p[i:i + k]] = max(within[p[i:i + k]], a)
        rows = []
        for p, a in cand.items():
            if 100 * within[p] < 80 * a:
                score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
                for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def run(df, **kw):
    return sorted(tuple(r) for r in C.collocations(df, **kw).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_documents_and_edges(docs):
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert run(clash(docs, "hi", "lo", "f", "id", "word", "words", "chunk", "n", "rank").repartition(5)) == brute(rows)


@pytest.mark.parametrize("head, chunk", [(40, 700), (0, 1 << 22)])
def test_bounds_do_not_change_results(docs, monkeypatch, head, chunk):
    """Small chunks, and phrases beyond the ranked ones."""
    monkeypatch.setattr(C, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(C, "HELD_BYTES", 2 * chunk)
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert run(docs.repartition(3), least=5, top=300, head=head) == brute(rows, 5, 300)


def test_pieces_words_and_ties(spark):
    rows = [("en", "A b.c d"), ("en", "a\tb  C d"), ("en", "a a a a"), (None, "x y"), ("und", "x y;"), (None, None), ("en", ""),
            ("en", "É b É b"), ("en", "one\ntwo"), ("en", "nbsp word nbsp word"), ("de", "...!!"), ("fr", "\xff \x00 \xff \x00")]
    df = spark.createDataFrame(rows * 3, "lang string, text string")
    assert run(df, least=2, top=5) == brute(rows * 3, 2, 5)


def test_tiles_against_plain_counts(monkeypatch):
    monkeypatch.setattr(C, "DENSE", 300)
    monkeypatch.setattr(C, "BUFFER", 2000)
    monkeypatch.setattr(C, "TILES", 2)
    rng = np.random.default_rng(1)
    a, b = (np.minimum(rng.zipf(1.3, 30000), (1 << 31) - 1).astype(np.int64) for _ in range(2))
    counter, got = C.TileCounter(), Counter()
    parts = [p for i in range(0, 30000, 700) for p in counter.add(a[i:i + 700], b[i:i + 700])]
    assert counter.dense
    for x, y, c in [*parts, *counter.count(), *counter.close()]:
        for key in zip(x.tolist(), y.tolist(), c.tolist()):
            got[key[:2]] += key[2]
    assert got == Counter(zip(a.tolist(), b.tolist()))


def test_exact_beyond_64_bits(spark):
    big = (1 << 62) + 12345
    one = 1 << 32
    words = spark.createDataFrame([("en", "a", big, 1), ("en", "b", big + 2, 2)], "lang string, word string, f long, id long")
    found = {2: spark.createDataFrame([(one | 2, 0, big - 1)], "hi long, lo long, f long")}
    r = C.scored(words, found).first()
    assert r.score == 2000000 * (big - 1) // (2 * big + 2) and (r.l, r.r, r.lang) == (big, big + 2, "en")


def test_empty(no_docs, spark):
    assert run(no_docs) == []
    assert run(spark.createDataFrame([(None, None), ("en", " ")], "lang string, text string"), least=1) == []
