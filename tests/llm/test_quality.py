import re
from collections import Counter

import xxhash
from conftest_llm import clash
from pyspark.sql import functions as F

from shopflow.llm import quality_lines as Q

WORD = "[^\x20\x09-\x0D]+"


def base(text):
    w = re.findall(WORD, text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def norm(line):
    return " ".join(re.findall(WORD, line.translate({i: i + 32 for i in range(65, 91)})))


def brute(rows, limit):
    """(doc_id, text, source) rows -> (doc_id, base..., failed, removed, kept). Documents of one
    text (all normalised lines in order) count once."""
    seen = {}
    for _, t, s in rows:
        lines = [n for n in map(norm, (t or "").split("\n")) if n]
        for n in lines:
            seen.setdefault((s, n), set()).add(tuple(lines))
    out = []
    for d, t, s in rows:
        m = base(t or "")
        failed = m[0] < 50 or 100 * m[4] > 50 * m[0]
        gone = sum(len(n.split(" ")) for n in map(norm, (t or "").split("\n")) if n and len(seen[s, n]) > limit)
        out.append((d, *m, failed, gone, not failed and gone <= 0.7 * m[0]))
    return sorted(out, key=str)


def run(df, **kw):
    return sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
                    r.removed_words, r.kept) for r in Q.verdicts(df, **kw).collect()), key=str)


def rows_of(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_documents_and_edges(docs):
    for limit in (20, 1):
        got = run(clash(docs, "rk", "kept", "host", "drops", "n_words"), max_docs=limit)
        assert got == brute(rows_of(docs), limit)


def boilerplate(spark):
    own = [" ".join(f"w{d}x{i}" for i in range(60)) for d in range(30)]
    menu = "Home  About\tCONTACT us"
    rows = [(d, f"{menu}\n{own[d]}\nLast", "h") for d in range(25)]
    rows += [(100 + d, f"home about contact us\n{own[d]}", "other") for d in range(5)]
    rows += [(200 + k, own[3] + "\nunique", "h") for k in range(40)]  # copies count once
    text = "\n".join(f"shared line number {i} of the site" for i in range(12))
    rows += [(300 + k, f"{text}\n{' '.join(f'k{k}v{i}' for i in range(8))}", "s") for k in range(25)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def test_boilerplate_is_removed_and_depleted_documents_rejected(spark):
    df, rows = boilerplate(spark)
    assert run(df) == brute(rows, 20)
    kept = {r.doc_id: r.text for r in Q.clean(df).collect()}
    assert all(kept[d] == rows[d][1].split("\n")[1] for d in range(25))
    assert kept[100] == rows[25][1] and kept[200] == rows[30][1]
    assert not any(300 <= d < 325 for d in kept)


def test_a_shared_line_longer_than_any_own_line_is_removed(spark):
    footer = " ".join(f"legal{i}" for i in range(90))
    menu = "Home About Contact our other shops"
    own = [[" ".join(f"w{d}x{k}y{i}" for i in range(5)) for k in range(30)] for d in range(25)]
    rows = [(d, "\n".join([menu, *own[d], footer]), "h") for d in range(25)]  # the longest lines are shared
    rows += [(100 + d, "\n".join([menu, *own[d][:2], footer]), "depleted") for d in range(25)]
    rows += [(200 + d, "\n".join([menu, *own[d], footer]), "few") for d in range(20)]
    rows += [(300 + d, "\n".join([menu, *own[7], footer]), "copies") for d in range(40)]  # copies count once
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert run(df) == brute(rows, 20)
    kept = {r.doc_id: r.text for r in Q.clean(df).collect()}
    assert all(kept[d] == "\n".join(own[d]) for d in range(25))
    assert not any(100 <= d < 125 for d in kept)
    assert all(kept[r[0]] == r[1] for r in rows[50:])


def test_clean_keeps_columns_and_empty_tables(docs, no_docs):
    kept = Q.clean(docs)
    assert kept.columns == docs.columns
    bad = {r.doc_id for r in Q.verdicts(docs).where(~F.col("kept")).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.collect() if r.doc_id not in bad)
    assert Q.verdicts(no_docs).count() == 0 and Q.clean(no_docs).count() == 0


def test_line_hash_is_sparks(spark):
    df = spark.createDataFrame([(" A  b\tÉ\x0bZ ",)], "l string")
    h = df.select(F.xxhash64(Q._normalised(F.col("l"))).alias("h")).first().h
    assert h % (1 << 64) == xxhash.xxh64_intdigest("a b Éz".replace("z", " z").encode(), 42)


def test_null_and_text_swapped_are_two_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, long), (1, long, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert run(df) == brute(rows, 20)
    assert [r.text for r in Q.clean(df).collect()] == [long]
