import math
import re
from collections import Counter

from conftest_llm import clash
from pyspark.sql import functions as F

from shopflow.llm import licenses as L


def plain_cosine(words, template, df, n):
    """Cosine over all words; words outside the templates weigh as if no file had them."""
    idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in set(words) | set(template)}
    a, b = Counter(words), Counter(template)
    dot = sum(a[w] * idf[w] * b[w] * idf[w] for w in a)
    return dot / math.sqrt(sum((a[w] * idf[w]) ** 2 for w in a) * sum((b[w] * idf[w]) ** 2 for w in b))


def brute(rows, least):
    vocab = {w for ts in L.TEMPLATES.values() for t in ts for w in L.words_of(t.encode())}
    n, df = len(rows), Counter(w for _, _, t in rows for w in set(L.words_of((t or "").encode())) & vocab)
    df = {w: df[w] for w in vocab if df[w]}
    own = []
    for _, _, t in rows:
        tag = re.search(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+(?: (?:AND|OR|WITH) [A-Za-z0-9.+-]+)*)", t or "")
        if tag:
            own.append((1.0, tag[1]))
            continue

        def cosines(u):
            return sorted(((plain_cosine(u, L.words_of(x.encode()), df, n), name) for name in L.TEMPLATES
                           for x in L.TEMPLATES[name]), reverse=True)

        def share(u):
            w2 = {w: (c * (math.log((1 + n) / (1 + df.get(w, 0))) + 1)) ** 2 for w, c in Counter(u).items()}
            return sum(v for w, v in w2.items() if w in vocab) >= least * least * sum(w2.values())

        parts = [[]]
        for line in (t or "").split("\n"):
            w = L.words_of(line.encode())
            if w:
                parts[-1].append(w)
            elif parts[-1]:
                parts.append([])
        whole = [[w for line in p for w in line] for p in parts if p]
        units = [u for p, u in zip(parts, whole) for u in [*p, u]]
        marks = "".join("x" if share(p) and any(w in vocab for w in p) else " " for p in whole)
        units += [[w for p in whole[m.start():m.end()] for w in p] for m in re.finditer("x+", marks)]
        units += [[w for p in whole for w in p]] if "x" in marks else []
        best = (False, 0.0, None)
        for u in units:
            found = cosines(u)
            c, name = found[0]
            second = max(x for x, other in found if other != name)
            if c >= least and second < c * (1 - L.MARGIN) and (name != L.RESERVED, c) > (best[0], best[1] + 1e-9):
                best = (name != L.RESERVED, c, name)
        own.append(best[1:])
    given = {}
    for (i, p, _), (c, name) in zip(rows, own):
        if p is not None and name and re.match(L.LICENSE_FILES, p.rsplit("/", 1)[-1]):
            d = p.rsplit("/", 1)[0] if "/" in p else ""
            given.setdefault(d, []).append((-c, p, i, name))
    out = []
    for (i, p, _), (c, name) in zip(rows, own):
        if name:
            out.append((i, p, name, round(c, 9), "own", None))
            continue
        d = None if p is None else p.rsplit("/", 1)[0] if "/" in p else ""
        while d is not None and d not in given:
            d = d.rsplit("/", 1)[0] if "/" in d else "" if d else None
        out.append((i, p, min(given[d])[3] if d is not None else None, 0.0, "inherited" if d is not None else "none", d))
    return sorted(out, key=str)


def run(df):
    return sorted(((r.file_id, r.path, r.license, round(r.score, 9), r.found, r.from_dir) for r in L.licenses(df).collect()),
                  key=str)


def test_inheritance_and_edges(spark):
    mit, apache = L.TEMPLATES["MIT"][1], L.TEMPLATES["Apache-2.0"][1]
    rows = [(1, "LICENSE", mit), (2, "a.txt", "x"), (3, "a/b/c.txt", "y"), (4, "a/b/LICENSE.md", apache.replace("; ", ";\n")),
            (5, "a/b/d/e/f.txt", None), (6, "a/bb/f.txt", ""), (7, None, "z"), (8, "a/b/own.py", "# " + mit + "\ncode here"),
            (9, "q/LICENSE", "no license text at all"), (10, "q/r.txt", "words"), (11, "a/b/COPYING", mit), (5, "a/b/d/e/f.txt", None),
            (12, "a/b/d/LICENSES/x.txt", "All rights reserved."), (13, "a//b/c", "t"), (14, "x" * 3000 + "/y", "long " * 20000),
            (15, "/root.txt", "r"), (16, "a/b/", "dir")]
    df = clash(spark.createDataFrame(rows, "file_id long, path string, text string"), "dir", "up", "license", "score")
    got = run(df)
    assert got == brute(rows, L.MIN_COSINE)
    found = {r[0]: r for r in got}
    assert found[5][2:] == ("Apache-2.0", 0.0, "inherited", "a/b") or found[5][5] == "a/b"
    assert found[2][2] == "MIT" and found[2][5] == "" and found[8][4] == "own" and found[7][4] == "none"
    assert L.licenses(df.limit(0)).count() == 0


def test_documents(docs):
    n = F.col("doc_id")
    df = docs.select(n.alias("file_id"), F.when(n % 7 == 0, F.concat(F.col("source"), F.lit("/LICENSE"))).otherwise(
        F.concat(F.col("source"), F.lit("/d/"), n)).alias("path"), "text")
    rows = [tuple(r) for r in df.collect()]
    got = run(df)
    assert got == brute(rows, L.MIN_COSINE)
    lines = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT"}
    by_id = {(r[0], r[1]): r for r in got}
    for i, p, t in rows:
        for line, name in lines.items():
            if line in (t or "").split("\n"):
                assert by_id[i, p][2] is not None and by_id[i, p][4] == "own"


GNU = ("This {work} is free software; you can redistribute it and/or modify\nit under the terms of the GNU {kind}General Public "
       "License as published by\nthe Free Software Foundation; either version {version} of the License, or\n(at your option) any "
       "later version.")
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NAMED = [
    (GNU.format(work="program", kind="Affero ", version="3"), "AGPL-3.0"),
    (GNU.format(work="program", kind="", version="3"), "GPL-3.0"),
    (GNU.format(work="program", kind="", version="2"), "GPL-2.0-or-later"),
    (GNU.format(work="library", kind="Lesser ", version="2.1"), "LGPL-2.1"),
    (GNU.format(work="library", kind="Lesser ", version="3"), "LGPL-3.0"),
    (BSD.split("\n\n")[0], None),  # its first sentence leaves the kind open
    ("BSD 2-Clause License\n\nCopyright (c) 2020, A. Person\nAll rights reserved.\n\n" + BSD, "BSD-2-Clause"),
    (BSD + "\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or "
     "promote products derived from\n   this software without specific prior written permission.", "BSD-3-Clause"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
    ("// Distributed under the Boost Software License, Version 1.0.\n//    (See accompanying file LICENSE_1_0.txt or copy at\n"
     "//          http://www.boost.org/LICENSE_1_0.txt)", "BSL-1.0"),
    ("Eclipse Public License - v 2.0", "EPL-2.0"),
    ("# SPDX-License-Identifier: MIT\ncode", "MIT"),
    ("/* SPDX-License-Identifier: Apache-2.0 OR MIT */", "Apache-2.0 OR MIT"),
    ("SPDX-License-Identifier: NONE", None),
    ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nEveryone is permitted to copy", "GPL-2.0"),
    ("Copyright 2020 A. Person.\nAll rights reserved.\n\nReleased under the MIT License.", "MIT"),
    ("All rights reserved.", "LicenseRef-All-Rights-Reserved"),
]


def test_close_licenses_are_told_apart(spark):
    """Alone and among many plain files, whose words change the frequencies."""
    prose = ["the version of a program that you can use in 2 or 3 forms " * (k % 5 + 1) for k in range(400)]
    for more in ([], prose):
        rows = [(k, None, text) for k, (text, _) in enumerate(NAMED)] + [(1000 + k, None, t) for k, t in enumerate(more)]
        got = {r.file_id: r.license for r in L.scan(spark.createDataFrame(
            rows, "file_id long, path string, text string")).withColumnRenamed("own_license", "license").collect()}
        assert [(text, got[k]) for k, (text, _) in enumerate(NAMED)] == NAMED
        assert not any(got[r[0]] for r in rows[len(NAMED):])
    named = [r for r in rows[:len(NAMED)] if "NONE" not in r[2]]
    assert run(spark.createDataFrame(named, "file_id long, path string, text string")) == brute(named, L.MIN_COSINE)
