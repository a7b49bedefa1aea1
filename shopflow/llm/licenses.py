"""License scans: TF-IDF cosine to templates, then inheritance by directory.

Lines, paragraphs, runs of paragraphs in license words and whole files are compared with
license templates (headers, titles and short licenses as a whole) as sparse TF-IDF vectors;
inverse document frequencies come from all files. Where two licenses are about equally near,
the text names neither. An SPDX tag declares its expression. A file without a match of its
own takes the license of the nearest directory above it that has a matching license file.
Ancestors are joined as paths, once per directory.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopflow.llm.common import map_rows, read_table, stage_table

MIN_COSINE = 0.7
MARGIN = 0.004  # share of the best cosine within which another license makes a text ambiguous
LICENSE_FILES = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-][^/]*)?$"
RESERVED = "LicenseRef-All-Rights-Reserved"  # decides only where no license is found

_GNU = ("is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public "
        "License as published by the Free Software Foundation{comma} either version {version} of the License, or (at your "
        "option) any later version.")
_WARRANTY = ("is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
             "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more "
             "details.")


def _gnu(work: str, kind: str, version: str, colon: str, comma: str) -> list[str]:
    """The notice's first paragraph, and its first two."""
    grant = f"This {work} " + _GNU.format(kind=kind, version=version, colon=colon, comma=comma)
    return [grant, f"{grant} This {work} " + _WARRANTY.format(kind=kind)]


_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:")
_BSD_TWO = (" Redistributions of source code must retain the above copyright notice, this list of conditions and the "
            "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list "
            "of conditions and the following disclaimer in the documentation and/or other materials provided with the "
            "distribution.")
_BSD_THREE = (" Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
              "promote products derived from this software without specific prior written permission.")
_BSD_END = (" THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
            "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
            "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
            "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
            "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
            "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
            "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
            "DAMAGE.")
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction")

# Fixed texts: usual notices, titles and short texts of public licenses, by SPDX identifier.
TEMPLATES: dict[str, list[str]] = {
    "AGPL-3.0": [
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        *_gnu("program", "Affero ", "3", ":", ","),
    ],
    "Apache-2.0": [
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", _BSD, _BSD + _BSD_TWO, _BSD + _BSD_TWO + _BSD_END],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
        _BSD,
        _BSD + _BSD_TWO + _BSD_THREE,
        _BSD + _BSD_TWO + _BSD_THREE + _BSD_END,
    ],
    "BSL-1.0": [
        "Boost Software License - Version 1.0 - August 17th, 2003",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
        "http://www.boost.org/LICENSE_1_0.txt)",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
        "and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, "
        "distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit "
        "third-parties to whom the Software is furnished to do so, all subject to the following:",
    ],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-ND-4.0": [
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to "
                "this work under CC0 1.0."],
    "EPL-2.0": [
        "Eclipse Public License - v 2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "GPL-2.0": [
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This work is licensed under the GNU General Public License, version 2.",
    ],
    "GPL-2.0-or-later": _gnu("program", "", "2", ";", ";"),
    "GPL-3.0": [
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This work is licensed under the GNU General Public License, version 3.",
        *_gnu("program", "", "3", ":", ","),
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
            "is hereby granted, provided that the above copyright notice and this permission notice appear in all "
            "copies."],
    "LGPL-2.1": [
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        *_gnu("library", "Lesser ", "2.1", ";", ";"),
    ],
    "LGPL-3.0": [
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        *_gnu("library", "Lesser ", "3", ":", ","),
    ],
    "MIT": [
        "Released under the MIT License.",
        _MIT,
        _MIT + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject "
        "to the following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software.",
    ],
    "MPL-2.0": [
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    RESERVED: ["All rights reserved."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

_BLANKED = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
_SPDX_ID = rb"\(*[A-Za-z0-9][A-Za-z0-9.+:-]*\)*"
_SPDX = re.compile(rb"SPDX-License-Identifier:[ \t]*(" + _SPDX_ID + rb"(?:[ \t]+(?:AND|OR|WITH)[ \t]+" + _SPDX_ID + rb")*)")


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words: runs of ASCII letters and digits and of bytes beyond ASCII. A number is
    one word with the word before it, so that a version weighs more than a digit; at the start
    it is a list mark, and left out."""
    words = text.lower().translate(_BLANKED).split()
    out = [p + b" " + w if w.isdigit() else w for p, w in zip([b"", *words], words)]
    return out[1:] if words and words[0].isdigit() else out


class Templates:
    """The templates' TF-IDF vectors. Words outside them have no coordinate of their own, but
    count in a text's length with the weight of a word that no file has."""

    def __init__(self, templates: dict[str, list[str]], df: dict[bytes, int], n_files: int):
        self.rows = [(name, Counter(words_of(t.encode()))) for name in sorted(templates) for t in templates[name]]
        self.names = np.array([name for name, _ in self.rows])
        self.vocab = {w: i for i, w in enumerate(sorted({w for _, c in self.rows for w in c}))}
        self.idf = np.array([np.log((1 + n_files) / (1 + df.get(w, 0))) + 1 for w in self.vocab])
        self.other = (np.log(1.0 + n_files) + 1) ** 2
        m = np.zeros((len(self.rows), len(self.vocab)))
        for r, (_, c) in enumerate(self.rows):
            for w, n in c.items():
                m[r, self.vocab[w]] = n * self.idf[self.vocab[w]]
        self.matrix = m / np.linalg.norm(m, axis=1, keepdims=True)

    def best(self, words: list[bytes], least: float) -> tuple[float, str | None, bool]:
        """The cosine to the nearest template and its license, if at least ``least`` and if no
        other license is within ``MARGIN``; and whether the text's own length lies so much in
        the templates' words that a template may be that near."""
        known: Counter = Counter()
        other: Counter = Counter()
        for w in words:
            i = self.vocab.get(w)
            if i is None:
                other[w] += 1
            else:
                known[i] += 1
        if not known:
            return 0.0, None, False
        at = np.fromiter(known, np.int64, len(known))
        x = np.fromiter(known.values(), float, len(known)) * self.idf[at]
        own, rest = float(x @ x), self.other * sum(n * n for n in other.values())
        if own < least * least * (own + rest):  # no template can be nearer than the known part
            return 0.0, None, False
        cosine = self.matrix[:, at] @ x / np.sqrt(own + rest)
        k = int(np.argmax(cosine))
        if cosine[k] < least or cosine[self.names != self.names[k]].max(initial=0.0) >= cosine[k] * (1 - MARGIN):
            return 0.0, None, True
        return float(cosine[k]), self.rows[k][0], True

    def scan(self, text: bytes, least: float) -> tuple[float, str | None, int | None]:
        """(cosine, license, line) of the best line, paragraph, run of paragraphs or of the whole
        text; of equally good ones (within 1e-9) that which ends first, the smaller before the larger.
        Runs are paragraphs in a row that are mostly in the templates' words; a text without one
        isn't compared as a whole. The first SPDX tag goes before all, at cosine 1; a mere
        reservation of rights comes after all others."""
        tag = _SPDX.search(text)
        if tag and tag[1].strip(b"()") not in (b"NONE", b"NOASSERTION"):
            return 1.0, b" ".join(tag[1].split()).decode(), text.count(b"\n", 0, tag.start())
        best, whole = (0.0, None, None), []
        paragraph, run, first, run_first, start = [], [], 0, 0, None

        def offer(found: tuple[float, str | None, bool], line: int) -> bool:
            nonlocal best
            score, name, near = found
            if name and (best[1] is None or (name != RESERVED, score) > (best[1] != RESERVED, best[0] + 1e-9)):
                best = score, name, line
            return near

        def end_run():
            if len(run) > 1:
                offer(self.best([w for p in run for w in p], least), run_first)
            run.clear()

        for i, line in enumerate([*text.split(b"\n"), b""]):
            words = words_of(line)
            if words:
                if not paragraph:
                    first = i
                near = offer(self.best(words, least), i)
                paragraph.append(words)
            elif paragraph:
                together = [w for p in paragraph for w in p]
                if len(paragraph) > 1:
                    near = offer(self.best(together, least), first)
                whole.append(together)
                if near:
                    run_first = run_first if run else first
                    start = run_first if start is None else start
                    run.append(together)
                else:
                    end_run()
                paragraph = []
        end_run()
        if start is not None and len(whole) > 1:
            offer(self.best([w for p in whole for w in p], least), start)
        return best


def document_frequencies(files: DataFrame, templates: dict[str, list[str]]) -> tuple[dict[bytes, int], int]:
    """Number of files with each word of the templates, and of all files. One number a
    template word, whatever the corpus."""
    vocab = {w for ts in templates.values() for t in ts for w in words_of(t.encode())}

    def run(b: pa.RecordBatch) -> dict:
        count: Counter = Counter()
        for t in b.column(0).to_pylist():
            count.update(vocab.intersection(words_of(t or b"")))
        return {"word": [*count, b""], "n": [*count.values(), b.num_rows]}

    rows = map_rows(files.select(F.col("text").cast("binary").alias("t")), run, "word binary, n long").groupBy(
        "word").agg(F.sum("n").alias("n")).collect()
    df = {bytes(r.word): r.n for r in rows}
    return df, df.pop(b"", 0)


def scan(files: DataFrame, templates: dict[str, list[str]] | None = None,
         min_cosine: float = MIN_COSINE) -> DataFrame:
    """(file_id, path, own_license, score, line) for every input row (columns file_id, path, text)."""
    templates = templates or TEMPLATES
    df, n = document_frequencies(files, templates)
    found = Templates(templates, df, n)

    def run(b: pa.RecordBatch) -> dict:
        got = [found.scan(t or b"", min_cosine) for t in b.column(2).to_pylist()]
        return {"file_id": b.column(0), "path": b.column(1), "own_license": [g[1] for g in got],
                "score": [g[0] for g in got], "line": [g[2] for g in got]}

    return map_rows(files.select(F.col("file_id").cast("long").alias("file_id"),
                                 F.col("path").cast("string").alias("path"),
                                 F.col("text").cast("binary").alias("t")),
                    run, "file_id long, path string, own_license string, score double, line int")


def directory(path: Column) -> Column:
    """The path without its last part ('' for a file at the top)."""
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def licenses(files: DataFrame, templates: dict[str, list[str]] | None = None,
             min_cosine: float = MIN_COSINE) -> DataFrame:
    """(file_id, path, license, score, found, from_dir): ``found`` is own, inherited or none.

    ``license`` is an SPDX identifier, or the expression of the file's SPDX tag.
    Null and empty texts have no license of their own; a file with a null path inherits
    nothing. Several license files of a directory: the best score, then the smallest path
    and id, decides. Repeated rows get equal results; other columns are ignored; an empty
    table gives an empty result."""
    rows = stage_table(scan(files, templates, min_cosine), "license-scan")
    name = F.regexp_extract("path", r"[^/]*\z", 0)
    given = rows.where(F.col("own_license").isNotNull() & name.rlike(LICENSE_FILES)).groupBy(
        directory(F.col("path")).alias("up")).agg(
        F.min(F.struct((-F.col("score")).alias("s"), "path", "file_id", "own_license")).alias("b")).select(
        "up", F.col("b.own_license").alias("license"))
    # each directory once, with all directories above it and itself
    dirs = rows.where("path is not null").select(directory(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    nearest = dirs.withColumn("up", F.explode(F.array_distinct(above))).join(given, "up").groupBy("dir").agg(
        F.max(F.struct(F.length("up").alias("n"), "up", "license")).alias("b")).select(
        "dir", F.col("b.license").alias("inherited"), F.col("b.up").alias("from_dir"))
    out = rows.withColumn("dir", directory(F.col("path"))).join(nearest, "dir", "left")
    own = F.col("own_license").isNotNull()
    return out.select(
        "file_id", "path", F.coalesce("own_license", "inherited").alias("license"), "score",
        F.when(own, "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("found"),
        F.when(~own, F.col("from_dir")).alias("from_dir"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of all documents as files. Documents have no paths, so each gets one from
    its source and id: every 40th is a license file of a directory at one of three depths."""
    d, n = read_table(spark, sf_dir, "documents"), F.col("doc_id")
    dirs = [F.coalesce("source", F.lit("none")), F.concat(F.lit("p"), F.floor(n / 64) % 199),
            F.concat(F.lit("m"), F.floor(n / 8) % 8)]
    path = F.when(n % 40 == 0, F.concat_ws("/", F.slice(F.array(*dirs), F.lit(1), (F.floor(n / 40) % 3 + 1).cast("int")),
                                           F.lit("LICENSE"))).otherwise(
        F.concat_ws("/", *dirs, F.concat(F.lit("file"), n, F.lit(".txt"))))
    return licenses(d.select(n.alias("file_id"), path.alias("path"), "text")).withColumnRenamed("file_id", "doc_id")
