import math
import re
from collections import Counter

from corpus import documents, none
from pyspark.sql import functions as F

from patchsieve.llm.licenses import TEMPLATES, THRESHOLD, license_scan
from patchsieve.llm.queries import files_of

FILES = "path string, text string, line int, kind string, row string, given int, license string"


def terms(text):
    return [t for t in re.split("[^a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if t]


def brute(rows):
    """Best template of every text, comparing every line and text with every template."""
    vocabulary = {t for _, _, text in TEMPLATES for t in terms(text)}
    df = Counter(t for _, text in rows if text is not None for t in set(terms(text)) & vocabulary)
    n = sum(text is not None for _, text in rows)

    def vector(text):
        tf = Counter(t for t in terms(text) if t in vocabulary)
        v = {t: (1 + math.log(c)) * math.log(1 + n / (1 + df[t])) for t, c in tf.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    known = [(k, name, kind, vector(text)) for k, (name, kind, text) in enumerate(TEMPLATES)]
    out = {}
    for path, text in rows:
        best = None
        units = [(-1, "file", text)] + [(k, "header", x) for k, x in enumerate(text.split("\n"))] if text is not None else []
        for line, wanted, part in units:
            v = vector(part)
            for k, name, kind, t in known:
                score = sum(x * t.get(w, 0) for w, x in v.items())
                if kind == wanted and score >= THRESHOLD and (best is None or (round(score, 9), -k, -line) > best[0]):
                    best = ((round(score, 9), -k, -line), name, kind)
        out[path] = best and (best[1], best[2], best[0][0])
    return out


def test_whole_table_against_all_templates(spark):
    files = files_of(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    want = brute([(r.path, r.text) for r in files.collect()])
    got = {r.path: (r.license, r.origin, round(r.score, 9)) if r.origin in ("header", "file") else None for r in license_scan(files).collect()}
    assert {k: v and v[:2] for k, v in got.items()} == {k: v and v[:2] for k, v in want.items()}
    assert all(abs(got[k][2] - v[2]) < 1e-6 for k, v in want.items() if v) and any(want.values())


def test_nearest_directory(spark):
    mit, gpl = TEMPLATES[21][2], "This work is licensed under the GNU General Public License, version 3."
    rows = [
        ("LICENSE", mit), ("a/b/COPYING", gpl), ("a/b/c/x.py", "code"), ("a/y.py", "code\nReleased under the MIT License.\nmore"), ("a/z.py", None), ("top.py", ""),
        ("a/b/LICENSE.md", "no such words"), ("a/bc/q.py", "code"), (None, "code"), (None, gpl), ("a/b/c/x.py", "code"), ("/abs/x", "code"), ("a//w", "code")]
    df = spark.createDataFrame([(*r, 1, "k", "r", 2, "old") for r in rows], FILES)
    got = license_scan(df)
    assert set(got.columns) == {"path", "license", "score", "origin", "from_path", "line", "kind", "row", "given"}
    found = sorted(((r.path, r.license, r.origin, r.from_path) for r in got.collect()), key=str)
    assert found == sorted([
        ("LICENSE", "MIT", "file", None), ("a/b/COPYING", "GPL-3.0-only", "header", None), ("a/b/c/x.py", "GPL-3.0-only", "inherited", "a/b/COPYING"),
        ("a/y.py", "MIT", "header", None), ("a/z.py", "MIT", "inherited", "LICENSE"), ("top.py", "MIT", "inherited", "LICENSE"),
        ("a/b/LICENSE.md", "GPL-3.0-only", "inherited", "a/b/COPYING"), ("a/bc/q.py", "MIT", "inherited", "LICENSE"), (None, None, "none", None),
        (None, "GPL-3.0-only", "header", None), ("a/b/c/x.py", "GPL-3.0-only", "inherited", "a/b/COPYING"), ("/abs/x", "MIT", "inherited", "LICENSE"),
        ("a//w", "MIT", "inherited", "LICENSE")], key=str)


def test_cases(spark):
    docs = documents(spark)
    got = license_scan(docs.withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string"))))
    assert got.count() == docs.count() and [r.license for r in got.where("doc_id = -5").collect()] == ["MIT"]
    assert license_scan(files_of(none(spark))).count() == 0


GPL = """/* frob.c
 * Copyright 2020 A. Author
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version {} of the License, or
 * (at your option) any later version.
 */
"""
BSD = """Copyright (c) 2019, A. Author
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL_TEXT = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.
"""


def test_wrapped_notices_and_whole_texts(spark):
    code = "\n".join(f"int f{n}(use, copy, of, the, software) {{ return any; }}" for n in range(400))
    mit = TEMPLATES[21][2]
    mit = "".join(f"// {line}\n" for line in re.findall(r".{1,70}(?: |$)", mit))
    rows = [
        ("a/x.c", GPL.format(3) + code), ("b/y.c", GPL.format(2) + code), ("c/LICENSE", BSD.format("")), ("d/LICENSE", BSD.format(THIRD)), ("d/z.c", code),
        ("e/m.c", code + "\n" + mit + code), ("f/COPYING", GPL_TEXT + "words of the text\n" * 300 + GPL.format(3)), ("g/n.c", code), ("h/t.c", "the use of the License"),
        ("i/w.c", "# This Source Code Form is subject to the terms of the Mozilla\n# Public License, v. 2.0. If a copy of the MPL was not distributed with this\n"
                  "# file, You can obtain one at https://mozilla.org/MPL/2.0/.\n" + code)]
    got = {r.path: (r.license, r.origin) for r in license_scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {
        "a/x.c": ("GPL-3.0-or-later", "header"), "b/y.c": ("GPL-2.0-or-later", "header"), "c/LICENSE": ("BSD-2-Clause", "file"),
        "d/LICENSE": ("BSD-3-Clause", "file"), "d/z.c": ("BSD-3-Clause", "inherited"), "e/m.c": ("MIT", "header"), "f/COPYING": ("GPL-3.0-only", "file"),
        "g/n.c": (None, "none"), "h/t.c": (None, "none"), "i/w.c": ("MPL-2.0", "header")}
