"""Licence scan: sparse TF-IDF cosine of lines and files to templates, then inheritance along paths.

Only terms of the templates carry weight; their document frequencies are counted over all files. A line
or file whose cosine reaches the threshold must hold one of a template's anchor terms: the fewest heavy
terms without which the rest of the template's vector is shorter than the threshold. So lines without
any anchor are passed over without loss. Notices that are wrapped and the openings of whole texts are
sought in runs of words. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patchsieve.llm.common import written

# The usual notices and short licence texts by SPDX id, "header" for notices and "file" for whole texts.
TEMPLATES = [
    ("Apache-2.0", "header", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "header", "Released under the MIT License."),
    ("MIT", "header", "This project is licensed under the MIT License."),
    ("GPL-2.0-only", "header", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "header", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1-only", "header", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0-only", "header", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "header", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-2-Clause", "header", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "header", "Licensed under the BSD 3-Clause License."),
    ("ISC", "header", "Licensed under the ISC License."),
    ("EPL-2.0", "header", "This program is made available under the terms of the Eclipse Public License 2.0."),
    ("CC0-1.0", "header", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("CC-BY-4.0", "header", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "header", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "header", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "header", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "header", "Licensed under CC BY-ND 4.0."),
    ("Unlicense", "header", "This is free and unencumbered software released into the public domain."),
    ("MIT", "file", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")),
    ("ISC", "file", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH "
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR "
        "OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")),
    ("Unlicense", "file", (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.")),
]
# Openings of whole licence texts ("text") and the usual notices of several lines ("notice"), sought in runs of words.
NOTICES = [
    ("Apache-2.0", "text", (
        'Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. '
        '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.')),
    ("Apache-2.0", "notice", (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        'You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed '
        'under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.')),
    ("GPL-2.0-only", "text", (
        'GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. '
        '51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Preamble '
        'The licenses for most software are designed to take away your freedom to share and change it.')),
    ("GPL-3.0-only", "text", (
        'GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. '
        'Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works.')),
    ("LGPL-2.1-only", "text", (
        'GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. '
        'This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1.')),
    ("LGPL-3.0-only", "text", (
        'GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. '
        'This version of the GNU Lesser General Public License incorporates '
        'the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.')),
    ("AGPL-3.0-only", "text", (
        'GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. '
        'Preamble The GNU Affero General Public License is a free, copyleft license '
        'for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.')),
    ("GPL-2.0-or-later", "notice", (
        'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, '
        'either version 2 of the License, or (at your option) any later version.')),
    ("GPL-3.0-or-later", "notice", (
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, '
        'either version 3 of the License, or (at your option) any later version.')),
    ("LGPL-2.1-or-later", "notice", (
        'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, '
        'either version 2.1 of the License, or (at your option) any later version.')),
    ("LGPL-3.0-or-later", "notice", (
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, '
        'either version 3 of the License, or (at your option) any later version.')),
    ("AGPL-3.0-or-later", "notice", (
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, '
        'either version 3 of the License, or (at your option) any later version.')),
    ("GPL-2.0-only", "notice", (
        'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, '
        'version 2 of the License.')),
    ("GPL-3.0-only", "notice", (
        'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, '
        'version 3 of the License.')),
    ("BSD-2-Clause", "text", (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: '
        'Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. '
        'Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. '
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
        'MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, '
        'EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER '
        'CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF '
        'ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.')),
    ("BSD-3-Clause", "text", (
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: '
        'Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. '
        'Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. '
        'Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. '
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
        'MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, '
        'EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER '
        'CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF '
        'ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.')),
    ("MPL-2.0", "text", (
        'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. '
        '1.2. "Contributor Version" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor\'s Contribution.')),
    ("MPL-2.0", "notice", (
        'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, '
        'You can obtain one at https://mozilla.org/MPL/2.0/.')),
    ("EPL-2.0", "text", (
        'Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT"). '
        "ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.")),
    ("EPL-2.0", "notice", (
        'This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/')),
    ("CC0-1.0", "text", (
        'CC0 1.0 Universal Statement of Purpose The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) '
        'upon the creator and subsequent owner(s) (each and all, an "owner") of an original work of authorship and/or a database (each, a "Work").')),
    *((f"CC-BY{short}-4.0", "text", (
        f"Creative Commons Attribution{name} 4.0 International Public License By exercising the Licensed Rights (defined below), You accept and agree to be bound by the "
        f"terms and conditions of this Creative Commons Attribution{name} 4.0 International Public License (\"Public License\"). To the extent this Public License may be "
        "interpreted as a contract, You are granted the Licensed Rights in consideration of Your acceptance of these terms and conditions."))
      for short, name in (("", ""), ("-SA", "-ShareAlike"), ("-NC", "-NonCommercial"), ("-NC-SA", "-NonCommercial-ShareAlike"), ("-ND", "-NoDerivatives"))),
    *(t for t in TEMPLATES if t[1] == "file" or len(t[2].split()) >= 10),
]
THRESHOLD = 0.8
_GAP = "[^a-z0-9]+"


def _terms(text: Column) -> Column:
    """Lower-case runs of letters a to z and digits."""
    return F.array_remove(F.split(F.lower(text), _GAP), "")


def _weighed(rows: DataFrame, keys: list[str], idf: DataFrame) -> DataFrame:
    """(keys, term, weight, norm): 1 + ln tf times idf, of the terms that idf has, and the vector's length."""
    counted = rows.groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    weighed = counted.join(F.broadcast(idf), "term").withColumn("weight", (1 + F.log("tf")) * F.col("idf"))
    norm = weighed.groupBy(*keys).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return weighed.join(norm, keys).select(*keys, "term", "weight", "norm")


def templates(spark, rows=TEMPLATES) -> DataFrame:
    """(template, license, kind, text) as a table of literals."""
    table = F.array(*(F.struct(F.lit(n).alias("template"), *(F.lit(v).alias(c) for v, c in zip(row, ("license", "kind", "text")))) for n, row in enumerate(rows)))
    return spark.range(1).select(F.inline(table))


def frequencies(files: DataFrame, known: DataFrame) -> DataFrame:
    """(term, idf) of every term of the templates, counted over all files (text)."""
    vocabulary = known.select(F.explode(_terms(F.col("text"))).alias("term")).distinct()
    # a few hundred terms of the templates, in one row
    all_terms = vocabulary.agg(F.sort_array(F.collect_set("term")).alias("vocabulary"))
    held = files.crossJoin(F.broadcast(all_terms)).select(F.explode(F.array_intersect(_terms(F.col("text")), "vocabulary")).alias("term"))
    total = files.agg(F.count("*").alias("files"))
    frequency = vocabulary.join(held.groupBy("term").agg(F.count("*").alias("df")), "term", "left")
    return written(frequency.crossJoin(F.broadcast(total)).select(
        "term", F.log(1 + F.col("files") / (1 + F.coalesce("df", F.lit(0)))).alias("idf")), "idf")


def _anchored(vectors: DataFrame, threshold: float) -> DataFrame:
    """The heaviest terms of each template, without which the rest stays below the threshold."""
    down = Window.partitionBy("template").orderBy("weight", F.desc("term"))
    rest = F.sum(F.col("weight") * F.col("weight")).over(down.rowsBetween(Window.unboundedPreceding, 0))
    return vectors.withColumn("rest", F.sqrt(rest)).where(F.col("rest") >= (threshold - 1e-9) * F.col("norm"))


def matches(files: DataFrame, known: DataFrame, threshold: float = THRESHOLD, idf: DataFrame | None = None) -> DataFrame:
    """(row, license, kind, score, line): the best template of every file (row, text) that reaches the threshold.

    Equal rows have equal texts and give one result.
    Every line is compared with the header templates and every whole text with the file templates; line is -1
    for a whole text. Ties go to the first template, then the first line.
    """
    words = known.select("template", "license", "kind", F.explode(_terms(F.col("text"))).alias("term"))
    vocabulary = known.select(F.explode(_terms(F.col("text"))).alias("term")).distinct()
    all_terms = vocabulary.agg(F.sort_array(F.collect_set("term")).alias("vocabulary"))
    idf = frequencies(files, known) if idf is None else idf
    vectors = written(_weighed(words, ["template", "license", "kind"], idf), "templates")

    anchors = _anchored(vectors, threshold).agg(F.sort_array(F.collect_set(F.when(F.col("kind") == "header", F.col("term")))).alias("line_anchors"),
                          F.sort_array(F.collect_set(F.when(F.col("kind") == "file", F.col("term")))).alias("file_anchors"))
    known_terms = F.broadcast(all_terms.crossJoin(anchors))  # one row

    lines = files.select("row", F.posexplode(F.split("text", "\n")).alias("line", "part")).crossJoin(known_terms)
    lines = lines.withColumn("terms", _terms(F.col("part"))).where(F.arrays_overlap("terms", "line_anchors"))
    whole = files.select("row", F.lit(-1).alias("line"), "text").crossJoin(known_terms).withColumn("terms", _terms(F.col("text")))
    whole = whole.where(F.arrays_overlap("terms", "file_anchors"))
    units = lines.select("row", "line", "terms", "vocabulary").unionAll(whole.select("row", "line", "terms", "vocabulary"))
    units = units.dropDuplicates(["row", "line"])
    # terms counted where they stand: a repeated term is one row with its count
    inside = units.select("row", "line", F.explode(F.filter("terms", lambda t: F.array_contains("vocabulary", t))).alias("term"))
    found = _weighed(inside, ["row", "line"], idf)
    dots = found.join(F.broadcast(vectors.select(
        "template", "license", "kind", "term", F.col("weight").alias("t_weight"), F.col("norm").alias("t_norm"))), "term")
    dots = dots.where((F.col("line") < 0) == (F.col("kind") == "file"))
    scores = dots.groupBy("row", "line", "template", "license", "kind").agg(
        F.least(F.lit(1.0), F.sum(F.col("weight") * F.col("t_weight") / (F.col("norm") * F.col("t_norm")))).alias("score"))
    reached = scores.where(F.col("score") >= threshold)
    best = reached.groupBy("row").agg(F.max_by(F.struct("license", "kind", "score", "line"), F.struct(
        F.round("score", 9).alias("score"), F.negative("template").alias("t"), F.negative("line").alias("l"))).alias("best"))
    return best.select("row", "best.*")


def block_matches(files: DataFrame, known: DataFrame, idf: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(row, license, kind, score, whole): the best template of every file among runs of as many words as the template has.

    Line ends and comment signs do not matter, nor what stands before or after. Runs start at every eighth of
    the template's length. Files and stretches without enough of a template's weight to reach the threshold
    are passed over without loss. `whole` tells the opening of a licence text (kind "file") from a notice.
    """
    words = known.select("template", "license", "kind", F.explode(_terms(F.col("text"))).alias("term"))
    length = words.groupBy("template").agg(F.count("*").cast("int").alias("length"))
    vectors = written(_weighed(words, ["template", "license", "kind"], idf).join(length, "template"), "notices")
    anchors = _anchored(vectors, threshold).groupBy("template").agg(F.collect_set("term").alias("anchors"))
    per = vectors.groupBy("template", "license", "kind", "length", "norm").agg(
        F.collect_list("term").alias("own"), F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("weights")).join(anchors, "template")
    # a few dozen rows, and one row of a few hundred terms
    per = F.broadcast(written(per, "notice_vectors"))
    mine = idf.join(vectors.select("term").distinct(), "term")
    any_anchor = anchors.select(F.explode("anchors").alias("a")).agg(F.collect_set("a").alias("any_anchor"))
    one = F.broadcast(mine.agg(F.collect_list("term").alias("vocabulary"), F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("idf")).crossJoin(any_anchor))

    # at most this share of the template's squared weight can meet, by Cauchy and Schwarz
    square = lambda terms: F.aggregate(
        F.array_intersect(terms, F.col("own")), F.lit(0.0), lambda a, t: a + F.col("weights")[t] * F.col("weights")[t])
    enough = lambda terms: square(terms) >= (threshold * threshold - 1e-9) * F.col("norm") * F.col("norm")
    held = files.select("row", _terms(F.col("text")).alias("terms")).crossJoin(one).where(F.arrays_overlap("terms", "any_anchor"))
    held = held.select("row", "terms", F.array_intersect("terms", "vocabulary").alias("present"))
    pairs = held.crossJoin(per).where(F.arrays_overlap("present", "anchors")).where(enough(F.col("present")))
    # stretches of twice the length hold every run
    stretch = F.transform(F.sequence(F.lit(1), F.size("terms"), F.col("length")), lambda at: F.slice("terms", at, 2 * F.col("length")))
    about = ["row", "template", "license", "kind", "length", "norm", "own", "weights"]
    parts = pairs.select(*about, F.explode(stretch).alias("part")).where(enough(F.col("part")))
    step = F.greatest(F.lit(1), F.floor(F.col("length") / 8).cast("int"))
    last = F.greatest(F.lit(1), F.least(F.col("length"), F.size("part") - F.col("length") + 1))
    starts = F.array_union(F.sequence(F.lit(1), last, step), F.array(last))
    runs = parts.select(*about, F.explode(F.transform(starts, lambda at: F.slice("part", at, F.col("length")))).alias("run")).where(enough(F.col("run")))
    runs = runs.crossJoin(one).withColumn("run", F.filter("run", lambda t: F.array_contains("vocabulary", t)))
    counted = F.transform(F.array_distinct("run"), lambda t: F.struct(
        t.alias("term"), ((1 + F.log(F.size(F.filter("run", lambda u: u == t)))) * F.col("idf")[t]).alias("weight")))
    runs = runs.withColumn("counted", counted)
    dot = F.aggregate("counted", F.lit(0.0), lambda a, x: a + x["weight"] * F.coalesce(F.col("weights")[x["term"]], F.lit(0.0)))
    long = F.sqrt(F.aggregate("counted", F.lit(0.0), lambda a, x: a + x["weight"] * x["weight"]))
    scores = runs.select("row", "template", "license", "kind", F.least(F.lit(1.0), dot / F.nullif(long * F.col("norm"), F.lit(0.0))).alias("score")).where(F.col("score") >= threshold)
    whole = F.col("kind") == "text"
    best = scores.groupBy("row").agg(F.max_by(
        F.struct("license", F.when(whole, "file").otherwise("header").alias("kind"), "score", whole.alias("whole")),
        F.struct(whole.alias("whole"), F.round("score", 9).alias("score"), F.negative("template").alias("t"))).alias("best"))
    return best.select("row", "best.*")


def _directory(path: Column) -> Column:
    """The path without its last part; empty for the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def _is_licence_file(path: Column) -> Column:
    name = F.lower(F.regexp_extract(path, "[^/]*$", 0))
    return name.rlike(r"^(licen[cs]e|copying|unlicense|notice)([.-].*)?$")


def license_scan(
    files: DataFrame, known: DataFrame | None = None, threshold: float = THRESHOLD, notices: DataFrame | None = None,
) -> DataFrame:
    """(path, license, score, origin, from_path, and the other columns of `files`) per row of `files` (path, text).

    A file's own licence is that of its best line or run of words (origin "header") or whole text ("file"); the
    opening of a whole licence text comes before both. A file without one
    takes that of the nearest directory above it that holds a licence file with a licence ("inherited",
    score of that file); of several in one directory, of that with the first path. Else license is null and
    origin "none". Null texts have no licence, null paths inherit nothing; rows may repeat. Columns named like
    the results are replaced.
    """
    kept = [c for c in files.columns if c not in {"path", "text", "license", "score", "origin", "from_path"}]
    other = F.struct(F.lit(0).alias("none"), *(F.col(c).alias(f"c{n}") for n, c in enumerate(kept))).alias("other")
    known = templates(files.sparkSession) if known is None else known
    notices = templates(files.sparkSession, NOTICES) if notices is None else notices
    path = F.col("path").cast("string")
    # rows that are equal in path and text have one result
    keyed = files.select(other, path.alias("path"), "text", F.md5(F.concat_ws("\n", F.coalesce(path, F.lit("")), "text").cast("binary")).alias("row"))
    texts = keyed.select("row", "text").where("text IS NOT NULL")
    idf = frequencies(texts, known.unionByName(notices))
    lines = matches(texts, known, threshold, idf)
    blocks = block_matches(texts, notices, idf, threshold).select("row", *(F.col(c).alias(f"b_{c}") for c in ("license", "kind", "score", "whole")))
    block = F.col("license").isNull() | F.coalesce("b_whole", F.lit(False)) | (F.round("b_score", 9) > F.round("score", 9))
    own = lines.join(blocks, "row", "full").select("row", *(
        F.when(block & F.col("b_license").isNotNull(), F.col(f"b_{c}")).otherwise(F.col(c)).alias(c) for c in ("license", "kind", "score")))
    scanned = written(keyed.drop("text").join(own, "row", "left"), "scanned")

    licensed = scanned.where(F.col("license").isNotNull() & F.col("path").isNotNull() & _is_licence_file(F.col("path")))
    by_directory = licensed.groupBy(_directory(F.col("path")).alias("above")).agg(
        F.min(F.struct("path", "license", "score")).alias("given"))
    # every directory with files is looked up once, at itself and all directories above
    directories = scanned.where(F.col("license").isNull() & F.col("path").isNotNull()).select(_directory(F.col("path")).alias("directory")).distinct()
    parts = F.split("directory", "/")
    above = directories.select("directory", F.explode(F.when(F.col("directory") == "", F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), F.size(parts)))).alias("depth")).withColumn(
        "above", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    nearest = above.join(by_directory, "above").groupBy("directory").agg(F.max_by("given", "depth").alias("given"))
    placed = scanned.withColumn("directory", F.when(F.col("license").isNull() & F.col("path").isNotNull(), _directory(F.col("path"))))
    out = placed.join(nearest, "directory", "left")
    taken = F.col("license").isNull() & F.col("given").isNotNull()
    return out.select(
        *(F.col(f"other.c{n}").alias(c) for n, c in enumerate(kept)), "path", F.coalesce("license", "given.license").alias("license"), F.coalesce("score", "given.score").alias("score"),
        F.when(F.col("license").isNotNull(), F.col("kind")).when(taken, F.lit("inherited")).otherwise(F.lit("none")).alias("origin"),
        F.when(taken, F.col("given.path")).alias("from_path"))
