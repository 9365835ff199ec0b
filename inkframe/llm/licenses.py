"""Licence scans: TF-IDF cosine to templates, then inheritance along directories, with DataFrame functions alone.

Every line that has a word of licensing (licen[cs]e, licensed, copyright, spdx, released under) is a header, wherever it
stands in its file; a file named as a licence (LICENSE, COPYING, NOTICE, UNLICENSE) is compared as a whole, too. Headers,
such files and templates become sparse vectors of words, weighted by counts and by inverse document frequency over all
of them in the corpus and the templates; the template with the greatest cosine of at least the threshold names the
licence, if no other licence comes as near but for the margin. A file has the licences of its headers. Files whose
headers are at least half of their lines, and those named as a licence, are licence files of their directory; a file
without any licence takes that of the nearest directory above it that has one, by equi-joins of its ancestor paths.

The texts are read once for headers, which are written to the shared folder, and once for the result. The templates are a
list of fixed size. Null and empty texts have no headers; long texts are read whole; two licences as near as each other give
none, licence files of one directory as near as each other the one first by name; a file without a directory stands in the
root; repeated rows are judged alike; an empty table gives no rows; columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, spread_join, without

# Notices, identifiers and short texts by licence.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD3 = BSD2.replace("THIS SOFTWARE IS", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE IS", 1)
TEMPLATES = [
    ("MIT", MIT),
    ("MIT", MIT.split("\n")[0]),
    ("ISC", ISC),
    ("ISC", ISC.split("\n")[0]),
    ("BSD-2-Clause", BSD2),
    ("BSD-3-Clause", BSD3),
    *[(x, f"SPDX-License-Identifier: {x}") for x in ("Apache-2.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "Unlicense", "EPL-2.0", "CC0-1.0", "0BSD", "Zlib", "BSL-1.0")],
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, under the MIT License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    # titles of full texts, and notices of several lines
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007"),
    ("Apache-2.0", "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    *[
        (name, f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.")
        for name, kind, version in (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3"))
    ],
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
]
LICENCE_FILE = r"(?i)(^|/)(un)?(licen[cs]e|copying|notice)(\.[a-z]{1,4})?$"
HEADER = r"(?i)\blicen[cs]e[sd]?\b|\bcopyright\b|\bspdx\b|\breleased under\b|\bpermission is hereby\b|\bfree software\b"
OUTPUTS = ["path", "n_lines", "n_headers", "license", "similarity", "inherited_from"]


def words_of(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), r"[^\p{L}\p{N}.+]+"), lambda w: F.trim(F.translate(w, ".", " ")) != "")


def _plain(words: Column) -> Column:
    return F.transform(words, lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))


def directories(path: Column) -> Column:
    """The path's directories, nearest first, ending with the root."""
    parts = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.transform(F.reverse(F.sequence(F.lit(0), F.size(parts))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def runs(lines: Column, mark: Callable[[Column], Column]) -> Column:
    """The runs of lines that mark takes, each as one text; linear in the lines."""
    kept = F.transform(lines, lambda x: F.when(mark(x), F.translate(x, "\0", " ")).otherwise("\0"))
    return F.filter(F.split(F.array_join(kept, "\n"), r"\n?\x00\n?"), lambda x: x != "")


def units(lines: Column, whole: Column, together: bool) -> Column:
    """The texts to compare with templates, as (at, lead, line): heads by themselves, in runs that lead them, or, for a file
    named as a licence, in the order in which they name it."""
    unit = lambda at, lead, line: F.struct(at.cast("int").alias("at"), F.lit(lead).alias("lead"), line.alias("line"))
    head = lambda x: x.rlike(HEADER)
    alone = lambda at: F.transform(F.filter(lines, head), lambda x: unit(F.lit(at), False, x))
    if not together:
        return F.when(whole.isNull(), alone(0)).otherwise(F.concat(alone(0), F.array(unit(F.lit(0), False, whole))))
    paragraphs = F.transform(F.filter(runs(lines, lambda x: x.rlike(r"[\p{L}\p{N}]")), lambda x: x.contains("\n")), lambda x, i: unit(i + 1, False, x))
    named = F.concat(F.array(unit(F.lit(0), False, whole)), paragraphs, alone(2**31 - 1))
    led = F.transform(runs(lines, head), lambda x, i: F.concat(F.when(x.contains("\n"), F.array(unit(i, True, x))).otherwise(F.slice(F.array(unit(i, True, x)), 1, 0)), F.transform(F.split(x, "\n"), lambda y: unit(i, False, y))))
    return F.when(whole.isNull(), F.flatten(led)).otherwise(named)


def cosines(heads: DataFrame, threshold: float, margin: float) -> DataFrame:
    """(line, license, similarity) of the distinct texts in column line that have a licence."""
    spark = heads.sparkSession
    templates = spark.createDataFrame(TEMPLATES, "license string, line string").withColumn("template", F.xxhash64("line"))
    lines = heads.groupBy("line").agg(F.count("*").alias("files"))
    all_lines = lines.unionByName(templates.select("line", F.lit(1).cast("long").alias("files")))
    counts = all_lines.select("line", "files", F.explode(_plain(words_of(F.col("line")))).alias("word")).groupBy("line", "word").agg(F.count("*").alias("tf"), F.max("files").alias("files"))
    total = all_lines.agg(F.sum("files").alias("total"))
    # one row
    idf = counts.groupBy("word").agg(F.sum("files").alias("df")).join(F.broadcast(total)).select("word", (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    weighted = counts.join(idf, "word").select("line", "word", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weighted.groupBy("line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = weighted.join(norms, "line").select("line", "word", (F.col("w") / F.col("norm")).alias("w"))
    known = F.broadcast(unit.join(F.broadcast(templates), "line").select("word", F.col("w").alias("tw"), "license", "template"))
    near = unit.join(known, "word").groupBy("line", "license", "template").agg(F.round(F.sum(F.col("w") * F.col("tw")), 6).alias("cosine")).where(F.col("cosine") >= threshold)
    each = near.groupBy("line", "license").agg(F.max("cosine").alias("cosine"))
    ranked = each.groupBy("line").agg(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "license"))).alias("r"))
    second = F.coalesce(-F.get("r", F.lit(1))["c"], F.lit(-1.0))
    return ranked.where(-F.col("r")[0]["c"] - second > margin).select("line", F.col("r")[0]["license"].alias("license"), (-F.col("r")[0]["c"]).alias("similarity"))


def scan(df: DataFrame, path: Column, threshold: float = 0.6, margin: float = 0.01, text_col: str = "text", together: bool = False) -> DataFrame:
    """Adds path, n_lines, n_headers, license, similarity and inherited_from (a directory; null for a file's own).

    With together, lines that follow each other are also compared as one text: runs of headers in any file, paragraphs
    (runs of lines with a letter or digit) in files named as a licence. A run with a licence stands for its lines. A file
    named as a licence then has one licence, that of its whole text, or else of the first of its paragraphs, or else of its
    headers, that has one; so a licence's text that speaks of other licences keeps its own name.
    """
    scratch = Scratch(df.sparkSession)
    base = without(df, [c for c in OUTPUTS if c != text_col] + ["_row", "_heads"])
    files = base.withColumn("path", path).withColumn("_row", F.xxhash64("path", text_col))
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    named = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False)) & (F.length(text_col) > 0)
    whole = F.when(named, F.col(text_col))
    read = files.select("_row", "path", units(lines, whole, together).alias("units"), F.size(F.filter(lines, lambda x: x.rlike(HEADER))).cast("long").alias("n_headers"), named.alias("named"), F.when(F.length(text_col) > 0, F.size(lines)).otherwise(0).cast("long").alias("n_lines"))
    # repeated rows have one key
    judged = scratch.cut(read.dropDuplicates(["_row"]))
    heads = judged.where(F.size("units") > 0).select("_row", (F.col("named") & F.lit(together)).alias("one"), F.inline("units"))
    best = scratch.cut(cosines(heads, threshold, margin))
    times = heads.groupBy("line").agg(F.count("*").alias("times"))
    known = spread_join(heads, best.join(times, "line"), ["line"])
    # a run with a licence stands for its lines
    by_run = known.groupBy("_row", "one", "at").agg(F.max(F.when(F.col("lead"), F.struct("license", "similarity"))).alias("led"), F.collect_set("license").alias("all"), F.max("similarity").alias("most"), F.max(F.struct("similarity", "license")).alias("top"))
    by_run = by_run.select("_row", "one", "at", F.when(F.col("led").isNull(), F.col("all")).otherwise(F.array("led.license")).alias("all"), F.coalesce("led.similarity", "most").alias("most"), "top")
    by_row = by_run.groupBy("_row", "one").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("all")))), " AND ").alias("all"), F.max("most").alias("most"), F.min_by("top", "at").alias("top"))
    own = by_row.select("_row", F.when(F.col("one"), F.col("top.license")).otherwise(F.col("all")).alias("own"), F.when(F.col("one"), F.col("top.similarity")).otherwise(F.col("most")).alias("sim"))
    placed = scratch.cut(judged.join(own, "_row", "left").select("_row", F.element_at(directories(F.col("path")), 1).alias("home"), "n_lines", "n_headers", "named", "own", "sim"))
    in_dir = placed.where(F.col("own").isNotNull() & (F.col("named") | (2 * F.col("n_headers") >= F.col("n_lines"))))
    dirs = in_dir.groupBy(F.col("home").alias("dir")).agg(F.min(F.struct((-F.col("sim")).alias("s"), "own")).alias("d")).select("dir", F.col("d.own").alias("lic"), (-F.col("d.s")).alias("up_sim"))
    homes = placed.where(F.col("own").isNull()).groupBy("home").agg(F.count("*").alias("times"))
    above = homes.select("home", "times", F.posexplode(directories(F.concat("home", F.lit("/x")))).alias("up", "dir")).where((F.col("home") != "") | (F.col("dir") == ""))
    nearest = above.join(dirs, "dir").groupBy("home").agg(F.min(F.struct("up", "dir", "lic", "up_sim")).alias("n"), F.max("times").alias("times")).select("home", "times", "n.dir", "n.lic", "n.up_sim")
    inherited = spread_join(placed.where(F.col("own").isNull()).select("_row", "home"), scratch.cut(nearest), ["home"])
    found = placed.join(inherited.drop("home"), "_row", "left").select(
        "_row", "n_lines", "n_headers", F.coalesce("own", "lic").alias("license"), F.coalesce("sim", "up_sim").alias("similarity"), F.when(F.col("own").isNull(), F.col("dir")).alias("inherited_from"),
    )
    return files.join(found, "_row").select(*[F.col(f"`{c}`") for c in base.columns], "path", "n_lines", "n_headers", "license", "similarity", "inherited_from")
