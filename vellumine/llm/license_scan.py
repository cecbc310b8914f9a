"""License scan with DataFrame functions alone: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies.

Texts and templates are read as lower-case words of letters and digits, and as shingles of SHINGLE words. A template gives pieces of PIECE shingles, or its first and
last 1, 2, 4, 8 or 16 if it has fewer; a piece of m shingles is looked for in windows of m shingles that begin at every max(1, m / 4). Windows are looked at wherever a shingle of
any template stands; others share no shingle with a template, so nothing is lost. A window and a piece that share 0.6 of their
shingles agree in one of BANDS bands of ROWS minima with probability 0.9992. A template that a window retrieves is verified
on the text around: it is reported if that holds LEAST of the template's distinct shingles, and no related template (one with a shingle in common) more within NEAR shingles.

Templates are a parameter and few: their shingles are constants of the plan, their bands are broadcast.

Cases: null, empty and short texts: no match. Templates of fewer than SHINGLE words are never found. Rows with the same id count as one document; null ids are reported as one.
Very long texts are read whole. Templates that tie at one place are all reported. Empty tables: no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.plans.scratch import Scratch

SHINGLE, PIECE, BANDS, ROWS, LEAST, NEAR = 5, 32, 16, 2, 0.8, 16
#: Beyond the size of any window.
WIDEST = 1 << 16
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation,
either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {} for more details."""
#: Public license notices and short whole licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.""",
    "MIT": "Released under the MIT License.",
    "MIT notice": "Licensed under the MIT License.",
    "MIT text": _MIT,
    "MIT whole": f"{_MIT} {_WARRANTY}",
    "ISC": f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}",
    "0BSD": f"{_ISC}. {_ISC_END}",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "GPL-3.0 notice": _GNU.format("GNU General Public License", "3", "GNU General Public License"),
    "GPL-2.0 notice": _GNU.format("GNU General Public License", "2", "GNU General Public License").replace("software:", "software;"),
    "AGPL-3.0 notice": _GNU.format("GNU Affero General Public License", "3", "GNU Affero General Public License"),
    "AGPL-3.0 preamble": """The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community
in the case of network server software.""",
    "GPL-3.0 preamble": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "LGPL-3.0 notice": _GNU.format("GNU Lesser General Public License", "3", "GNU Lesser General Public License"),
    "LGPL-2.1 notice": _GNU.format("GNU Lesser General Public License", "2.1", "GNU Lesser General Public License"),
    "BSD": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met""",
    "BSD-2-Clause": f"{_BSD_2} {_BSD_END}",
    "BSD-3-Clause": f"{_BSD_2} {_BSD_3} {_BSD_END}",
    "BSD-3-Clause line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-3-Clause notice": "Licensed under the BSD 3-Clause License.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "All rights reserved": "All rights reserved. No part of this publication may be reproduced, distributed or transmitted in any form without prior permission.",
}


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def shingles_of(text: Column) -> Column:
    """Hashes of the shingles in order; fewer words than SHINGLE give none."""
    made = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(SHINGLE))))
    bound = F.transform(F.array(words_of(text)), lambda w: F.when(F.size(w) >= SHINGLE, made(w)).otherwise(F.array().cast("array<bigint>")))
    return bound[0]


def bands_of(window: Column, size: Column) -> Column:
    """A hash for each band of minima, in which the window's size and the band's number count."""
    def lowest(k: int) -> Column:
        return F.array_min(F.transform(window, lambda h: F.xxhash64(h, F.lit(k))))

    least = [lowest(k) for k in range(BANDS * ROWS)]
    return F.array(*(F.xxhash64(size, F.lit(b), *least[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)))


def templates_table(spark: SparkSession, templates: dict[str, str]) -> tuple[DataFrame, list[int], list[int]]:
    """One row for each piece: template, its shingles, the piece's place and bands; the sizes of pieces; all shingles."""
    rows = spark.createDataFrame([(k, v) for k, v in sorted(templates.items())], "template string, body string").select("template", shingles_of(F.col("body")).alias("all")).collect()
    pieces, known, families = [], set(), {}
    for r in rows:  # the first template that it is tied to names a family
        tied = {families[o["template"]] for o in rows if o["template"] in families and set(o["all"]) & set(r["all"])}
        families[r["template"]] = min(tied | {r["template"]})
        families = {t: families[r["template"]] if f in tied else f for t, f in families.items()}
    for r in rows:
        n = len(r["all"])
        known |= set(r["all"])
        m = min(PIECE, 1 << (n.bit_length() - 1)) if n else 1
        for lo in sorted({*range(0, n - m + 1, m), n - m} if m == PIECE else {0, n - m} if n else ()):
            hi = lo + m
            pieces.append((r["template"], families[r["template"]], r["all"], lo, r["all"][lo:hi], hi - lo))
    table = spark.createDataFrame(pieces, "template string, family string, whole array<bigint>, place int, piece array<bigint>, m int")
    table = table.select("template", "family", F.array_distinct("whole").alias("whole"), F.size("whole").alias("long"), "place", F.explode(bands_of(F.col("piece"), F.col("m"))).alias("band")).distinct()
    return table, sorted({p[5] for p in pieces}), sorted(known)


def scan(spark: SparkSession, docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, template, containment and first_word (place of the first window that holds it, in shingles) of each document and template."""
    table, sizes, known = templates_table(spark, TEMPLATES if templates is None else templates)
    empty = spark.createDataFrame([], f"{id_col} long, template string, containment double, first_word int")
    if not known:
        return empty
    scratch = Scratch(spark, "license")
    own = docs.select(F.col(id_col).cast("long").alias("id"), shingles_of(F.col(text_col)).alias("all"))
    at = F.transform("all", lambda h, i: F.when(h.isin(known), i))
    hits = own.select("id", "all", F.filter(at, lambda i: i.isNotNull()).alias("hits")).where(F.size("hits") > 0)
    # only rows with a hit go on, and are few; they are kept so that the scan is not repeated, under a number of their own
    hits = scratch.write(hits.withColumn("row", F.monotonically_increasing_id()), "hits")

    def of_size(p: Column, m: int) -> Column:
        step = max(1, m // 4)
        nth = F.sequence(F.floor(F.greatest(p - m + 1, F.lit(0)) / step), F.floor(p / step))
        return F.transform(nth, lambda q: q.cast("long") * (step * WIDEST) + m)  # start and size as one number: structs would be told apart pair by pair

    def starts(p: Column) -> Column:
        return F.concat(*(of_size(p, m) for m in sizes))

    # bands are made within the row, so that no window takes the whole text along
    spots = F.array_distinct(F.flatten(F.transform("hits", starts)))
    start = lambda w: F.floor(w / WIDEST).cast("int")
    size = lambda w: (w % WIDEST).cast("int")
    banded = F.transform(spots, lambda w: F.struct(start(w).alias("s"), bands_of(F.slice("all", start(w) + 1, size(w)), size(w)).alias("bands")))
    windows = hits.select("row", F.inline(banded)).select("row", "s", F.explode("bands").alias("band"))
    # as many rows as the templates have bands
    found = windows.join(F.broadcast(table.select("band", "template", "place")), "band").select("row", "template", (F.col("s") - F.col("place")).alias("begin"), "s").groupBy("row", "template", "begin").agg(F.min("s").alias("s"))
    whole = table.select("template", "family", "whole", "long").distinct()
    found = found.join(F.broadcast(whole), "template").join(hits.select("row", "id", "all"), "row")
    lo = F.greatest(F.col("begin") - F.floor(F.col("long") / 4).cast("int") - 2, F.lit(0))
    around = F.slice("all", lo + 1, (F.col("long") * 1.5).cast("int") + 4)
    share = F.size(F.array_intersect("whole", around)) / F.size("whole")
    met = found.select("id", "template", "family", share.alias("share"), "s", F.floor(F.col("s") / NEAR).alias("b")).where(F.col("share") >= LEAST).distinct()
    met = scratch.write(met, "met")  # read twice
    # versions of one license share shingles: where several stand, the best does
    around = met.select("id", "family", "share", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"))
    best = around.groupBy("id", "family", "b").agg(F.max("share").alias("top"))
    same = F.col("m.id").eqNullSafe(F.col("n.id")) & (F.col("m.family") == F.col("n.family")) & (F.col("m.b") == F.col("n.b"))
    stay = met.alias("m").join(best.alias("n"), same).where(F.col("share") == F.col("top")).select("m.id", "template", "share", "s")
    return stay.groupBy("id", "template").agg(F.max("share").alias("containment"), F.min("s").alias("first_word")).withColumnRenamed("id", id_col)
