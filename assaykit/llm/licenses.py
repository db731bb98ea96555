"""License scans: sparse TF-IDF cosine to templates, then inheritance along directories.

Two kinds of text are compared with templates of their kind. Header blocks, the longest runs of
lines or sentences that all hold a licensing word, meet the usual notices; whole files that hold a
licensing word meet whole licences. Terms weigh by their document frequency over all files, which
is counted where the texts are, summed by a shuffle, and joined with the terms of what is compared;
scalar products and lengths are sums over those joins. Files that are like a whole licence, or have
the name of a licence file, declare their directory's licence; else its headers do, if one licence
has most. A file without its own takes that of its nearest ancestor directory, found by joining the
distinct directories' ancestors with the declaring ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import Tables, map_texts, slices

# SPDX identifiers, the standard notices, and the whole text of licences that are short.
NOTICES = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Licensed under the MIT license. See the LICENSE file in the project root for license information.",
        "SPDX-License-Identifier: MIT",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU
        General Public License along with this program. If not, see http://www.gnu.org/licenses/.""",
    ),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
        as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.""",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "MPL-2.0": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY-4.0": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-NC-4.0": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
}
DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
    BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
    COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
    BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
    AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
    OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
    are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
    documentation and/or other materials provided with the distribution."""
WHOLE = {
    "MIT": (
        """MIT License. Copyright (c). Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN
        AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
        THE SOFTWARE.""",
    ),
    "ISC": (
        """ISC License. Copyright (c). Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
        "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
        RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR
        IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    "BSD-2-Clause": (f"BSD 2-Clause License. Copyright (c). {CLAUSES} {DISCLAIMER}",),
    "BSD-3-Clause": (
        f"""BSD 3-Clause License. Copyright (c). {CLAUSES} Neither the name of the copyright holder nor the names of its contributors may be
        used to endorse or promote products derived from this software without specific prior written permission. {DISCLAIMER}""",
    ),
    "Unlicense": (
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
        or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and
        by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
        interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of
        our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future
        rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
        FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    "Zlib": (
        """zlib License. Copyright (c). This software is provided 'as-is', without any express or implied warranty. In no event will the authors
        be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
        purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The
        origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software
        in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must
        be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered
        from any source distribution.""",
    ),
}
CUE = re.compile(r"(?i)licen[cs]|copyright|permission|permitted|redistribut|warrant|liab|free software|public domain|spdx|\bas is\b")
SENTENCE = re.compile(r"[^\n]+?(?:[.;](?=\s|$)|(?=\n)|$)")
TERM = re.compile(r"[a-z0-9]+")
#: Least cosines of header blocks and of whole files, and the share of a directory's headers that one licence must exceed.
LEAST_HEADER, LEAST_FILE, MOST = 0.6, 0.75, 0.5
NAMES = re.compile(r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$")
HEADER, FILE = 0, 1


def terms(text: str) -> Counter:
    return Counter(TERM.findall(text.lower()))


def frequencies(text: str):
    """Partial document frequencies: a row for each term of every slice of a batch, and "" for the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                count = Counter({"": len(batch)})
                for x in batch.column(0).to_pylist():
                    count.update(set(TERM.findall((x or "").lower())))
                yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), pa.array(count.values(), pa.int64())], names=["t", "df"])

    return run


def blocks(text: str) -> Iterator[str]:
    """Longest runs of sentences that all hold a licensing word."""
    run: list[str] = []
    for m in SENTENCE.finditer(text):
        if CUE.search(m[0]):
            run.append(m[0])
        elif run and m[0].strip():
            yield " ".join(run)
            run = []
    if run:
        yield " ".join(run)


def unit_worker() -> Callable[[list[str]], dict[str, list]]:
    """Term counts of every header block and, as the last unit, of the whole file; null without a licensing word."""

    def one(text: str) -> list | None:
        if not CUE.search(text):
            return None
        units = [(HEADER, terms(x)) for x in blocks(text)] + [(FILE, terms(text))]
        return [{"kind": k, "terms": [{"t": t, "n": n} for t, n in c.items()]} for k, c in units if c]

    return lambda texts: {"_units": list(map(one, texts))}


def templates(spark) -> DataFrame:
    """(kind, license, template, t, m): the terms of all templates."""
    rows, k = [], 0
    for kind, of in ((HEADER, NOTICES), (FILE, WHOLE)):
        for name, texts in of.items():
            for text in texts:
                rows += [(kind, name, k, t, n) for t, n in terms(text).items()]
                k += 1
    return spark.createDataFrame(rows, "kind int, license string, template int, t string, m long")


def cosines(units: DataFrame, df: DataFrame, files: int) -> DataFrame:
    """The best template of each unit: (id, unit, kind, license, score) of units (id, unit, kind, t, n), with df (t, df)."""
    idf = (F.log((1 + files) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf")
    known = units.join(df, "t", "left").select("id", "unit", "kind", "t", "n", idf)
    own = templates(units.sparkSession).join(df, "t", "left").select("kind", "license", "template", "t", "m", idf)
    length = lambda d, n, *by: d.groupBy(*by).agg(F.sqrt(F.sum((F.col(n) * F.col("idf")) ** 2)).alias("_" + n))
    product = known.join(F.broadcast(own.drop("idf")), ["kind", "t"]).groupBy("id", "unit", "kind", "license", "template").agg(F.sum(F.col("n") * F.col("m") * F.col("idf") ** 2).alias("p"))
    both = product.join(length(known, "n", "id", "unit"), ["id", "unit"]).join(F.broadcast(length(own, "m", "template")), "template")
    # scores are rounded before they are compared, as the order of a sum is not fixed; equal ones go to the first licence by name
    score = F.round(F.col("p") / (F.col("_n") * F.col("_m")), 9)
    best = both.groupBy("id", "unit", "kind").agg(F.min(F.struct((-score).alias("s"), "license")).alias("x"))
    return best.select("id", "unit", "kind", "x.license", (-F.col("x.s")).alias("score"))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(df: DataFrame, path: Column, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add path, own_license, score, is_license_file, license, inherited_from (a directory) and depth (levels up).

    ``path`` gives each row's path with / between directories; the root is the empty string. Null
    texts have no licence of their own; a null path is the root's. Repeated rows count as files
    of their own. A file's own licence is that of its whole text if that is like a whole licence,
    else that of its best header block. Ties go to the first licence by name. An empty table stays
    empty. Input columns with the names of added ones are replaced. Texts of any length are read whole.
    """
    tables = Tables(df.sparkSession)
    added = ["path", "own_license", "score", "is_license_file", "license", "inherited_from", "depth"]
    stay = [c for c in (df.columns if keep is None else keep) if c not in added]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in stay]).alias("_row"), F.coalesce(path, F.lit("")).alias("path"), F.col(f"`{text}`").alias("_text"))
    counted = rows.select("_text").mapInArrow(frequencies("_text"), "t string, df long").groupBy("t").agg(F.sum("df").alias("df"))
    units = "array<struct<kind:int,terms:array<struct<t:string,n:bigint>>>>"
    made = map_texts(rows, "_text", f"_units {units}", unit_worker, keep=["_row", "path"])
    table = tables.save(made.withColumn("_dir", parent(F.col("path"))).withColumn("_id", F.monotonically_increasing_id()), "licenses")
    posted = table.where("_units is not null").select(F.col("_id").alias("id"), F.posexplode("_units").alias("unit", "u"))
    posted = tables.save(posted.select("id", "unit", "u.kind", F.explode("u.terms").alias("x")).select("id", "unit", "kind", "x.t", "x.n"), "license-terms")
    # only the frequencies of terms that are compared go on
    wanted = posted.select("t").unionAll(templates(df.sparkSession).select("t")).unionAll(df.sparkSession.createDataFrame([("",)], "t string")).distinct()
    known = tables.save(counted.join(wanted, "t", "left_semi"), "license-frequencies")
    files = known.where("t = ''").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    best = cosines(posted, known, files).where(F.col("score") >= F.when(F.col("kind") == FILE, LEAST_FILE).otherwise(LEAST_HEADER))
    own = best.groupBy("id").agg(F.min(F.struct((-F.col("kind")).alias("k"), (-F.col("score")).alias("s"), "license")).alias("x"))
    own = tables.save(own.select("id", F.col("x.license").alias("own_license"), (-F.col("x.s")).alias("score"), (F.col("x.k") == -FILE).alias("_whole")), "license-own")
    table = table.drop("_units").join(own, F.col("_id") == F.col("id"), "left").drop("id", "_id")
    table = table.withColumn("is_license_file", F.coalesce("_whole", F.lit(False)) | F.col("path").rlike(NAMES.pattern))
    votes = table.where("own_license is not null").groupBy("_dir", "own_license").agg(F.count("*").alias("votes"), F.count_if("is_license_file").alias("files"))
    by = Window.partitionBy("_dir")  # a row for each licence
    first = votes.withColumn("all", F.sum("votes").over(by)).withColumn("_r", F.row_number().over(by.orderBy(F.desc("files"), F.desc("votes"), "own_license")))
    declared = tables.save(first.where("_r = 1").where((F.col("files") > 0) | (F.col("votes") > F.col("all") * MOST)).select(F.col("_dir").alias("_up"), F.col("own_license").alias("_declared")), "license-directories")
    # ancestors of distinct directories, nearest first
    parts = F.split("_dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.when(F.col("_dir") == "", 0).otherwise(F.size(parts))), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - k, F.lit(0))), "/").alias("up")))
    dirs = table.select("_dir").distinct().select("_dir", F.explode(ups).alias("x")).select("_dir", F.col("x.depth").alias("depth"), F.col("x.up").alias("_up"))
    near = dirs.join(declared, "_up").groupBy("_dir").agg(F.min(F.struct("depth", F.col("_up").alias("up"), F.col("_declared").alias("license"))).alias("_near"))
    none = F.col("own_license").isNull()
    return table.join(near, "_dir", "left").select(
        *[F.col("_row")[c].alias(c) for c in stay],
        "path",
        "own_license",
        "score",
        "is_license_file",
        F.coalesce("own_license", F.col("_near.license")).alias("license"),
        F.when(none, F.col("_near.up")).alias("inherited_from"),
        F.when(none, F.col("_near.depth")).alias("depth"),
    )


def op2_license_scans(spark, sf_dir: str) -> DataFrame:
    """Documents as files of the tree source / language / hundred / document. Nulls, ties and repeats as in ``scan``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))
    return scan(docs, path, keep=["doc_id"])
