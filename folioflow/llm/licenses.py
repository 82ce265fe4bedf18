"""Licence scans in DataFrame functions: sparse TF-IDF cosine to templates, then inheritance from the nearest directory."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# Licence texts and notices as they stand in licence files and headers.
_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; "
    "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_GNU = (
    "This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
    "This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this {thing}."
)
_CC = "This work is licensed under a Creative Commons {name} 4.0 International License."
LICENSE_TEXTS: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, '
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("BSD-2-Clause", _BSD + _AS_IS),
    ("BSD-3-Clause", _BSD + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _AS_IS),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GNU.format(thing="program", name="General Public License", version="2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU.format(thing="program", name="General Public License", version="3")),
    ("LGPL-2.1", _GNU.format(thing="library", name="Lesser General Public License", version="2.1")),
    ("LGPL-3.0", _GNU.format(thing="library", name="Lesser General Public License", version="3")),
    ("AGPL-3.0", _GNU.format(thing="program", name="Affero General Public License", version="3")),
    ("CC-BY-4.0", _CC.format(name="Attribution")),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", _CC.format(name="Attribution-ShareAlike")),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", _CC.format(name="Attribution-NonCommercial")),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the Creative Commons CC0 1.0 Universal Public Domain Dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."),
)

#: A text is cut into lines and sentences, and again into sentences that run on over line ends.
_LINES, _SENTENCES = r"\n|(?<=[.!?;])\s+", r"(?<=[.!?;])\s+|\n\s*\n"
_PY_SENTENCES = r"(?<=[.!?;])\s+"


#: Template sentences of more words are also cut into windows of so many words, each half over the one before.
_LONG, _PIECE = 24, 20


def templates_of(texts: tuple[tuple[str, str], ...] = LICENSE_TEXTS) -> tuple[tuple[str, str], ...]:
    """(licence, statement): every sentence of the texts, the windows of long ones, and for each licence its SPDX line."""
    import re

    out = []
    for name, text in texts:
        for part in re.split(_PY_SENTENCES, text):
            words = part.split()
            out.append((name, part))
            if len(words) > _LONG:
                out += [(name, " ".join(words[k : k + _PIECE])) for k in range(0, len(words) - _PIECE // 2, _PIECE // 2)]
    return tuple(dict.fromkeys(out + [(name, f"SPDX-License-Identifier: {name}") for name, _ in texts]))


TEMPLATES = templates_of()


@dataclass(frozen=True)
class LicenseParams:
    templates: tuple[tuple[str, str], ...] = TEMPLATES
    #: Least cosine of a statement to the template it is taken for.
    min_cosine: float = 0.6
    #: Only statements with a match of this pattern are compared.
    trigger: str = r"(?i)licen[cs]e|spdx|copyright|permission|redistribut|free software|creative\s+commons|public\s+domain|warrant|\bas[ -]is\b|liable|unencumbered|damages"
    #: A file is a licence file by its name, or where its statements hold at least this share of its words.
    file_names: str = r"(?i)^(un)?licen[cs]e|^copying|^notice"
    file_share: float = 0.5
    #: Longer statements are compared in windows of so many words, each half over the one before.
    window: int = 64


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.+-]+|[.]+(?=\s|$)"), lambda w: w.rlike(r"[\p{L}\p{N}]"))


def _py_terms(text: str) -> list[str]:
    import re

    return [w for w in re.split(r"[^\w.+-]+|[.]+(?=\s|$)", text.lower()) if re.search(r"[^\W_]", w)]


def _windows(words: Column, size: int) -> Column:
    """A statement's words, in overlapping windows if it is long."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - size // 2, F.lit(1)), F.lit(size // 2))
    return F.when(F.size(words) <= size, F.array(words)).otherwise(F.transform(starts, lambda s: F.slice(words, s, size)))


def path_parts(path: Column) -> tuple[Column, Column]:
    """Directory ('' at the top) and file name."""
    return F.regexp_extract(path, r"^(?s)(.*)/[^/]*$", 1), F.regexp_extract(path, r"([^/]*)$", 1)


def scan_licenses(files: DataFrame, params: LicenseParams = LicenseParams()) -> DataFrame:
    """The licence of every file: its own statement's, else that of the nearest directory above that declares one.

    ``files`` has doc_id, path and text. Each text is split into lines and sentences, and into sentences that run on over line ends;
    those that ``trigger`` matches become sparse vectors of word counts times idf, as do the templates (the sentences of whole
    licence texts), the idf counted over all statements of all files. A licence is declared where a statement has a cosine of
    ``min_cosine`` or more to a template of it. Of several the one with the largest sum over the statements of their best cosines
    to it decides, then the share of its templates that are met (so a licence that another contains does not pass for that one),
    then the name. A licence file (see ``LicenseParams``) declares its licence for its directory; of several the best cosine, then the
    first path counts. Columns: doc_id, path, license (null: none), cosine (of what decided), origin ('header', 'file',
    'inherited' or null), from_dir (where an inherited licence comes from) and n_statements.

    One row per input row. Null and empty texts have no statements and can only inherit; a null path has no directory and
    inherits nothing. Null and repeated doc_ids, repeated rows and equal paths each keep their row. Other columns are not
    read; an empty table gives no rows. The templates (a parameter) are the only table that is broadcast.
    """
    spark, p = files.sparkSession, params
    tables = Scratch(spark, "licenses")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    triggered = lambda pattern: F.filter(F.split(text, pattern), lambda s: s.rlike(p.trigger))
    statements = F.when(text.rlike(p.trigger), triggered(_LINES)).otherwise(F.array().cast("array<string>"))
    longer = F.when(text.rlike(p.trigger) & F.contains(text, F.lit("\n")), triggered(_SENTENCES)).otherwise(F.array().cast("array<string>"))
    word_lists = F.flatten(F.transform(F.array_union(statements, longer), lambda s: _windows(_terms(s), p.window)))
    rows = files.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.regexp_count(text, F.lit(r"\S+")).alias("n_words"),
        F.aggregate(statements, F.lit(0), lambda n, s: n + F.regexp_count(s, F.lit(r"\S+"))).alias("said"), word_lists.alias("windows"),
    )
    # Few rows hold windows; written once with a number of its own, a row is known by that from here on.
    rows = tables.save(rows.withColumn("uid", F.monotonically_increasing_id()), "rows")
    units = rows.filter(F.size("windows") > 0).select("uid", F.posexplode("windows").alias("unit", "words"))
    tf = tables.save(units.select("uid", "unit", F.explode("words").alias("term")).groupBy("uid", "unit", "term").agg(F.count("*").alias("tf")), "tf")

    total = tf.select("uid", "unit").distinct().count() + len(p.templates)
    own = {}
    for _, t in p.templates:
        for w in set(_py_terms(t)):
            own[w] = own.get(w, 0) + 1
    listed = spark.createDataFrame([(w, n) for w, n in own.items()] or [("", 0)], "term string, listed long")
    df = tf.groupBy("term").agg(F.count("*").alias("held")).join(F.broadcast(listed), "term", "full")
    idf = tables.save(df.select("term", (F.log((1.0 + total) / (1.0 + F.coalesce("held", F.lit(0)) + F.coalesce("listed", F.lit(0)))) + 1.0).alias("idf")), "idf")

    counts = [(k, lic, w, float(words.count(w))) for k, (lic, t) in enumerate(p.templates) for words in [_py_terms(t)] for w in sorted(set(words))]
    shape = spark.createDataFrame(counts, "template int, license string, term string, n double").join(idf, "term").select("template", "license", "term", (F.col("n") * F.col("idf")).alias("w"))
    length = shape.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"))
    templates = F.broadcast(shape.join(length, "template").select("template", "license", "term", (F.col("w") / F.col("t_norm")).alias("w")))

    weighed = tf.join(idf, "term").select("uid", "unit", "term", (F.col("tf") * F.col("idf")).alias("x"))
    norms = weighed.groupBy("uid", "unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.join(templates, "term").groupBy("uid", "unit", "template", "license").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    near = dots.join(norms, ["uid", "unit"]).select("uid", "unit", "template", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine")).filter(F.col("cosine") >= p.min_cosine)
    listed_of = F.create_map(*[F.lit(x) for name in dict.fromkeys(n for n, _ in p.templates) for x in (name, sum(n == name for n, _ in p.templates))])
    ones = near.groupBy("uid", "unit", "license").agg(F.max("cosine").alias("cosine"), F.collect_set("template").alias("met"))
    rated = ones.groupBy("uid", "license").agg(F.max("cosine").alias("cosine"), F.round(F.sum("cosine"), 4).alias("total"), F.size(F.array_distinct(F.flatten(F.collect_list("met")))).alias("met"))
    rated = rated.select("uid", F.struct("total", (F.col("met") / listed_of[F.col("license")]).alias("share"), "license", "cosine").alias("rank"))
    best = rated.groupBy("uid").agg(F.max("rank").alias("best")).select("uid", F.col("best.license").alias("own"), F.col("best.cosine").alias("own_cosine"))

    folder, name = path_parts(F.col("path"))
    named = rows.select("uid", "doc_id", "path", F.size("windows").alias("n_statements"), folder.alias("dir"), (name.rlike(p.file_names) | ((F.col("n_words") > 0) & (F.col("said") >= p.file_share * F.col("n_words")))).alias("is_file"))
    named = tables.save(named.join(best, "uid", "left"), "named")
    declared = named.filter("is_file and own is not null and path is not null").groupBy("dir").agg(F.min(F.struct((-F.col("own_cosine")).alias("c"), "path", "own")).alias("top")).select("dir", F.col("top.own").alias("dir_license"), (-F.col("top.c")).alias("dir_cosine"))
    # Every directory that occurs meets its ancestors once, however many files it holds.
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))
    dirs = named.filter("path is not null").select("dir").distinct().select("dir", F.explode(up).alias("u")).select("dir", "u.depth", F.col("u.above").alias("above")).filter((F.col("above") != "") | (F.col("depth") == 0))
    heirs = dirs.join(declared.select(F.col("dir").alias("above"), "dir_license", "dir_cosine"), "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "dir_license", "dir_cosine")).alias("near"))
    out = named.join(heirs, "dir", "left")
    use_own = F.col("own").isNotNull()
    heir = ~use_own & F.col("near").isNotNull() & F.col("path").isNotNull()
    return out.select(
        "doc_id", "path", F.when(use_own, F.col("own")).when(heir, F.col("near.dir_license")).alias("license"), F.when(use_own, F.col("own_cosine")).when(heir, F.col("near.dir_cosine")).alias("cosine"),
        F.when(use_own & F.col("is_file"), "file").when(use_own, "header").when(heir, "inherited").alias("origin"), F.when(heir, F.col("near.above")).alias("from_dir"), "n_statements",
    )
