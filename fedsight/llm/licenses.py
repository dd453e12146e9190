"""Licence scans: Dice coefficient over word bigrams against licence templates.

Every line, paragraph and whole text of a document is a unit; runs of lines,
sentences or words in it are windows (see ``_windows``). A unit and a
template are compared by the Dice coefficient 2 |A n B| / (|A| + |B|) of their
sets of word bigrams. A coefficient of t needs |A| between t / (2 - t) |B| and
(2 - t) / t |B|, so units out of all templates' bounds are never expanded and a
bigram meets only the templates whose bounds hold its unit's size.

The templates' bigrams are a bounded parameter and are broadcast; a document's
bigrams are counted where they are read and only matches are shuffled.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fedsight.llm.common import letter_words

#: Texts of common licence notices.
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "BSD notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                      "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                         "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
                         "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
                         "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
                         "specific language governing permissions and limitations under the License.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                      "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
                      "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
                      "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
           "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
           "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
           "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included "
           "in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS "
           "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
           "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
           "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
           "IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
           "that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
           "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
           "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
           "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
           "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
}


def template_bigrams(templates: dict[str, str]) -> dict[str, list[str]]:
    """Sorted distinct word bigrams of each template, normalised like the texts."""
    out = {}
    for name, text in templates.items():
        w = re.findall(r"[^\W_]+", text.lower())
        out[name] = sorted({f"{a} {b}" for a, b in zip(w, w[1:])})
    return out


def _windows(rows: DataFrame, templates: dict[str, str], t: float) -> DataFrame:
    """doc_id, license and dice of the best window of each row of (doc_id, text)
    and each template that a window reaches.

    A window is a run of bigrams of at most (2 - t) / t times the template's
    length. It begins and ends with lines or sentences, or else it is as long as
    the template or longer, so that words which differ are never cut off at its
    ends. A coefficient of t needs t / (2 - t) of the template's bigrams, so a
    text is looked through only for templates of which it holds so many. The
    time is in proportion to the text's length times the template's.
    """
    known = []
    for name, gs in template_bigrams(templates).items():
        if gs:
            total = len(re.findall(r"[^\W_]+", templates[name].lower())) - 1
            known.append((name, gs, len(gs), total, math.ceil(len(gs) * t / (2 - t) - 1e-9), math.floor(total * (2 - t) / t + 1e-9)))
    of = F.array(*[F.struct(F.lit(n).alias("license"), F.array(*map(F.lit, gs)).alias("tg"), F.lit(m).alias("m"), F.lit(total).alias("total"),
                            F.lit(need).alias("need"), F.lit(most).alias("most")) for n, gs, m, total, need, most in known])
    every = F.array(*map(F.lit, sorted({g for k in known for g in k[1]})))
    least = min(k[4] for k in known)

    def pairs(w: str) -> str:
        return f"transform(if(size({w}) > 1, sequence(0, size({w}) - 2), array()), i -> concat({w}[i], ' ', {w}[i + 1]))"

    found = rows.select("doc_id", "text", letter_words(F.col("text")).alias("w")).select(
        "doc_id", "text", F.array_intersect(F.expr(pairs("w")), every).alias("held"))
    fits = F.when(F.size("held") >= least, F.filter(of, lambda x: F.size(F.array_intersect(F.col("held"), x["tg"])) >= x["need"]))
    near = found.select("doc_id", "text", F.explode_outer(fits).alias("of")).where("of is not null").select("doc_id", "text", "of.*")
    parts = F.transform(F.split("text", r"\n|(?<=[.!?;:])\s+"), letter_words)
    near = near.withColumn("parts", parts).withColumn("w", F.flatten("parts"))
    near = near.withColumns({
        "tg": F.expr("transform(tg, x -> xxhash64(x))"),
        "sorted": F.expr(f"sort_array(transform({pairs('w')}, (x, i) -> struct(xxhash64(x) as x, i as i)))"),
        # Word numbers where lines and sentences begin, and the end.
        "edges": F.expr("""array_append(filter(transform(flatten(transform(parts, x -> transform(x, (y, i) -> i = 0))),
            (first, i) -> if(first, i, null)), i -> i is not null), size(w))""")})
    # Each bigram with the place where it stood before (-1: nowhere): it is new to a window that begins after that place.
    near = near.withColumn("rows", F.expr("""sort_array(transform(sorted, (v, k) -> struct(v.i as p,
        if(k > 0 and get(sorted, k - 1).x = v.x, get(sorted, k - 1).i, -1) as before, array_contains(tg, v.x) as hit)))"""))
    near = near.withColumn("hits", F.expr("transform(filter(rows, x -> x.hit), x -> x.p)"))
    enough = "size(filter(slice(rows, s + 1, most), x -> x.hit)) >= need"
    near = near.withColumns({
        "starts": F.expr(f"""filter(filter(array_distinct(concat(hits, transform(hits, p -> p - total + 1))),
            s -> s >= 0 and s + total <= size(rows)), s -> {enough})"""),
        "firsts": F.expr(f"filter(transform(edges, (s, k) -> struct(s as s, k as k)), v -> {enough.replace('s + 1', 'v.s + 1')})")})

    def dice(d: str, end: str) -> str:
        """Coefficient of the bigrams before ``end`` of those in ``d`` that are new to their window."""
        return f"2 * size(filter({d}, x -> x.hit and x.p < {end})) / (size(filter({d}, x -> x.p < {end})) + m)"

    # The j-th new template bigram of a window is its i-th new bigram; windows that end elsewhere are no better, the shortest aside.
    free = f"""transform(starts, s -> array_max(transform(array(filter(slice(rows, s + 1, most), x -> x.before < s)), d -> greatest(
        {dice("d", "s + total")}, array_max(transform(filter(transform(d, (x, i) -> struct(x.p as p, x.hit as hit, i + 1 as n)), x -> x.hit),
        (x, j) -> if(x.p >= s + total - 1, 2 * (j + 1) / (x.n + m), 0.0D)))))))"""
    whole = f"""transform(firsts, v -> array_max(transform(array(filter(slice(rows, v.s + 1, most), x -> x.before < v.s)), d ->
        array_max(transform(filter(slice(edges, v.k + 2, most + 1), f -> f - v.s - 1 between need and most), f -> {dice("d", "f - 1")})))))"""
    return near.select("doc_id", "license", F.expr(f"round(array_max(concat({free}, {whole})), 9)").alias("dice"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """doc_id, license, dice (largest) and n_units (different units that match)
    of every document and template with a coefficient of ``threshold`` or more.

    Texts are lower-cased; words are runs of letters and digits; a unit is a
    line, a blank-line separated paragraph or the whole text. A template that no
    unit reaches but a window does counts as one unit. Units with fewer
    than two words, null and empty texts match nothing. Rows that repeat an id
    are scanned together. All templates that reach the threshold are returned,
    ties included. A null id is a value like any other. An empty table or no
    template gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    t = float(threshold)
    grams = template_bigrams(TEMPLATES if templates is None else templates)
    rows = [(g, name, len(gs)) for name, gs in grams.items() for g in gs]
    known = spark.createDataFrame(rows, "gram string, license string, m int")
    sizes = [len(g) for g in grams.values() if g] or [0]
    low, high = min(sizes) * t / (2 - t), max(sizes) * (2 - t) / t
    text = F.coalesce(F.col(text_col), F.lit(""))
    units = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, r"\n[ \t\r]*\n"), F.array(text)))
    words = docs.select(F.col(id_col).alias("doc_id"), F.explode_outer(units).alias("unit")).select(
        "doc_id", F.xxhash64("unit").alias("u"), letter_words(F.col("unit")).alias("w"))
    pairs = F.array_distinct(F.expr("transform(sequence(0, size(w) - 2), i -> concat(w[i], ' ', w[i + 1]))"))
    sized = words.select("doc_id", "u", F.when(F.size("w") - 1 >= low, pairs).alias("grams"))
    near = F.when(F.size("grams").between(F.lit(low), F.lit(high)), F.col("grams"))
    n, m = F.col("n"), F.col("m")
    # n is never null: a null test inferred for the join would be pushed below and copy the word split there.
    hits = (sized.select("doc_id", "u", F.coalesce(F.size("grams"), F.lit(0)).alias("n"), F.explode_outer(near).alias("gram"))
            .join(F.broadcast(known), "gram").where((n >= m * (t / (2 - t))) & (n <= m * ((2 - t) / t))).distinct())
    dice = F.round(2 * F.count(F.lit(1)) / (n + m), 9)
    found = hits.groupBy("doc_id", "u", "n", "license", "m").agg(dice.alias("dice")).where(F.col("dice") >= t).select(
        "doc_id", "license", "dice", F.lit(1).alias("unit"))
    if rows:
        whole = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
        found = found.unionByName(_windows(whole, TEMPLATES if templates is None else templates, t).withColumn("unit", F.lit(0)))
    return found.groupBy("doc_id", "license").agg(F.max("dice").alias("dice"), F.greatest(F.sum("unit"), F.lit(1)).cast("long").alias("n_units")).where(
        F.col("dice") >= t)
