"""License scan: MinHash bands over overlapping windows retrieve templates, then exact checks.

Words are runs of a-z, 0-9 and non-ASCII characters of the lower-cased text; shingles are five
words, hashed by ``xxhash64``. A template of s shingles is sought in windows of s + step
shingles, one every step = ceil(s / 4), so any occurrence lies whole in one window. Band b
orders hashes by their XOR with seed b; a window and a template collide in a band when their
smallest hashes agree, with probability J, their Jaccard similarity. The least J of a window
that holds 0.8 of a template follows from s (0.5 for the smallest templates), and the number
of one-row bands from the least J over all templates: an occurrence is missed with a
probability of at most ``MISS``.

A window can only collide in a band if it holds the very shingle that is the template's
smallest one. So the windows looked at are those around such shingles: the same collisions as
from the minima of all windows, without computing these. Colliding windows are then checked
by exact containment of the template's distinct shingles.

Everything is DataFrame code. Edge cases: null, empty and short texts match nothing; a license
that occurs several times is one row, at its best and then first window; repeated rows of one
key are one document; without matches the result is empty; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 5
CONTAINED = 0.8
#: Probability at most that the bands miss a window which holds a template.
MISS = 3e-6
#: Templates that one scan holds at most; they are broadcast.
MOST_TEMPLATES = 5_000

#: License notices (fixed values: public texts).
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions"
    ),
    "mit-conditions": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software."
    ),
    "mit-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED '
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
        "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "isc-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
        "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION "
        "WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions"
    ),
    "apache-2.0-notice-end": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See '
        "the License for the specific language governing permissions and limitations under the License."
    ),
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "bsd-warranty": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED."
    ),
    "bsd-3-clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission."
    ),
    "gpl-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version."
    ),
    "gpl-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License "
        "for more details."
    ),
    "lgpl-2.1-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version."
    ),
    "agpl-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version."
    ),
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}



def least_similarity(s: int) -> float:
    """Least Jaccard similarity of a template of ``s`` shingles and a window that holds enough of it."""
    held, window = math.ceil(CONTAINED * s), s + math.ceil(s / 4)
    return held / (s + window - held)


def band_seeds(sizes: list[int]) -> list[int]:
    """Seeds of as many bands as ``MISS`` demands for templates of these sizes, from a rule."""
    worst = min(map(least_similarity, sizes), default=1.0)
    bands = max(1, math.ceil(math.log(MISS) / math.log(1 - worst))) if worst < 1 else 1
    seeds = [(b * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64) for b in range(1, bands + 1)]
    return [s - (1 << 64) if s >= 1 << 63 else s for s in seeds]


def shingle_hashes(text: Column) -> tuple[Column, str]:
    """Words of ``text``, and the expression for the hashes of its shingles over column ``_w``."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\x{80}-\x{10FFFF}]+")
    rest = ", ".join(f"_w[i + {k}]" for k in range(1, WIDTH))
    return F.array_remove(words, ""), f"transform(slice(_w, 1, greatest(size(_w) - {WIDTH - 1}, 0)), (x, i) -> xxhash64(x, {rest}))"


def template_bands(templates: DataFrame) -> DataFrame:
    """(license, s, step, shingles, seed, low): one row for each template (license, text) and band."""
    words, hashed = shingle_hashes(F.col("text"))
    rows = templates.select("license", "text").where("license IS NOT NULL")
    if len(rows.take(MOST_TEMPLATES + 1)) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    rows = rows.withColumn("_w", words).withColumn("shingles", F.array_distinct(F.expr(hashed))).where(F.size("shingles") > 0)
    rows = rows.select("license", F.size("shingles").alias("s"), "shingles").withColumn("step", F.ceil(F.col("s") / 4).cast("int"))
    sizes = [r.s for r in rows.select("s").distinct().collect()]  # of a registry of at most MOST_TEMPLATES rows
    rows = rows.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in band_seeds(sizes)])))
    return rows.withColumn("low", F.array_min(F.expr("transform(shingles, x -> x ^ seed)")).bitwiseXOR(F.col("seed")))


def registry(spark, templates: dict[str, str] | None = None) -> DataFrame:
    """The built-in templates, or given ones, as a table (license, text)."""
    return spark.createDataFrame(sorted((TEMPLATES if templates is None else templates).items()), "license string, text string")


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, license, containment, first_word (of the window) for every license in every text.

    ``templates`` is a table (license, text) of any registry, read from wherever it lies; by
    default the built-in one.
    """
    spark = docs.sparkSession
    bands = [r.asDict() for r in template_bands(registry(spark) if templates is None else templates).collect()]
    schema = "license string, s int, shingles array<long>, step int, seed long, low long"
    table = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in bands], schema)
    lows = sorted({r["low"] for r in bands}) or [0]
    reach = max([r["s"] + r["step"] for r in bands], default=1)

    words, hashed = shingle_hashes(F.col(text))
    hashes = docs.select(F.col(key), words.alias("_w")).select(key, F.expr(hashed).alias("_h"))
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size("_h") - 1, F.lit(0))), lambda i: F.get("_h", i).isin(lows))
    around = F.transform(
        at,
        lambda i: F.struct(
            i.alias("_p"), F.get("_h", i).alias("low"), F.greatest(i - reach, F.lit(0)).alias("_from"),
            F.slice("_h", F.greatest(i - reach, F.lit(0)) + 1, 2 * reach + 1).alias("_near"),
        ),
    )
    # inline_outer: a filter on _h, given or inferred from inline, would be pushed below the
    # projections and would split the text again for every shingle.
    near = hashes.select(key, F.inline_outer(around)).where(F.col("low").isNotNull())
    first = F.greatest(F.ceil((F.col("_p") - F.col("s") - F.col("step") + 1) / F.col("step")), F.lit(0)).cast("int")
    windows = (
        near.join(F.broadcast(table), "low")
        .withColumn("_k", F.explode(F.sequence(first, F.floor(F.col("_p") / F.col("step")).cast("int"))))
        .withColumn("_start", F.col("_k") * F.col("step"))
        .withColumn("_win", F.expr("slice(_near, _start - _from + 1, s + step)"))
    )
    hit = windows.where(F.array_min(F.expr("transform(_win, x -> x ^ seed)")) == F.col("low").bitwiseXOR(F.col("seed")))
    share = F.size(F.array_intersect("shingles", "_win")) / F.col("s")
    checked = hit.select(key, "license", share.alias("containment"), F.col("_start").alias("first_word"))
    best = F.max(F.struct("containment", (-F.col("first_word")).alias("f")))
    return (
        checked.where(F.col("containment") >= F.lit(CONTAINED))
        .groupBy(key, "license").agg(best.alias("b"))
        .select(key, "license", F.col("b.containment").alias("containment"), (-F.col("b.f")).alias("first_word"))
    )
