"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Spark expressions only. Words are lower-cased runs of letters and digits, shingles SHINGLE words in a row.

Retrieval. Templates differ in length, so texts and templates are cut into windows at several scales (SCALES): a window
has so many shingles, a text's begin every stride, a template's at every shingle, and a template uses the largest scale that it
fills by stride - 1 more than one window. A window's signature has bands x rows least hashes, each of a
permutation of its own; a band's rows make a key, and keys are joined with the keys of the templates' windows. Nothing is filtered before.

Collision probability: windows of Jaccard similarity s share a key with probability 1 - (1 - s^rows)^bands (`collision`). A text that
holds a template as it stands has a window that equals one of the template's, and is always retrieved. Where a fifth
of a window's shingles differ, s is 2/3 and a window is retrieved with probability 0.9986, and longer templates
have several windows. Rows of more than one hash would need far more bands for as much; what is retrieved in vain is verified.

Verification, of each text and template retrieved: for every window of WINDOW shingles (every STRIDE) that holds a shingle of
the template, the share of the template's shingles that stand in the window or as far around it as the template is long; at least
CONTAINMENT. It compares shingles, not hashes, and does not depend on which windows were retrieved.

Templates are a list, of any length: their keys are broadcast in blocks of at most BLOCK_CHARS characters (a longer
template is a block of its own), a pass over the texts for each block. Texts are shuffled only where a template was retrieved.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.quant import let
from .common import table

SHINGLE, WINDOW, STRIDE, CONTAINMENT = 5, 16, 8, 0.8
#: (shingles of a window, stride, bands, rows of a band)
SCALES = ((1, 1, 1, 1), (4, 2, 6, 1), (16, 8, 6, 1))
#: At most six keys for a word of two characters: a broadcast of 0.2 GB at the very worst, 50 MB for English.
BLOCK_CHARS = 1_000_000
#: Runs of other characters part words.
GAP = r"[^\p{L}\p{N}]+"

#: (template, license, text): notices by which works state their license, and whole texts of short licenses (fixed values).
TEMPLATES = (
    ("apache-2.0-line", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0-notice", "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("mit-line", "MIT", "Released under the MIT License."),
    (
        "mit-grant", "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software",
    ),
    ("gpl-3.0-line", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl-notice", "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "bsd-3-clause", "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    ("mpl-2.0-notice", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc-grant", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "Unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-nc-line", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0-line", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0-line", "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("all-rights-reserved", "proprietary", "All rights reserved. No part of this publication may be reproduced"),
    (
        "mit-text", "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE.",
    ),
    (
        "isc-text", "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD "
        "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE "
        "OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "bsd-2-text", "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
        "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO "
        "EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, "
        "BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY "
        "OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN "
        "IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "zlib-text", "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the "
        "use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
        "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may "
        "not be removed or altered from any source distribution.",
    ),
)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), GAP, -1), lambda w: w != "")


def _hashes(ws: Column) -> Column:
    """A hash of each shingle, made of its words' hashes; null words after the last are left out of it."""
    n = F.when(F.size(ws) > 0, F.greatest(F.size(ws) - (SHINGLE - 1), F.lit(1))).otherwise(0)
    of_words = F.transform(ws, lambda w: F.xxhash64(w))
    return let(of_words, lambda h: F.transform(F.slice(h, F.lit(1), n), lambda first, i: F.xxhash64(first, *(F.get(h, i + j) for j in range(1, SHINGLE)))))


def _texts(ws: Column) -> Column:
    """The words of each shingle; fewer words than SHINGLE make one, none makes none."""
    n = F.greatest(F.size(ws) - (SHINGLE - 1), F.least(F.size(ws), F.lit(1)))
    shingles = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(ws, i, F.lit(SHINGLE)), " "))
    return F.when(n > 0, shingles).otherwise(F.array().cast("array<string>"))


def collision(similarity: float, bands: int, rows: int) -> float:
    """Probability that windows of this Jaccard similarity share a key."""
    return 1 - (1 - similarity**rows) ** bands


def _least(hashes: Column, size: int, stride: int) -> Column:
    """The least hash of each window; the last windows may be shorter than size."""
    if size == 1:
        return hashes
    starts = F.sequence(F.lit(0), F.size(hashes) - 1, F.lit(stride))
    if size > 4:
        return F.transform(starts, lambda s: F.array_min(F.slice(hashes, s + 1, F.lit(size))))
    return F.transform(starts, lambda s: F.least(*(F.get(hashes, s + i) for i in range(size))))


def _keys(hashes: Column, scales: dict[int, int]) -> Column:
    """Band keys at these scales (number of the scale: stride) of some shingle hashes, a band's together, one for each window.

    Band j of rows r has permutations j r to j r + r - 1, at every scale the same, so that each is made once."""
    together = max(SCALES[i][3] for i in scales)

    def keys_of(i: int, band: int, least: list[Column]) -> Column:
        key = F.transform(least[0], lambda m: F.xxhash64(F.lit(i), F.lit(band), m))
        return reduce(lambda k, m: F.zip_with(k, m, lambda a, b: F.xxhash64(a, b)), least[1:], key)

    def of(made: list[Column], first: int) -> Column:
        if len(made) < together:
            p = first + len(made)
            return let(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(p))), lambda hs: of([*made, hs], first))
        parts = []
        for i, stride in scales.items():
            size, _, bands, rows = SCALES[i]
            for band in range(-(-first // rows), min(bands, (first + together) // rows)):
                parts.append(keys_of(i, band, [_least(made[band * rows + r - first], size, stride) for r in range(rows)]))
        return F.concat(*parts)

    needed = max(SCALES[i][2] * SCALES[i][3] for i in scales)
    return F.concat(*(of([], first) for first in range(0, needed, together)))


def _all_keys(hashes: Column) -> Column:
    """Distinct keys of a text at all scales; of no shingles, none."""
    keys = _keys(hashes, {i: stride for i, (_, stride, *_) in enumerate(SCALES)})
    return F.when(F.size(hashes) > 0, F.array_distinct(keys)).otherwise(F.array().cast("array<long>"))


def _template_keys(hashes: Column) -> Column:
    """Distinct keys of a template at its scale, from windows that it fills."""

    def filled(i: int) -> Column:
        return F.filter(_keys(hashes, {i: 1}), lambda k, at: F.pmod(at, F.size(hashes)) <= F.size(hashes) - SCALES[i][0])

    out = F.array().cast("array<long>")
    for i, (size, stride, *_) in enumerate(SCALES):
        out = F.when(F.size(hashes) >= size + stride - 1, F.array_distinct(filled(i))).otherwise(out)
    return out


def _blocks(templates: tuple) -> Iterator[list]:
    """Templates with their numbers, in blocks of at most BLOCK_CHARS characters."""
    block, chars = [], 0
    for n, (template, license_, text) in enumerate(templates):
        if block and chars + len(text) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append((n, template, license_, text))
        chars += len(text)
    if block:
        yield block


def _index(spark: SparkSession, block: list) -> DataFrame:
    """(n, template, license, shingles, keys) of the templates that have a word."""
    names = ("n", "template", "license", "text")
    rows = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(names, row, strict=True))) for row in block))
    df = spark.range(1).select(F.inline(rows)).withColumn("ws", words(F.col("text")))
    return df.select("n", "template", "license", _texts(F.col("ws")).alias("shingles"), let(_hashes(F.col("ws")), _template_keys).alias("keys")).where(F.size("shingles") > 0)


def _verified(ws: Column, shingles: Column) -> Column:
    """(first_word, containment) of the best windows of a text; null if none holds enough of the template."""
    k = F.size(shingles)
    found = F.filter(F.transform(_texts(ws), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: F.array_contains(shingles, p["x"]))

    def windows(at: Column) -> Column:
        own = F.transform(at, lambda p: p["i"] - F.pmod(p["i"], F.lit(STRIDE)))
        starts = F.filter(F.array_distinct(F.concat(own, F.transform(own, lambda s: s - STRIDE))), lambda s: s >= 0)
        return F.transform(starts, lambda s: let(F.filter(at, lambda p: (p["i"] >= s - k) & (p["i"] < s + WINDOW + k)), share))

    def share(region: Column) -> Column:
        # positions ascend, so the first is the least
        return F.struct(
            F.get(region, F.lit(0))["i"].cast("long").alias("first_word"),
            (F.size(F.array_distinct(F.transform(region, lambda p: p["x"]))) / F.size(F.array_distinct(shingles))).alias("containment"),
        )

    def best(all_: Column) -> Column:
        good = F.filter(all_, lambda w: w["containment"] >= CONTAINMENT)
        least, most = F.array_min(F.transform(good, lambda w: w["first_word"])), F.array_max(F.transform(good, lambda w: w["containment"]))
        return F.when(F.size(good) > 0, F.struct(least.alias("first_word"), most.alias("containment")))

    return let(let(found, windows), best)


def _scan_block(docs: DataFrame, index: DataFrame) -> DataFrame:
    # The row number keeps the optimizer from computing the keys twice. From a column of keys, generator, join and projection
    # are one stage of generated code: texts are copied only for keys that meet a template.
    keyed = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"), let(let(words(F.col("text")), _hashes), _all_keys).alias("keys"))
    keyed = keyed.select("doc_id", "row", "text", F.explode("keys").alias("key"))
    by_key = index.select("n", F.explode("keys").alias("key"))
    hit = keyed.join(F.broadcast(by_key), "key").select("row", "doc_id", "text", "n").distinct()
    hit = hit.join(F.broadcast(index.drop("keys")), "n").withColumn("v", let(words(F.col("text")), lambda ws: _verified(ws, F.col("shingles"))))
    return hit.where("v is not null").select("doc_id", "template", "license", "v.first_word", "v.containment")


def scan(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """(doc_id, template, license, first_word, containment): a row for each row of docs and template found in it.

    first_word: number of the first matching word of the first match. Null and empty texts match nothing. Rows with a null
    doc_id come back with it; repeated rows each count. Other columns are not read; an empty table or no template
    gives an empty result. Templates without a word are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    parts = [_scan_block(own, _index(spark, block)) for block in _blocks(templates)]
    if not parts:
        return spark.createDataFrame([], "doc_id long, template string, license string, first_word long, containment double")
    return reduce(DataFrame.unionAll, parts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(t)}, {quoted(n)}, {quoted(x)})" for t, n, x in TEMPLATES)
    split = lambda c: f"list_filter(string_split_regex(lower(coalesce({c}, '')), '{GAP}'), lambda w: w <> '')"
    shingles = f"list_transform(range(greatest(len(ws) - {SHINGLE - 1}, least(len(ws), 1))), lambda i: array_to_string(ws[i + 1:i + {SHINGLE}], ' '))"
    return f"""
WITH t AS (SELECT template, license, {shingles} AS sh FROM (SELECT template, license, {split('body')} AS ws FROM (VALUES {rows}) v(template, license, body))),
tk AS (SELECT template, license, len(sh) AS k, len(list_distinct(sh)) AS d, unnest(list_distinct(sh)) AS x FROM t),
d AS (SELECT doc_id, row_number() OVER () AS r, {split('text')} AS ws FROM documents),
p AS (SELECT doc_id, r, unnest(sh) AS x, unnest(range(len(sh))) AS i, len(sh) AS n FROM (SELECT doc_id, r, {shingles} AS sh FROM d)),
h AS (SELECT doc_id, r, template, license, k, d, x, i, n FROM p JOIN tk USING (x)),
w AS (SELECT DISTINCT r, template, s FROM (SELECT r, template, i, unnest([i // {STRIDE} * {STRIDE}, i // {STRIDE} * {STRIDE} - {STRIDE}]) AS s FROM h) WHERE s >= 0 AND i < s + {WINDOW}),
m AS (
    SELECT h.r, doc_id, template, license, s, min(i) AS first_word, count(DISTINCT x) / any_value(d) AS containment
    FROM h JOIN w USING (r, template) WHERE i >= s - k AND i < s + {WINDOW} + k GROUP BY h.r, doc_id, template, license, s
)
SELECT doc_id, template, license, min(first_word) AS first_word, max(containment) AS containment FROM m WHERE containment >= {CONTAINMENT} GROUP BY r, doc_id, template, license
"""


ORACLE = _sql()
