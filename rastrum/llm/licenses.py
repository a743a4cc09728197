"""License scans, in DataFrame functions only.

Texts and templates are words, lower-cased runs of letters and digits, in shingles of five. Windows of 2 c shingles
begin every c shingles, c being the power of two next above a template's number of shingles, so some window holds any
copy of the template whole. A window's MinHash has BANDS bands of one row each and retrieves the templates of its size
that have an equal band: a window with 0.8 of a template has a Jaccard index of at least 0.19 with it, and is missed
with a chance of at most (1 - 0.19) ** 64, about 1.4e-6. What is retrieved is verified by exact containment: the share
of the template's distinct shingles in the window, compared word for word, must be 0.8 or more.

Bands are held against each other from the templates' side: a band of a window can only be equal to a template's if the
window holds the very shingle that the template's band comes from. Where no such shingle is, no window's bands are
computed, and no result differs from computing all. Texts are read twice and moved once, those with such a shingle.

Cases: a null text, or one of fewer than five words, has no license. Very long texts are windows as others. Rows that
repeat an id and text are scanned once and get the same answer. An empty table gives no rows; so do no templates. A
template of fewer than five words is refused with a ValueError. Other columns may have any names: only the id and the
text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrum.llm.common import BitMap, checkpoint, table, text_key

WORDS, BANDS, CONTAINED = 5, 64, 0.8
#: Characters of templates up to which their bands and shingles are broadcast; more are joined by a shuffle.
BROADCAST_CHARS = 1 << 20

#: Notices, well-known passages and whole texts of public licenses.
TEMPLATES = (
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("mit-notice", "Released under the MIT License."),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
        OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
        OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
        for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
        following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote
        the original software. If you use this software in a product, an acknowledgment in the product documentation would be
        appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. 3. This notice may not be removed or altered from any source
        distribution.""",
    ),
    (
        "bsd-2-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
        GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
        LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
        OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under "
        "the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles_of(words: str) -> Column:
    """Shingle hashes of an array of words, in order; none for fewer than five."""
    places = F.when(F.size(words) >= WORDS, F.sequence(F.lit(0), F.size(words) - WORDS)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*(F.xxhash64(F.get(words, i + k)) for k in range(WORDS))))


def phrases(words: str) -> Column:
    """The distinct shingles themselves."""
    places = F.when(F.size(words) >= WORDS, F.sequence(F.lit(1), F.size(words) - WORDS + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.concat_ws(" ", F.slice(words, i, WORDS))))


def band_value(x: Column, band: Column) -> Column:
    return F.xxhash64(x, band)


def template_table(templates: DataFrame) -> tuple[DataFrame, bool]:
    """(license, c, t, own): window step, phrases and shingle hashes of (license, body); and whether they are few enough to broadcast."""
    known = templates.select("license", F.length("body").alias("chars"), words_of(F.col("body")).alias("words"))
    known = known.select("license", "chars", phrases("words").alias("t"), F.array_distinct(shingles_of("words")).alias("own"))
    known = checkpoint(known.withColumn("c", F.pow(2, F.ceil(F.log2(F.size("own")))).cast("int")))
    if known.where("size(own) = 0").limit(1).count():
        raise ValueError("a template needs five words")
    return known, (known.agg(F.sum("chars")).first()[0] or 0) <= BROADCAST_CHARS


def find_licenses(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, license, contained): the best window's share of each template found. templates: license, body; key is text_key()."""
    known, few = template_table(templates)
    side = F.broadcast if few else lambda x: x
    least = F.array_min(F.transform("own", lambda x: F.struct(band_value(x, F.col("band")).alias("value"), x.alias("s"))))
    index = known.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))).select("license", "c", "band", least.alias("m"))
    index = checkpoint(index.select("m.s", F.struct("license", "c", "band", "m.value").alias("of")).groupBy("s").agg(F.collect_list("of").alias("tries")))

    texts = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    h = texts.select("doc_id", "key", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    at = h.select("doc_id", "key", "h", F.posexplode("h").alias("i", "w")).where(F.col("i") + WORDS <= F.size("h"))
    at = at.select("doc_id", "key", "i", F.xxhash64("w", *(F.get("h", F.col("i") + k) for k in range(1, WORDS))).alias("s"))
    hits = at.join(side(index), "s").select("doc_id", "key", "i", F.explode("tries").alias("of")).select("doc_id", "key", "i", "of.*")
    start = (F.floor(F.col("i") / F.col("c")) * F.col("c")).cast("int")
    hits = hits.withColumn("start", F.explode(F.array(start, start - F.col("c")))).where("start >= 0")
    windows = hits.groupBy("doc_id", "key", "license", "c", "start").agg(F.collect_set(F.struct("band", "value")).alias("bands"))
    windows = checkpoint(windows.groupBy("doc_id", "key").agg(F.collect_list(F.struct("license", "c", "start", "bands")).alias("windows")))

    own = F.xxhash64("doc_id", "key")
    again = BitMap(windows.select(own.alias("b")), "b", windows.count()).flag(texts, own, "met").where("met")
    again = again.groupBy("doc_id", "key").agg(F.first("text").alias("text")).alias("a")
    w = windows.alias("w")
    rows = again.join(w, F.col("a.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("a.key") == F.col("w.key"))).select("a.doc_id", "a.key", words_of(F.col("a.text")).alias("words"), "w.windows")
    rows = rows.select("doc_id", "key", "words", F.explode("windows").alias("x")).select("doc_id", "key", F.slice("words", F.col("x.start") + 1, 2 * F.col("x.c") + WORDS - 1).alias("words"), "x.license", "x.bands")
    rows = rows.withColumn("s", shingles_of("words"))
    equal = F.exists("bands", lambda b: F.array_min(F.transform("s", lambda x: band_value(x, b["band"]))) == b["value"])
    found = rows.where(equal).join(side(known.select("license", "t")), "license")
    share = F.size(F.array_intersect(phrases("words"), F.col("t"))) / F.size("t")
    found = found.select("doc_id", "key", "license", share.alias("contained")).where(F.col("contained") >= CONTAINED)
    return found.groupBy("doc_id", "key", "license").agg(F.max("contained").alias("contained"))


def known_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "license string, body string")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_licenses(docs, known_templates(spark))
    per = found.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"), F.count("*").alias("n"), F.min("contained").alias("least"))
    rows = docs.select("doc_id", text_key().alias("key"))
    rows = rows.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    return rows.select("doc_id", F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_licenses"), F.coalesce("least", F.lit(0.0)).alias("least_contained"))


def _oracle() -> str:
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in TEMPLATES)
    words = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    grams = "list_transform(range(1, len({0}) - 3), lambda i: array_to_string({0}[i : i + 4], ' '))"
    return rf"""
WITH tw AS (SELECT license, {words.format("body")} AS w FROM (VALUES {values}) v(license, body)),
t AS (SELECT license, list_distinct({grams.format("w")}) AS s, pow(2, ceil(log2(len(list_distinct({grams.format("w")})))))::INT AS c FROM tw),
dw AS (SELECT doc_id, {words.format("text")} AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, {grams.format("w")} AS s FROM dw),
near AS (SELECT d.doc_id, d.s AS ds, t.* FROM d JOIN t ON list_has_any(d.s, t.s)),
win AS (SELECT doc_id, license, s, c, ds[k * c + 1 : (k + 2) * c] AS x FROM (SELECT *, unnest(range(0, (len(ds) + c - 1) // c)) AS k FROM near)),
f AS (SELECT doc_id, license, max(len(list_intersect(list_distinct(x), s)) / len(s)) AS contained FROM win GROUP BY ALL),
g AS (
  SELECT doc_id, string_agg(license, ',' ORDER BY license) AS licenses, count(*) AS n, min(contained) AS least
  FROM f WHERE contained >= {CONTAINED} GROUP BY doc_id
)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(n, 0)::BIGINT AS n_licenses, coalesce(least, 0.0)::DOUBLE AS least_contained
FROM documents LEFT JOIN g USING (doc_id)
"""


ORACLE = _oracle()

QUERIES = {"op5_license_scan": op5_license_scan}
ORACLES = {"op5_license_scan": ORACLE}
