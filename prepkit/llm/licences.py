"""Licence scan by canonical digest.

A text is brought to a canonical form (lower case, no copyright statements, no punctuation, one
spelling where several are in use, single blanks), and the digest of the whole form is joined
with the digests of known licences. The known texts go through the same form.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prepkit.llm.known_licences import DIGESTS, TEXTS

#: How licences go on after a copyright statement on the same line, and how lines of
#: their texts go on that begin with the word.
OPENINGS = (r"(permission is hereby granted|permission to use|redistribution and use|everyone is permitted|licensed under|"
            r"released under|this work is licensed|this program is free|this library is free|this file is part|"
            r"this is free and unencumbered|this source code form|spdx license identifier|spdx-license-identifier)")
BODY = r"(?!\s+(holders?|owners?|notices?|laws?|licen[sc]e|statements?|permission|disclaimer|interest|treaty|and|or|in|on|the|to)\b)"
#: A statement ends with its line, or where the licence begins. Amid a line it is one only before that,
#: and of AMID characters at most, so that a text is read in time that grows with its length alone.
AMID = 400
STATEMENT = (rf"(?m)^[ \t\x0B\f]*+(copyright\b{BODY}|\(c\)(?=\s*(copyright|by\b|[\d<\[©]))|©|all rights reserved).*?(?=\b{OPENINGS}|$)"
             rf"|\bcopyright\s{{1,20}}(\(c\)|©|\d{{4}}).{{0,{AMID}}}?(?=\b{OPENINGS})")
#: Spellings in use for the same word.
SPELLINGS = (("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"),
             ("merchantibility", "merchantability"), ("organisation", "organization"), ("favour", "favor"),
             ("whilst", "while"), ("per cent", "percent"), ("acknowledgement", "acknowledgment"),
             ("analogue", "analog"), ("behaviour", "behavior"), ("judgement", "judgment"),
             ("copyright owner", "copyright holder"), ("https", "http"))

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
PERMISSION = """Permission to use, copy, modify, and/or distribute this software for any purpose
with or without fee is hereby granted{proviso}.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use
this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License
is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the
License."""

#: Public licence texts and one-line notices, by SPDX identifier.
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", MIT),
    ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("ISC", PERMISSION.format(proviso=", provided that the above copyright notice and this permission notice appear in all copies")),
    ("0BSD", PERMISSION.format(proviso="")),
    ("Apache-2.0", APACHE_HEADER),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
)


def canonical(text: Column) -> Column:
    """The canonical form of a text; "" for one without letters or digits, NULL for NULL."""
    text = F.regexp_replace(F.lower(text), STATEMENT, "")
    text = F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))
    for old, new in SPELLINGS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def digests(texts: Column) -> Column:
    """Digests of an array of texts, NULL for those without a form. Forms are made first, so that
    none is made once to be compared and again to be hashed."""
    return F.transform(F.transform(texts, canonical), lambda form: F.when(form != "", F.sha2(form, 256)))


def known_licences(spark: SparkSession, texts: Mapping[str, str] | tuple | None = None) -> DataFrame:
    """``license`` and ``digest`` of known texts, one row per digest; without texts, of all that
    this package knows."""
    rows = list(KNOWN + TEXTS if texts is None else texts.items() if isinstance(texts, Mapping) else texts)
    known = spark.createDataFrame(rows, "license string, text string")
    known = known.select("license", F.get(digests(F.array("text")), F.lit(0)).alias("digest")).where("digest is not null")
    if texts is None:
        known = known.union(spark.createDataFrame([(name, held) for held, name in DIGESTS.items()], known.schema))
    return known.groupBy("digest").agg(F.min("license").alias("license"))


def licences(docs: DataFrame, known: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``digest`` (of the whole canonical text), ``license`` (the
    known licence that the whole text is, or NULL) and ``noted`` (the licences, in order, of which
    a line of the text is a notice or text; empty if none).

    NULL texts, and texts without a letter or digit, have no digest and match nothing. Equal rows
    get equal results, NULL ids stay. Other columns are not read. The known digests are a table
    of some dozens of rows; a large one is joined by a shuffle.
    """
    known = known_licences(docs.sparkSession) if known is None else known
    lines = digests(F.array_distinct(F.split(F.coalesce(F.col(text), F.lit("")), "\n")))
    base = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("mark"),
                       F.get(digests(F.array(text)), F.lit(0)).alias("digest"), F.array_distinct(lines).alias("lines"))
    noted = (base.select("id", "mark", F.explode("lines").alias("digest")).where("digest is not null")
             .join(known, "digest").groupBy("id", "mark").agg(F.sort_array(F.collect_set("license")).alias("noted")))
    whole = base.drop("lines").join(known, "digest", "left")
    same = whole["id"].eqNullSafe(noted["id"]) & (whole["mark"] == noted["mark"])
    return whole.join(noted, same, "left").select(
        whole["id"].alias(doc_id), "digest", "license", F.coalesce("noted", F.array().cast("array<string>")).alias("noted"))
