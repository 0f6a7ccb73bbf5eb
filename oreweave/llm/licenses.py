"""Licence scans: canonical digests of whole texts looked up among those of known licences.

A text is made canonical: small letters, one spelling of equivalent words, runs of anything but
letters and digits as one blank, no copyright statements (up to the end of their line, or to a
notice that follows on it; their line stays part of its paragraph). A document is looked up as a whole, by its
paragraphs (between empty lines) and by its lines, each with an equi-join on the digest; the join
is left to Spark, so the list of known licences may be of any size.

Defined results: null and empty texts, and units without letters or digits, match nothing; a unit
that several known licences share is returned for each; repeated rows are returned again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, query

#: Licence and its usual notice.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
                "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
]
#: Licences whose SPDX line is known.
SPDX = [
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0",
    "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only",
    "GPL-2.0-or-later", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "MIT", "MPL-2.0", "Unlicense", "Zlib",
]
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ISC_HEAD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
#: Entire texts, with and without their title.
TEXTS = [
    (licence, title + "\n\n" + body if title else body)
    for licence, title, body in (
        ("MIT", "MIT License", _MIT_GRANT),
        ("MIT", "The MIT License", _MIT_GRANT),
        ("MIT", "The MIT License (MIT)", _MIT_GRANT),
        ("BSD-2-Clause", "BSD 2-Clause License", _BSD_HEAD + "\n\n" + _BSD_TAIL),
        ("BSD-3-Clause", "BSD 3-Clause License", _BSD_HEAD + "\n\n" + _BSD_THIRD + "\n\n" + _BSD_TAIL),
        ("ISC", "ISC License", _ISC_HEAD + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_TAIL),
        ("0BSD", "BSD Zero Clause License", _ISC_HEAD + ".\n\n" + _ISC_TAIL),
        ("Zlib", "zlib License", _ZLIB),
    )
    for title in (title, "")
]
#: Digests of the canonical form of long texts as a Linux distribution ships them.
DIGESTS = [
    ("Apache-2.0", "dbb777d3ad1fb948fbe99e6748cbd3fea3f269381f3f7efe3f4259a28a9269c9"),
    ("Artistic-1.0-Perl", "e792d63eb1b99e126421be6f3e22b0a5a0b508bbcb51ce00bba47a6dd4d2b50e"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "118b2c814d7e3fa57c85f71b240c6a47d353e8acce9164ed6f28305ba85202b2"),
    ("MPL-2.0", "2ad70b294c733e2c6f2cb0324503b9b81e060d33bc2608d3966776252c994426"),
]
#: Spellings that count as equal, as canonical words.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("organisation", "organization"), ("organisations", "organizations"), ("neighbouring", "neighboring"),
    ("favour", "favor"), ("copyrights", "copyright"), ("https", "http"),
    ("noninfringement", "non infringement"), ("percent", "per cent"),
]
NUMBERED = r"\bv(?:er)? ?(\d)"  # v2, ver 2
#: A copyright statement at the start of a line of canonical words.
_STATEMENT = r"(?m)^ ?(?:copyright(?: c)?(?: by)?(?: [12]\d{3}\b| c\b| year\b| yyyy\b| the \w+ (?:authors|contributors|developers|regents)\b)|c [12]\d{3}\b)[^\n]*"
#: Words with which a notice goes on behind a statement on the same line.
_NOTICE = r"(?:released under|licensed under|this (?:file|work|program|source|software) |use of this |permission (?:is|to) |redistribution and|distributed under|spdx license)"
BEFORE_NOTICE = f"{_STATEMENT}?( {_NOTICE})"
COPYRIGHT = f"{_STATEMENT}$|(?m)^ ?all rights reserved ?$"
GONE = "\t"  # stands for a statement, so that its line is no empty line


def canonical(text: Column) -> Column:
    """Canonical form of a text, lines kept apart; a copyright statement leaves GONE behind."""
    out = F.regexp_replace(F.replace(F.lower(text), F.lit("©"), F.lit("(c)")), r"[^\p{L}\p{N}\n]+", " ")
    respelled = F.regexp_replace(out, NUMBERED, "version $1")
    for old, new in SPELLINGS:
        respelled = F.regexp_replace(respelled, rf"\b{old}\b", new)
    some = "|".join(old for old, _ in SPELLINGS)
    out = F.when(out.rlike(rf"\b(?:{some})\b|{NUMBERED}"), respelled).otherwise(out)
    bare = F.regexp_replace(F.regexp_replace(out, BEFORE_NOTICE, "$1"), COPYRIGHT, GONE)
    return F.when(out.rlike(COPYRIGHT), bare).otherwise(out)


def _unit(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \n\t]+", " "))


def known_digests(licences: DataFrame) -> DataFrame:
    """digest, licence for a table of (licence, text)."""
    return licences.select(F.sha2(_unit(canonical(F.col("text"))), 256).alias("digest"), "licence").distinct()


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """(licence, text) of a folder with one entire licence text per file, named by the licence."""
    texts = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return texts.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.txt$", "").alias("licence"), F.col("value").alias("text"))


def built_in(spark: SparkSession) -> DataFrame:
    """digest, licence of the notices, SPDX lines and entire texts in this module."""
    texts = [*NOTICES, *TEXTS, *((i, f"SPDX-License-Identifier: {i}") for i in SPDX)]
    known = known_digests(spark.createDataFrame(texts, "licence string, text string"))
    return known.union(spark.createDataFrame(DIGESTS, "licence string, digest string").select("digest", "licence")).distinct()


def scan(docs: DataFrame, licences: DataFrame) -> DataFrame:
    """Units of documents that are one of the licences of a (licence, text) table."""
    return scan_known(docs, known_digests(licences))


def scan_known(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, unit (text, paragraph or line), position (from 1), licence; known: digest, licence."""
    form = docs.select("doc_id", canonical(F.col("text")).alias("form"))
    kinds = [("text", F.array("form")), ("paragraph", F.split("form", r"\n[ ]?\n")), ("line", F.split("form", r"\n"))]
    units = form.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("unit"), parts.alias("parts")) for k, parts in kinds])).alias("u"))
    units = units.select("doc_id", "u.unit", F.posexplode("u.parts").alias("place", "part"))
    units = units.select("doc_id", "unit", (F.col("place") + 1).cast("long").alias("position"), _unit(F.col("part")).alias("part")).where("part != ''")
    digests = units.select("doc_id", "unit", "position", F.sha2("part", 256).alias("digest"))
    return digests.join(known, "digest").select("doc_id", "unit", "position", "licence")


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    form = "regexp_replace(replace(lower(text), '©', '(c)'), '[^\\p{L}\\p{N}\\n]+', ' ', 'g')"
    form = f"regexp_replace({form}, {quote(NUMBERED)}, 'version \\1', 'g')"
    for old, new in SPELLINGS:
        form = f"regexp_replace({form}, '\\b{old}\\b', {quote(new)}, 'g')"
    form = f"regexp_replace(regexp_replace({form}, {quote(BEFORE_NOTICE)}, '\\1', 'g'), {quote(COPYRIGHT)}, chr(9), 'g')"
    unit = lambda c: f"sha256(trim(regexp_replace({c}, '[ \\n\\t]+', ' ', 'g')))"
    values = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in [*NOTICES, *TEXTS, *((i, f"SPDX-License-Identifier: {i}") for i in SPDX)])
    digests = "".join(f" UNION SELECT {quote(digest)}, {quote(licence)}" for licence, digest in DIGESTS)
    return f"""
WITH known AS (
  SELECT {unit('form')} AS digest, licence FROM (SELECT licence, {form} AS form FROM (VALUES {values}) n(licence, text)){digests or " UNION SELECT NULL, NULL WHERE false"}
), forms AS (SELECT doc_id, {form} AS form FROM documents WHERE text IS NOT NULL),
parts AS (
  SELECT doc_id, 'text' AS unit, [form] AS parts FROM forms
  UNION ALL SELECT doc_id, 'paragraph', string_split_regex(form, '\\n[ ]?\\n') FROM forms
  UNION ALL SELECT doc_id, 'line', string_split(form, chr(10)) FROM forms
), units AS (SELECT doc_id, unit, unnest(parts) AS part, generate_subscripts(parts, 1) AS position FROM parts)
SELECT doc_id, unit, position::BIGINT AS position, licence
FROM units JOIN known ON {unit('part')} = digest
"""


@query("op6_license_scan", _sql())
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_known(documents(spark, sf_dir), built_in(spark))
