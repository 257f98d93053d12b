"""Operator 5: licence texts by canonical digest, in DataFrame expressions only.

A text is brought to a canonical form: A-Z in lower case, copyright lines dropped, punctuation and
white space made single spaces, equivalent spellings unified.  The digest of the entire canonical
text is joined by hash to the digests of known licence texts.  A document is looked up as a whole, and
each of its lines as a text of its own, which finds one-line licence notices.

Known texts come as a list of ``(license_id, text)``; the default is ``KNOWN``: the whole texts in
``licence_texts/`` and the short ones below, with and without their titles and appendices, and one-line
notices and identifiers.  The digests of a list of at most ``BROADCAST_KNOWN`` texts are sent to
every task, so no text or line is shuffled; a longer list is joined by shuffling digests.

Defined results: null and empty texts, and texts without letters or digits, match nothing; a known
text that is canonically empty is ignored, and of known texts with equal canonical forms the smallest
id counts; each row is judged by its text alone, so equal rows agree; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: public licence texts, without their copyright lines
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_BSD2_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD3_TERM = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
"""
_BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.
3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software
and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to
whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction
and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative
works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code
generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE
COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form
or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to
the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity
of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE_MORE = "\n\nFor more information, please refer to <https://unlicense.org/>"
KNOWN = (
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC), ("ISC", "ISC License\n" + _ISC),
    ("BSD-2-Clause", _BSD2_TERMS + _BSD_DISCLAIMER),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD2_TERMS + _BSD_DISCLAIMER),
    ("BSD-3-Clause", _BSD2_TERMS + _BSD3_TERM + _BSD_DISCLAIMER),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD2_TERMS + _BSD3_TERM + _BSD_DISCLAIMER),
    ("Zlib", _ZLIB), ("Zlib", "zlib License\n" + _ZLIB),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Released under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"), ("MIT", "Licensed under the MIT License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"), ("CC0-1.0", "Licensed under CC0 1.0"),
    ("BSL-1.0", _BOOST), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n" + _BOOST),
    ("Unlicense", _UNLICENSE), ("Unlicense", _UNLICENSE + _UNLICENSE_MORE),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
)
# fixed values: identifiers of the licences that notices name
IDENTIFIERS = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-1.0-Perl", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause",
    "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "EPL-2.0", "GFDL-1.2-only", "GFDL-1.3-only", "GPL-1.0-only",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.0-only", "LGPL-2.1-only",
    "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-1.1", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
)
#: where a licence's terms end and its advice on using it begins
_APPENDIX = ("END OF TERMS AND CONDITIONS", "ADDENDUM: How to use this License for your documents")


def _packaged() -> list[tuple[str, str]]:
    """The texts of ``licence_texts/``, whole and without the appendix."""
    out = []
    for file in sorted(resources.files("aspectra.llm").joinpath("licence_texts").iterdir(), key=lambda f: f.name):
        name, text = file.name.removesuffix(".txt"), file.read_text(encoding="utf-8")
        out.append((name, text))
        for mark in _APPENDIX:
            terms, found, _ = text.partition(mark)
            if found:
                out += [(name, terms), (name, terms + mark)]
    return out


KNOWN += tuple(_packaged()) + tuple((i, f"SPDX-License-Identifier: {i}") for i in IDENTIFIERS)
# fixed values: spellings that count as the same, after lower case and single spaces
EQUIVALENT = (
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("licencing", "licensing"),
    ("licencee", "licensee"), ("licencees", "licensees"), ("licencor", "licensor"), ("licencors", "licensors"),
    ("sublicence", "sublicense"), ("sublicenced", "sublicensed"), ("sublicences", "sublicenses"), ("sublicencing", "sublicensing"),
    ("sublicencees", "sublicensees"), ("sub license", "sublicense"),
    ("non infringement", "noninfringement"), ("acknowledgement", "acknowledgment"), ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"), ("favour", "favor"), ("authorised", "authorized"),
    ("organisation", "organization"), ("modelling", "modeling"), ("per cent", "percent"), ("https", "http"),
)
#: lines that name the owner of the rights
COPYRIGHT_LINE = r"(^|\n)[\x20\t*#/;-]*((copyright[\x20\t]*)?(\(c\)|©|copyright[\x20\t]+[0-9]{4})|all rights reserved)[^\n]*"
BROADCAST_KNOWN = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text):
    """The canonical form of a text column ('' without letters or digits)."""
    low = F.regexp_replace(F.translate(text, UPPER, LOWER), COPYRIGHT_LINE, "\n")
    # two spaces between words, so that each has its own on either side
    flat = F.concat(F.lit(" "), F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", "  ")), F.lit(" "))
    for other, usual in EQUIVALENT:
        flat = F.replace(flat, F.lit(_spaced(other)), F.lit(_spaced(usual)))
    return F.trim(F.replace(flat, F.lit("  "), F.lit(" ")))


def _spaced(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def digest(text):
    """The digest of an entire text ('' for null): never null, so a join adds no second evaluation as a filter."""
    return F.coalesce(F.sha2(canonical(text), 256), F.lit(""))


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """``(digest, license_id)``, one row per digest."""
    rows = spark.createDataFrame([tuple(k) for k in known], "license_id string, text string")
    rows = (rows.filter(canonical(F.col("text")) != "").select(digest(F.col("text")).alias("digest"), "license_id")
            .groupBy("digest").agg(F.min("license_id").alias("license_id")))
    # the list is the caller's and its length is known here: about 100 bytes a text are sent
    return F.broadcast(rows) if len(known) <= BROADCAST_KNOWN else rows


def scan(docs: DataFrame, known=KNOWN) -> DataFrame:
    """``(doc_id, license, n_license_lines, line_licenses)`` for every row of ``docs (doc_id, text)``.

    ``license``: the licence that the whole text is, if any; ``line_licenses``: those that single lines
    are, ascending and comma-joined.
    """
    found = known_digests(docs.sparkSession, known)
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_mark"), "text")
    # of the lines only those that match go into a shuffle; equal rows share them
    lines = (mine.select("doc_id", "_mark", F.posexplode(F.split("text", "\n")).alias("_line", "_l"))
             .select("doc_id", "_mark", "_line", digest(F.col("_l")).alias("digest"))
             .join(found, "digest").select("doc_id", "_mark", "_line", "license_id").distinct()
             .groupBy("doc_id", "_mark").agg(F.count(F.lit(1)).alias("_n"), F.array_join(
                 F.sort_array(F.collect_set("license_id")), ",").alias("_ids")))
    whole = (mine.select("doc_id", "_mark", digest(F.col("text")).alias("digest")).join(found, "digest", "left")
             .select("doc_id", "_mark", F.col("license_id").alias("license")).alias("w"))
    same = F.col("w.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("w._mark") == F.col("l._mark"))
    return whole.join(lines.alias("l"), same, "left").select(
        "w.doc_id", "license", F.coalesce("_n", F.lit(0)).cast("long").alias("n_license_lines"),
        F.coalesce("_ids", F.lit("")).alias("line_licenses"))


def _canonical_sql(c: str) -> str:
    low = f"regexp_replace(translate({c}, '{UPPER}', '{LOWER}'), '{COPYRIGHT_LINE}', chr(10), 'g')"
    flat = rf"' ' || trim(regexp_replace({low}, '[^\p{{L}}\p{{N}}]+', '  ', 'g')) || ' '"
    for other, usual in EQUIVALENT:
        flat = f"replace({flat}, '{_spaced(other)}', '{_spaced(usual)}')"
    return f"trim(replace({flat}, '  ', ' '))"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


ORACLE_SQL = f"""
WITH known AS (
  SELECT sha256(c) AS digest, min(license_id) AS license_id
  FROM (SELECT license_id, {_canonical_sql('text')} AS c
        FROM (VALUES {', '.join(f'({_quoted(i)}, {_quoted(t)})' for i, t in KNOWN)}) AS k(license_id, text))
  WHERE c <> '' GROUP BY 1),
lines AS (
  SELECT doc_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT license_id)), ',') AS ids
  FROM (SELECT doc_id, {_canonical_sql('line')} AS c
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) AS l
  JOIN known ON digest = sha256(c) WHERE c <> '' GROUP BY doc_id)
SELECT d.doc_id, k.license_id AS license, CAST(coalesce(n, 0) AS BIGINT) AS n_license_lines,
       coalesce(ids, '') AS line_licenses
FROM (SELECT doc_id, {_canonical_sql('text')} AS c FROM documents) AS d
LEFT JOIN known AS k ON c <> '' AND digest = sha256(c)
LEFT JOIN lines AS l ON d.doc_id = l.doc_id
"""
