"""Licence scan by canonical digest: texts that say the same have the same digest, which is joined with known ones.

The canonical form is lower-case, without copyright lines and punctuation, with one spelling of words that licences
spell in several ways.  A document is looked up whole, by its paragraphs and by its lines; a known licence of
several paragraphs is known by each of them too, so that it is found inside a longer text.  Marks of comments before a
line are no part of it: copyright lines are known behind them, and lines of nothing else part paragraphs.  Spellings of two
words ("version 2", "per cent") are known within a line only.

Edge cases: null and empty texts, and texts of which only copyright lines are left, have no digest and match nothing;
repeated rows match one by one; equal known texts under two names give a row for each name; an empty table on either
side gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm.common import let
from fieldspark.plans.sizing import broadcast_if_small

#: Spellings that licences use for one word, as patterns over lower-case text.
SPELLINGS = (
    ("licen[cs]e", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("authori[sz]", "authoriz"),
    ("organi[sz]ation", "organization"),
    ("per cent", "percent"),
    (r"\bholder", "owner"),
    ("https:", "http:"),
    (r"\bversion ", "v"),
)
#: What comments put before a line; a line of nothing else is blank.
MARKS = r"[ \t#*/;%!<>-]*"
#: A wrapped sentence may begin a line with "copyright holders" or "copyright notice".
COPYRIGHT_LINE = (
    rf"(?m)^{MARKS}(copyright[ \t]*(\(c\)|©|:|[0-9]|by[ \t]|the[ \t])|\(c\)|©|all rights reserved)[^\n]*$"
)
PUNCTUATION = r"[^\p{L}\p{N}]+"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated \
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the \
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit \
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the \
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE \
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR \
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR \
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby \
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL \
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, \
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN \
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF \
THIS SOFTWARE."""

_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in \
compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific \
language governing permissions and limitations under the License."""

_GPL3_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General \
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any \
later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied \
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""

_BSD_BEGIN = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the \
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following \
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following \
disclaimer in the documentation and/or other materials provided with the distribution."""

_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote \
products derived from this software without specific prior written permission."""

_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, \
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE \
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, \
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; \
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN \
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS \
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_MPL2_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not \
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

#: Public licence texts and notices.  `scan` takes any other table of the kind.
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", _GPL3_NOTICE),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("BSD-2-Clause", f"{_BSD_BEGIN}\n\n{_BSD_END}"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", f"{_BSD_BEGIN}\n\n{_BSD_THIRD}\n\n{_BSD_END}"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", _MPL2_NOTICE),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
)


#: A line that has nothing left, but was not blank.
_NOTHING = "\x01"


def _line(line: Column) -> Column:
    """The canonical form of one line: blank lines are empty, lines of which nothing is left a mark."""
    plain = F.regexp_replace(F.lower(line), COPYRIGHT_LINE, "")
    any_spelling = F.lit("|".join(pattern for pattern, _ in SPELLINGS))
    spelled = let(plain, lambda c: F.when(F.rlike(c, any_spelling), _respelled(c)).otherwise(c))
    bare = F.trim(F.regexp_replace(spelled, PUNCTUATION, " "))
    return let(bare, lambda c: F.when(c != "", c).when(F.rlike(line, F.lit(f"^{MARKS}$")), "").otherwise(_NOTHING))


def _respelled(c: Column) -> Column:
    for pattern, word in SPELLINGS:
        c = F.regexp_replace(c, pattern, word)
    return c


def units(rows: DataFrame, text: Column, lines: bool) -> DataFrame:
    """rows with unit, place and digest of the text, its paragraphs and (if asked for) lines.

    No spelling and no copyright line reaches over a line's end, so lines are made canonical once, and paragraphs and
    the text are put together from them."""

    def digest(part: Column) -> Column:
        joined = F.trim(F.regexp_replace(part, "[\n\x01 ]+", " "))
        return let(joined, lambda c: F.when(c != "", F.md5(c.cast("binary"))))

    def numbered(parts: Column, name: str) -> Column:
        return F.transform(
            parts, lambda x, i: F.struct(F.lit(name).alias("unit"), i.cast("long").alias("place"), digest(x).alias("digest"))
        )

    def every(forms: Column) -> Column:
        whole = F.array_join(forms, "\n")
        parts = [numbered(F.array(whole), "text"), numbered(F.split(whole, r"\n[ \t]*\n", -1), "paragraph")]
        return F.concat(*parts, *([numbered(forms, "line")] if lines else []))

    made = let(F.transform(F.split(text, "\n", -1), _line), every)
    found = F.filter(made, lambda u: u["digest"].isNotNull())
    return rows.select("*", F.explode(found).alias("__u")).select(*[F.col(f"`{c}`") for c in rows.columns], "__u.*")


def known(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN), "license_id string, text string")


def digests(licenses: DataFrame) -> DataFrame:
    """license_id and digest of each text and each of its paragraphs."""
    rows = licenses.select("license_id", F.col("text").alias("t"))
    return units(rows, F.col("t"), False).select("license_id", "digest").distinct()


def scan(docs: DataFrame, licenses: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each text, paragraph or line of a document that is a known one: doc_id, license_id, unit, place.

    A unit that is all of a larger one is reported for both.  The known digests are broadcast if counted to be few, else shuffled."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    found = units(rows, F.col("t"), True).drop("t").join(broadcast_if_small(digests(licenses)), "digest")
    return found.select("doc_id", "license_id", "unit", "place", "digest")


def oracle() -> str:
    """The same scan as DuckDB SQL over documents."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    c = f"regexp_replace(lower(part), {quoted(COPYRIGHT_LINE)}, '', 'g')"
    for pattern, word in SPELLINGS:
        c = f"regexp_replace({c}, {quoted(pattern)}, {quoted(word)}, 'g')"
    c = f"trim(regexp_replace({c}, {quoted(PUNCTUATION)}, ' ', 'g'))"
    rows = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in KNOWN)

    def cut(key, source, kinds):
        split = {"paragraph": rf"regexp_split_to_array(t, '\n{MARKS}\n')", "line": "string_split(t, chr(10))"}
        every = [f"SELECT {key}, 'text' AS unit, 0 AS place, t AS part FROM {source}"] + [
            f"SELECT {key}, '{k}' AS unit, unnest(range(len({split[k]}))) AS place, unnest({split[k]}) AS part FROM {source}"
            for k in kinds
        ]
        return f"SELECT {key}, unit, place, md5(nullif({c}, '')) AS digest FROM ({' UNION ALL '.join(every)})"

    return f"""
WITH known(license_id, t) AS (VALUES {rows}),
d AS (SELECT doc_id, text AS t FROM documents),
k AS (SELECT DISTINCT license_id, digest FROM ({cut("license_id", "known", ["paragraph"])}) WHERE digest IS NOT NULL),
u AS ({cut("doc_id", "d", ["paragraph", "line"])})
SELECT doc_id, license_id, unit, place::BIGINT AS place, digest FROM u JOIN k USING (digest)"""
