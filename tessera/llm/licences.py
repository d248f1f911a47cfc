"""Licence scans by canonical digest lookup, in DataFrame functions only.

An entire text is put into canonical form: lower case, without copyright lines, with one
spelling for words that have several, and with punctuation and white space as single blanks.
The SHA-256 digest of this form is hash-joined with the digests of known licence texts and
notices. Each line of a text is looked up as well, as a text of its own, so that a notice in a
longer document is found.

The known texts are a short list that comes with the operator, so its side of the join is
broadcast; a longer list passed as a DataFrame is joined as Spark sees fit. Canonical form is dear,
so with the short list only texts are put into it whose *skeleton* is that of a known text: what
is left, copyright lines aside, of the signs that no rule of spelling writes, removes or changes. Texts
with one canonical form have one skeleton, so no match is lost (tested). The skeleton of a text's
beginning begins the skeleton of the text, so most texts are settled by their first ``PROBE`` signs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.batches import only

#: Some known licences and the usual one-line notices.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-licensed": "Licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0-notice": "Licensed under CC0 1.0.",
    "MPL-2.0-notice": "Licensed under the Mozilla Public License, Version 2.0.",
    "BSD-3-Clause-notice": "Licensed under the BSD 3-Clause License.",
}
# the three-clause licence is the two-clause one with a clause more
KNOWN["BSD-3-Clause"] = KNOWN["BSD-2-Clause"].replace(
    "\nTHIS SOFTWARE",
    "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE",
)
# two licences that leave out a condition of another one
KNOWN["0BSD"] = KNOWN["ISC"].replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
KNOWN["MIT-0"] = KNOWN["MIT"].split("\n")[0].replace(", subject to the following conditions:", ".") + "\n" + KNOWN["MIT"].split("\n")[2]
KNOWN["Unlicense"] = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <http://unlicense.org/>"""
#: What each alternative of COPYRIGHT_LINE has, so lines without any need no search.
HOLDER_SIGNS = ["copyright", "(c)", "©", "all rights reserved"]
#: Lines that name a holder, in lower case, up to the end of the line.
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright *(\(c\)|©|[0-9<\[])|\(c\) *[0-9]|©|all rights reserved)[^\n]*"
#: Spellings that count as one, applied in this order to lower-case text.
SPELLINGS = [
    (r"licenc(e|es|ed|ing|or)\b", r"licens\1"),
    (r"sub[- ]licens", r"sublicens"),
    (r"non[- ](commercial|infringement)", r"non\1"),
    (r"([a-z]{3})is(e|ed|es|ing|ation|ations)\b", r"\1iz\2"),
    (r"([a-z]{2})our\b", r"\1or"),
    (r"dgement", r"dgment"),
    (r"copyright (holder|owner)", r"copyright owner"),
    (r"https?://", r"http://"),
    (r"\bv(er|ersion)?\.? *([0-9])", r"version \2"),
]
#: Signs that none of SPELLINGS writes, removes or changes; canonical form keeps them all.
UNTOUCHED = "abfgjkmpqtxy0123456789"
#: Signs of a text's beginning whose skeleton is looked at before the whole text's.
PROBE = 64


def _java(replacement: str) -> str:
    return re.sub(r"\\(\d)", r"$\1", replacement)


def _without_holders(low: Column) -> Column:
    """A text in lower case without its copyright lines."""
    some = F.contains(low, F.lit(HOLDER_SIGNS[0]))
    for sign in HOLDER_SIGNS[1:]:
        some = some | F.contains(low, F.lit(sign))
    return F.when(some, F.regexp_replace(low, COPYRIGHT_LINE, "\n")).otherwise(low)


def _canonical(low: Column) -> Column:
    out = _without_holders(low)
    for pattern, replacement in SPELLINGS:
        out = F.regexp_replace(out, pattern, _java(replacement))
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def canonical(text: Column) -> Column:
    """The canonical form of an entire text."""
    return _canonical(F.lower(text))


def _untouched(low: Column) -> Column:
    return F.regexp_replace(low, f"[^{UNTOUCHED}]+", "")


def skeleton(text: Column) -> Column:
    """The untouched signs of a text; equal for texts with one canonical form."""
    return _untouched(_without_holders(F.lower(text)))


def _has_skeleton(low: Column, skeletons: list[str]) -> Column:
    """Whether the skeleton of a text in lower case is one of ``skeletons``."""
    beginnings = "".join(sorted({"\n" + k[:PROBE] for k in skeletons}))
    begins = F.contains(F.lit(beginnings), F.concat(F.lit("\n"), _untouched(F.substring(_without_holders(low), 1, PROBE))))
    return F.when(begins, _untouched(_without_holders(low)).isin(skeletons)).otherwise(F.lit(False))


def canonical_sql(text: str) -> str:
    """The same in DuckDB's SQL."""
    out = f"regexp_replace(lower({text}), '{COPYRIGHT_LINE}', chr(10), 'g')"
    for pattern, replacement in SPELLINGS:
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _digest(low: Column, skeletons: list[str] | None = None) -> Column:
    """Digest of the canonical form of a text in lower case; null for an empty form and for
    skeletons that no known text has."""
    form = _canonical(low)
    digest = F.when(form != "", F.sha2(form, 256))
    return digest if skeletons is None else F.when(_has_skeleton(low, skeletons), digest)


def _texts(spark: SparkSession, known: dict[str, str] | DataFrame | None) -> DataFrame:
    """(licence_id, text) of the known texts."""
    if isinstance(known, DataFrame):
        return known.select("licence_id", "text")
    pairs = [F.struct(F.lit(k).alias("licence_id"), F.lit(v).alias("text")) for k, v in (KNOWN if known is None else known).items()]
    return spark.range(1).select(F.inline(F.array(*pairs))) if pairs else spark.createDataFrame([], "licence_id string, text string")


def known_digests(spark: SparkSession, known: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """(digest, licence_id); of names with one canonical text the first in order counts."""
    rows = _texts(spark, known).select("licence_id", _digest(F.lower("text")).alias("digest"))
    return rows.where("digest IS NOT NULL AND licence_id IS NOT NULL").groupBy("digest").agg(F.min("licence_id").alias("licence_id"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """One row per input row: doc_id, licence_id, notices.

    licence_id names the known text that the entire text equals in canonical form, or is null;
    notices lists the names that single lines equal, sorted, once each ("" if none). Null and
    empty texts match nothing; texts of any length, repeated rows and other columns need no care;
    an empty table gives an empty result, an empty list of known texts finds nothing. A known text
    whose canonical form is empty can't be found.
    """
    spark = df.sparkSession
    digests, skeletons = known_digests(spark, known), None
    if not isinstance(known, DataFrame):  # a short list by its type: it came with the plan
        digests = F.broadcast(digests)
        skeletons = sorted({r[0] for r in _texts(spark, known).select(skeleton(F.col("text"))).collect()})
    rows = only(df, doc_id=id_col, text=text_col).select("doc_id", F.lower("text").alias("low"))
    line_digests = F.transform(F.split("low", "\n", -1), lambda x: _digest(x, skeletons))
    marked = rows.select("doc_id", _digest(F.col("low"), skeletons).alias("digest"), F.array_compact(F.array_distinct(line_digests)).alias("line_digests"))
    whole = marked.join(digests, "digest", "left").select("doc_id", "licence_id", "line_digests")
    if isinstance(known, DataFrame):
        sets = whole.select("line_digests").where(F.size("line_digests") > 0).distinct()
        found = sets.select("line_digests", F.explode("line_digests").alias("digest")).join(digests, "digest").groupBy("line_digests").agg(F.sort_array(F.collect_set("licence_id")).alias("names"))
        return whole.join(found, "line_digests", "left").select("doc_id", "licence_id", F.coalesce(F.array_join("names", ","), F.lit("")).alias("notices"))
    # the short list as a literal: a lookup for each line's digest
    table = [F.lit(x) for r in digests.collect() for x in (r["digest"], r["licence_id"])]
    if not table:
        return whole.select("doc_id", "licence_id", F.lit("").alias("notices"))
    names = F.transform(F.coalesce("line_digests", F.array()), lambda x: F.try_element_at(F.create_map(*table), x))
    return whole.select("doc_id", "licence_id", F.array_join(F.array_sort(F.array_distinct(F.filter(names, lambda n: n.isNotNull()))), ",").alias("notices"))


def scan_sql(table: str = "documents") -> str:
    """``scan`` with the built-in list, in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in KNOWN.items())
    return f"""
    WITH k AS (SELECT min(id) AS licence_id, {canonical_sql("t")} AS form FROM (VALUES {known}) v(id, t) GROUP BY form),
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM {table}),
    n AS (SELECT l.doc_id, string_agg(DISTINCT k.licence_id, ',' ORDER BY k.licence_id) AS notices
          FROM l JOIN k ON {canonical_sql("l.line")} = k.form GROUP BY l.doc_id)
    SELECT d.doc_id, k.licence_id, coalesce(n.notices, '') AS notices
    FROM {table} d LEFT JOIN n ON n.doc_id = d.doc_id
    LEFT JOIN k ON {canonical_sql("d.text")} = k.form
    """
