"""Licence scans by canonical digest, in DataFrame operations only.

A text is brought to canonical form (lower case, no copyright lines, equivalent spellings made
one, no punctuation, single spaces, so line breaks don't matter) and its digest looked up in a table of known
licences: an equality join, whatever the number of licences. The same is done for every line of a text, so
that a notice inside a longer text is found as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.shared import bounded, written

#: Words that count as one spelling when licence texts are compared.
SPELLINGS = [
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("licencing", "licensing"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("acknowledgement", "acknowledgment"),
    ("acknowledgements", "acknowledgments"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("behaviour", "behavior"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("modelled", "modeled"),
    ("noncommercial", "non commercial"),
    ("recognised", "recognized"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT = f"{_GRANT}, subject to the following conditions:\n\n{_NOTICE}\n\n{_AS_IS}"
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_CLAUSES = [
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
]
_BSD_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)


def _bsd(n: int, mark: str) -> str:
    """The first ``n`` clauses, each with its number or bullet."""
    listed = "\n\n".join(f"{mark.format(k)}{clause}" for k, clause in enumerate(_BSD_CLAUSES[:n], 1))
    return f"{_BSD_GRANT}\n\n{listed}\n\n{_BSD_AS_IS}"


#: Licence texts and notices by licence. Copyright lines are no part of them; titles, where usual, make a second entry.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", _MIT),
    ("MIT", f"MIT License\n\n{_MIT}"),
    ("MIT", f"The MIT License\n\n{_MIT}"),
    ("MIT", f"The MIT License (MIT)\n\n{_MIT}"),
    ("MIT-0", f"{_GRANT}.\n\n{_AS_IS}"),
    ("MIT-0", f"MIT No Attribution\n\n{_GRANT}.\n\n{_AS_IS}"),
    ("BSD-2-Clause", _bsd(2, "{}. ")),
    ("BSD-2-Clause", _bsd(2, "* ")),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_bsd(2, '{}. ')}"),
    ("BSD-3-Clause", _bsd(3, "{}. ")),
    ("BSD-3-Clause", _bsd(3, "* ")),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_bsd(3, '{}. ')}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_bsd(3, '* ')}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\n"
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\n"
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\n"
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    (
        "ISC",
        f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_AS_IS}",
    ),
    (
        "ISC",
        f"ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_AS_IS}",
    ),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_ISC_AS_IS}"),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n"
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain.\n\n"
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\n"
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\n"
        "For more information, please refer to <https://unlicense.org>",
    ),
    (
        "BSL-1.0",
        "Boost Software License - Version 1.0 - August 17th, 2003\n\n"
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, "
        "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\n"
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
        "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("BSD", "Use of this source code is governed by a BSD-style license."),
]

#: Digests of the canonical form of long licence texts, as their stewards publish them. To be made anew
#: (``digest_of(canonical_lines(text))``) with every change of the canonical form.
DIGESTS = [
    ("Apache-2.0", "ff7be961361eda3cd2a76927dd0d9482cf45defafde2045befedf77400d98100"),
    ("Artistic-1.0-Perl", "de5e8896b763918701eb91e7bf8bf81f20a97c9f8dd1cacc44519e47d3462bf8"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "835e93c269f96ffb287b3c8c1c5d41482a48fe84971237b192ae3d0f85299142"),
    ("GFDL-1.3", "2d23a1792689607291f114da9fdb3b413c6ef2346dfb9e4fafe0c5cf9b969da3"),
    ("GPL-1.0", "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a"),
    ("GPL-2.0", "c230c00f329737cb7ce3d97a266318b4c9d4c1fd321335e592b2ce1112179b88"),
    ("GPL-3.0", "f3ab5ee40da170411ea6671f9845ada2aaba303ee57ba6086b373d1e66c9dc3f"),
    ("LGPL-2.0", "e2c319279ddf282349927826fd110bdb5b471edc3a726a66fe333c8184a4b135"),
    ("LGPL-2.1", "13cd11e9ccd3aae212d64d9b0f62b3a67f21019c6a65212e582b2cbbeb91cb70"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
]

_COPYRIGHT = r"(?im)^[^\S\n]*(?:copyright\b|\(c\)|©)[^\n]*$|^[^\S\n]*all rights reserved\.?[^\S\n]*$"
_PUNCTUATION = r"[^0-9a-z\n\x{80}-\x{10FFFF}]+"
_SPELLED = r"\b(?:" + "|".join(a for a, _ in SPELLINGS) + r")\b"


def _plain(text: Column) -> Column:
    """Lower case, without copyright lines, what is no letter or digit as one space; line ends stay."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), _COPYRIGHT, "")), _PUNCTUATION, " ")


def _lines(plain: Column) -> Column:
    spelled = F.create_map(*[F.lit(x) for pair in SPELLINGS for x in pair])
    lines = F.filter(F.transform(F.split(plain, "\n"), lambda line: F.trim(line)), lambda line: line != "")
    same = F.transform(lines, lambda line: F.when(line.rlike(_SPELLED), F.array_join(F.transform(F.split(line, " "), lambda w: F.coalesce(spelled[w], w)), " ")).otherwise(line))
    return F.when(plain.rlike(_SPELLED), same).otherwise(lines)


def canonical_lines(text: Column) -> Column:
    """array<string>: the lines of a text in canonical form, without those of which nothing is left."""
    return _lines(_plain(text))


def canonical_rows(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(__id, __lines): each step uses the last one's column more than once, so Spark keeps the projections apart and runs each once a row."""
    return docs.select(F.col(id).alias("__id"), _plain(F.col(text)).alias("__plain")).select("__id", _lines(F.col("__plain")).alias("__lines"))


def digest_of(lines: Column) -> Column:
    return F.sha2(F.array_join(lines, " "), 256)


def known_licenses(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest, license, n_chars: one row for each digest (the first licence by name where two share a canonical text).

    n_chars is null for licences of which only the digest is listed: those are no single lines.
    """
    rows = spark.createDataFrame(KNOWN if known is None else known, "license string, body string").select("license", F.array_join(canonical_lines(F.col("body")), " ").alias("body"))
    rows = rows.select(F.sha2("body", 256).alias("digest"), "license", F.length("body").alias("n_chars"))
    if known is None:
        rows = rows.union(spark.createDataFrame([(d, name) for name, d in DIGESTS], "digest string, license string").withColumn("n_chars", F.lit(None).cast("int")))
    return rows.groupBy("digest").agg(F.min("license").alias("license"), F.min("n_chars").alias("n_chars"))


def scan(docs: DataFrame, known: DataFrame | None = None, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, digest, license (of the whole text), n_license_lines, line_licenses.

    ``license`` is null where the whole text is no known one; ``line_licenses`` lists the licences
    of single lines by name, each once, and n_license_lines counts such lines. Null and empty
    texts have the digest of the empty text and no licence. Repeated rows and null ids each give
    a row. Further columns are ignored. Of several licences with one digest in ``known``, the first
    by name counts.

    A text is brought to canonical form once; what is kept of it is its digest and those of lines that are
    as long as some known text, whose number follows the licences, not the text. Lines are looked up once for
    each distinct canonical text. Both lookups are equality joins, by broadcast while the smaller side is short.
    """
    known = known if known is not None else known_licenses(docs.sparkSession)
    known = bounded(written(known.groupBy("digest").agg(F.min("license").alias("license"), F.min("n_chars").alias("n_chars")), "known"))
    lengths = [r.n_chars for r in known.where("n_chars IS NOT NULL").select("n_chars").distinct().limit(MOST_LENGTHS + 1).collect()]
    fits = (lambda line: F.length(line).isin(lengths)) if len(lengths) <= MOST_LENGTHS else (lambda line: F.lit(True))
    rows = canonical_rows(docs, id, text)
    rows = rows.select("__id", digest_of(F.col("__lines")).alias("digest"), F.transform(F.filter("__lines", fits), lambda line: F.sha2(line, 256)).alias("__line_digests"))
    rows = written(rows, "canonical")
    lines = rows.where(F.size("__line_digests") > 0).groupBy("digest").agg(F.first("__line_digests").alias("lines")).select(F.col("digest").alias("__of"), F.explode("lines").alias("digest"))
    by_text = lines.join(known.select("digest", "license"), "digest").groupBy("__of").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("names"))
    by_text = bounded(written(by_text, "lines"))
    whole = rows.join(known.select("digest", "license"), "digest", "left").join(by_text, F.col("digest") == F.col("__of"), "left")
    return whole.select(F.col("__id").alias(id), "digest", "license", F.coalesce("n", F.lit(0)).cast("long").alias("n_license_lines"), F.coalesce("names", F.lit("")).alias("line_licenses"))


#: More different lengths than this are no filter worth having; all lines are then hashed.
MOST_LENGTHS = 2000
