"""Licence scan by canonical digests: whole texts hash-joined to digests of known licences.

A text is brought to a canonical form (lower case, equivalent spellings, no
copyright lines, no punctuation, single spaces) and its SHA-256 is looked up
among the digests of known licence texts, which are made by the same
expression.  A document's lines are looked up too, each as an entire text, so
that notices such as "Released under the MIT License." are found inside longer
documents.  DataFrame operations only.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Public licence texts and standard notices.
KNOWN_LICENSES = [
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("MIT", "SPDX-License-Identifier: MIT"),
]

# Spellings that count as the same word, after lower-casing and removal of punctuation.
EQUIVALENT = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
              ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"),
              ("organisation", "organization"), ("favour", "favor"), ("per cent", "percent"), ("while", "whilst"),
              ("analogue", "analog"), ("centre", "center"), ("judgement", "judgment"), ("colour", "color")]

#: A line that only states a copyright (Java and RE2 agree on this pattern).
COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$"
NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, no ASCII punctuation, one spelling, single spaces; null stays null."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ\r", "abcdefghijklmnopqrstuvwxyz\n")
    plain = F.when(lower.rlike(COPYRIGHT_LINE), F.regexp_replace(lower, COPYRIGHT_LINE, " ")).otherwise(lower)
    # two spaces between words: each word has a space of its own on either side
    padded = F.concat(F.lit(" "), F.regexp_replace(plain, NOT_A_WORD, "  "), F.lit(" "))
    for spelling, standard in EQUIVALENT:
        padded = F.replace(padded, F.lit(f" {spelling} ".replace(" ", "  ")[1:-1]), F.lit(f" {standard} "))
    return F.trim(F.replace(padded, F.lit("  "), F.lit(" ")))


_CLAUSE_3 = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
             "derived from this software without specific prior written permission. ")
#: First lines that usually stand before a text, for the licences whose text has no title of its own.
HEADINGS = {
    "MIT": ["", "MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "ISC": ["", "ISC License", "The ISC License", "ISC License (ISC)"],
    "Zlib": ["", "zlib License", "The zlib License", "The zlib/libpng License"],
    "BSD-2-Clause": ["", "BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License"],
    "BSD-3-Clause": ["", "BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "BSD License"],
}


def license_texts() -> list[tuple[str, str]]:
    """(license, text): KNOWN_LICENSES, their whole texts under the usual headings, and the texts of the folder ``licenses``."""
    bodies = [(name, text) for name, text in KNOWN_LICENSES if len(text) > 500 and not text.startswith("MIT License")]
    two = dict(bodies)["BSD-2-Clause"]
    bodies.append(("BSD-3-Clause", two.replace("THIS SOFTWARE IS", _CLAUSE_3 + "THIS SOFTWARE IS", 1)))
    for name, text in bodies[:]:
        if name.startswith("BSD"):
            bodies.append((name, text.replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR")))
    for name, text in bodies[:]:      # lists with bullets
        if name.startswith("BSD"):
            bodies.append((name, re.sub(r"\b[123]\. ", "* ", text)))
    out = list(KNOWN_LICENSES)
    for name, text in bodies:
        out += [(name, f"{heading}\n{rights}\n{text}") for heading in HEADINGS[name] for rights in ("", "All rights reserved.")]
    for file in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        text = file.read_text()
        out.append((file.stem, text))
        # In other line breaks, no line of a sentence may start with "copyright".
        paragraphs = re.split(r"\n[ \t]*\n", text)
        out.append((file.stem, "\n".join(" ".join(p.split()) for p in paragraphs)))
    return out


def known_digests(licenses: DataFrame) -> DataFrame:
    """(canonical_sha256, license) of the known texts ``licenses (license, text)``; of licences with equal texts the first by name."""
    return (licenses.where("text IS NOT NULL").select(F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256"), "license")
            .groupBy("canonical_sha256").agg(F.min("license").alias("license")))


def license_scan(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, canonical_sha256, license, notices.

    ``licenses (license, text)``: the known texts, ``license_texts()`` by default.
    ``license``: the licence whose entire text the document is, else null.
    ``notices``: sorted distinct licences of which some line of the document is
    the entire text (empty array if none).  A null text has a null digest, no
    licence and no notices; a text without words has the digest of the empty
    string.  Rows are only projected, joined to the known digests (broadcast) and,
    per row, filtered: the documents are not shuffled.
    """
    spark = docs.sparkSession
    if licenses is None:
        licenses = spark.createDataFrame(license_texts(), "license string, text string")
    # The digests (one row a known text) pass the driver; for the line lookups they are one constant map.
    rows = [(r["canonical_sha256"], r["license"]) for r in known_digests(licenses).collect()]
    known = spark.createDataFrame(rows, "_digest string, license string")
    lookup = F.create_map(*[F.lit(x) for row in rows for x in row]).cast("map<string,string>")
    lines = F.filter(F.split(F.col("text"), r"[\r\n]+"), lambda x: x.rlike("(?i)licen[cs]e|released under|spdx|permission|redistribution"))
    found = F.filter(F.transform(lines, lambda x: F.element_at(lookup, F.sha2(canonical(x), 256))), lambda x: x.isNotNull())
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256"),
                        F.col("text"))
    return (whole.join(F.broadcast(known), whole["canonical_sha256"] == known["_digest"], "left")
            .select("doc_id", "canonical_sha256", "license",
                    F.coalesce(F.array_sort(F.array_distinct(found)), F.array().cast("array<string>")).alias("notices")))
