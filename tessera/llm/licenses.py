"""Licence scan by canonical digest: whole texts, each line and each run of paragraphs as a text of its own, joined to known digests.

canonical() is column functions only; canonical_sql() is the same in SQL. Runs of paragraphs are cut in Python, by the
lengths of the known texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings that licence matching guidelines treat as equal, applied in this order after punctuation is gone.
SPELLINGS = [
    ("licence", "license"), ("organis", "organiz"), ("recognis", "recogniz"), ("utilis", "utiliz"), ("authoris", "authoriz"),
    ("favour", "favor"), ("behaviour", "behavior"), ("honour", "honor"), ("acknowledgement", "acknowledgment"), ("programme ", "program "),
    ("merchantib", "merchantab"), ("non infring", "noninfring"), ("sub license", "sublicense"), ("copyright owner", "copyright holder"),
    ("per cent", "percent"), ("whilst", "while"), ("https", "http"),
]
COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright[ \t]*(\(c\)|©|[0-9<\[]|by\b|,)|\(c\)|©|all rights reserved)[^\n]*$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The texts of short licences, without title and copyright line.
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
    "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
    "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not "
    "be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in "
    "the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must "
    "not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
    "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission. "
)
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEXTS = [
    ("MIT", f"{_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("MIT-0", f"{_GRANT}. {_AS_IS}"),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_AS_IS}"),
    ("0BSD", f"{_ISC}. {_ISC_AS_IS}"),
    ("Zlib", _ZLIB),
    ("BSD-2-Clause", _BSD + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_AS_IS),
]


# The headings that these texts usually carry.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT License (Expat)", "Expat License"],
    "MIT-0": ["MIT No Attribution", "MIT No Attribution License", "MIT-0", "MIT-0 License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "0BSD", "BSD Zero Clause License (0BSD)"],
    "Zlib": ["zlib License", "The zlib License", "The zlib/libpng License", "zlib/libpng License", "zlib License (Zlib)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "The 2-Clause BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Revised BSD License", "Modified BSD License", "The 3-Clause BSD License"],
}


# SHA-256 and length of the canonical full texts of longer licences, as their stewards publish them, title included.
LONG_TEXTS = [
    ("Apache-2.0", 9825, "adf220ee02537f83220e088f4488ca0e7557d614fac1cc48967b41d13911d6e0"),
    ("GPL-1.0", 11765, "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", 17117, "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", 33406, "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", 24130, "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", 25217, "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", 7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", 22338, "1aa0a43a3c08988f252eca070027f3381bee0c3772f5ea248ca44b04b2724cf1"),
    ("MPL-2.0", 14271, "92e88af3b436afcb6eef8128c9d1a7b2c6312377163ae31dfbacec094f33ab64"),
    ("GFDL-1.2", 19578, "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3", 22013, "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("CC0-1.0", 6691, "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("Artistic-1.0-Perl", 5833, "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
]


def full_texts() -> list[tuple[str, str]]:
    """(SPDX id, text) of the short licences, numbered or with bullets, without and with their titles."""
    out = []
    for spdx, text in TEXTS:
        for body in dict.fromkeys([text, re.sub(r"(?<= )[1-3]\. ", "", text)]):
            out += [(spdx, body), *((spdx, f"{title}\n{body}") for title in TITLES[spdx])]
    return out


def notices() -> list[tuple[str, str]]:
    """(SPDX id, one-line notice) for the families whose notices name an id and a version."""
    named = [("MIT", "MIT License", [""]), ("ISC", "ISC License", [""]), ("Zlib", "zlib License", [""]), ("Apache", "Apache License", ["2.0", "1.1"]),
             ("GPL", "GNU General Public License", ["2", "2.0", "3", "3.0"]), ("LGPL", "GNU Lesser General Public License", ["2.1", "3", "3.0"]),
             ("AGPL", "GNU Affero General Public License", ["3", "3.0"]), ("MPL", "Mozilla Public License", ["1.1", "2.0"]),
             *((f"CC-BY{k}", f"CC BY{k}", ["2.0", "3.0", "4.0"]) for k in ("", "-SA", "-ND", "-NC", "-NC-SA", "-NC-ND")), ("CC0", "CC0", ["1.0"])]
    out = []
    for family, name, versions in named:
        for v in versions:
            spdx = family + (f"-{v if '.' in v else v + '.0'}" if v else "")
            full = [name] if not v else [f"{name} {v}", f"{name}, version {v}"]
            out += [(spdx, f"{lead} {the}{x}") for lead in ("Licensed under", "Released under", "This work is licensed under", "Distributed under") for the in ("", "the ") for x in full]
            out.append((spdx, f"SPDX-License-Identifier: {spdx}"))
    return out


def canonical(text: Column) -> Column:
    """Lower case (A to Z), copyright lines dropped, runs of anything but letters and digits one space, spellings levelled, trimmed."""
    out = F.regexp_replace(F.translate(text, UPPER, LOWER), COPYRIGHT_LINE, "")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(out)


def canonical_sql(text: str) -> str:
    out = f"regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), '{COPYRIGHT_LINE}', '', 'g')"
    out = rf"regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return f"trim({out})"


def canonical_py(text: str) -> str:
    """canonical() for the known texts, which are ASCII."""
    out = re.sub(COPYRIGHT_LINE, "", text.translate(str.maketrans(UPPER, LOWER)))
    out = re.sub(r"[^a-z0-9]+", " ", out)
    for old, new in SPELLINGS:
        out = out.replace(old, new)
    return out.strip()


def known_digests() -> list[tuple[str, str]]:
    """(SHA-256 of the canonical text, SPDX id), a few hundred rows whatever the input."""
    made = {hashlib.sha256(canonical_py(t).encode()).hexdigest(): k for k, t in [*full_texts(), *notices()]}
    return sorted((made | {digest: k for k, _, digest in LONG_TEXTS}).items())


#: Every known canonical text holds one of these after lower-casing, so other lines can't match.
HINTS = "licen|permission|redistribution|released|distributed"


#: What parts paragraphs: one or more lines without letters and digits, those of comment signs too.
PARAGRAPHS = r"\n(?:[^\p{L}\p{N}\n]*\n)+"


def _runs(lengths: list[int]):
    """(doc_id, digest) of the runs of paragraphs, all but the whole text, that are as long as a known text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests = [], []
            for doc, paragraphs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole, starts, end = " ".join(paragraphs), [], 0
                for p in paragraphs:
                    starts.append(end)
                    end += len(p) + 1
                ends = {s - 1 for s in starts[1:]} | {end - 1}
                for s in starts:
                    for n in lengths:
                        if s + n in ends and n < len(whole):
                            ids.append(doc)
                            digests.append(hashlib.sha256(whole[s : s + n].encode()).hexdigest())
            yield pa.record_batch([pa.array(ids, batch.schema.field(0).type), pa.array(digests, pa.string())], ["doc_id", "digest"])

    return run


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known_texts: DataFrame | None = None) -> DataFrame:
    """(doc_id, license_id, scope, n_units): which known licences a document is (scope document), has as lines (scope line),
    or has as paragraphs next to each other, wrapped or not, but not as the whole text (scope paragraphs; full texts only).

    known_texts (license_id, text) adds to the texts known here. Null or empty texts match nothing; a null id is kept as null
    and shares one row per licence with other null ids. Repeated rows add up in n_units. Texts are matched whole, at any
    length; other columns are not read.
    """
    spark = docs.sparkSession
    rows = ", ".join(f"('{d}', '{k}')" for d, k in known_digests())
    known = spark.sql(f"SELECT * FROM VALUES {rows} AS known(digest, license_id)")
    lengths = {len(canonical_py(t)) for _, t in full_texts()} | {n for _, n, _ in LONG_TEXTS}
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    hinted = lambda x: F.translate(x, UPPER, LOWER).rlike(HINTS)
    if known_texts is not None:
        more = known_texts.select("license_id", canonical(F.col("text")).alias("own")).where("own <> ''").distinct()
        lengths |= {r[0] for r in more.select(F.char_length("own")).distinct().collect()}
        known = known.unionByName(more.select(F.sha2("own", 256).alias("digest"), "license_id")).distinct()
        hinted = lambda x: x.isNotNull()
    known, own = F.broadcast(known), own.where(hinted(F.col("text")))
    units = own.select("doc_id", F.explode(F.array(
        F.struct(F.lit("document").alias("scope"), F.array("text").alias("texts")),
        F.struct(F.lit("line").alias("scope"), F.filter(F.split("text", "\n"), hinted).alias("texts")),
    )).alias("u")).select("doc_id", "u.scope", F.explode("u.texts").alias("unit"))
    parts = F.filter(F.transform(F.split(F.regexp_replace("text", "\r", ""), PARAGRAPHS), canonical), lambda x: x != "")
    long_enough = own.where(F.char_length("text") > min(lengths)).select("doc_id", parts.alias("parts")).where(F.size("parts") > 1)
    kind = own.schema["doc_id"].dataType.simpleString()
    runs = long_enough.mapInArrow(_runs(sorted(lengths)), f"doc_id {kind}, digest string").select("doc_id", F.lit("paragraphs").alias("scope"), "digest")
    hit = units.select("doc_id", "scope", F.sha2(canonical(F.col("unit")), 256).alias("digest")).unionByName(runs).join(known, "digest")
    return hit.groupBy("doc_id", "license_id", "scope").agg(F.count(F.lit(1)).alias("n_units"))


def license_scan_sql() -> str:
    rows = ", ".join(f"('{d}', '{k}')" for d, k in known_digests())
    return f"""WITH known(digest, license_id) AS (VALUES {rows}),
units AS (SELECT doc_id, 'document' AS scope, text AS unit FROM documents
          UNION ALL SELECT doc_id, 'line', unnest(string_split(text, chr(10))) FROM documents),
hit AS (SELECT doc_id, scope, sha256({canonical_sql('unit')}) AS digest FROM units)
SELECT doc_id, license_id, scope, count(*) AS n_units FROM hit JOIN known USING (digest) GROUP BY ALL"""
