r"""Licence scans by canonical digest.

A text's normal form: ASCII letters lower-cased; lines that state a copyright (or reserve all rights) dropped;
everything but letters and digits turned into single blanks; equivalent spellings made one; outer blanks removed.  The
SHA-256 of the normal form is looked up, by hash join, among the digests of known licence texts.  Whole documents are
looked up among licence texts, and each of their lines (short of a licence, but the usual way to apply one) among
known notices.

The known digests are a table (licence, unit, digest) that callers may replace; the default holds those of the texts
and notices below and, as digests alone, of longer licences in full (``DIGESTS``), each with and without what follows
its terms.  ``digest_table`` makes one of any texts.

Scale: one pass over the texts in JVM expressions, no shuffle: a table of at most ``MOST_KNOWN`` digests is sent to every
task, a larger one is joined by shuffle.  Matching rows alone are returned.

Cost: a text whose lower-cased form holds none of a few letter runs (``marks``), one of which every known text has, can't
match and is not brought to its normal form; all others are, whole and line by line.  Without marks all texts are.

Edge cases: null text matches nothing; an empty normal form is no licence; rows that repeat give rows that repeat; a
document may match as a text and by several lines.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Digests that are sent to every task, at most.
MOST_KNOWN = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Patterns that Java, RE2 and Python read alike; applied in this order.
RULES = [
    (r"(^|\n)[ \t*#/;-]*(copyright|\(c\)|©|all rights reserved)[^\n]*", "\n"),
    (r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "),
    (r"\blicence", "license"),
    (r"\bsub license", "sublicense"),
    (r"\bnon commercial", "noncommercial"),
    (r"\bnon infringement", "noninfringement"),
    (r"\bhttp ", "https "),
    (r"\bthe above copyright holder", "the above copyright owner"),
    (r"\bversion ([0-9])", "v\\1"),
    (r"\bv ([0-9])", "v\\1"),
    (r"\bgnu general public license\b", "gpl"),
    (r"\bapache license\b", "apache"),
    (r"\bcreative commons\b", "cc"),
]

# Published licence texts and notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_0BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies.", ".")
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
TEXTS = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("0BSD", _0BSD),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Zlib", _ZLIB),
    ("Apache-2.0", _APACHE_NOTICE),
    ("GPL-3.0-or-later", _GPL_NOTICE),
]
#: Digests of the normal forms of whole published licence texts; where a licence has an appendix on how to
#: apply it, also without the appendix, with and without the line that ends its terms.
DIGESTS = [
    ("Apache-2.0", "3cf46dadc205aa30002eb651069697f6504055185631cd472553ff1b06cd093e"),
    ("Apache-2.0", "c26733c3ba33bbf06cee3f1d0b40106ec0ac69c5c15d461e5c39d4de63a0b851"),
    ("Apache-2.0", "50ba51e2fd06eb496fc802fb2738a54f85ae3f07fe8ce1ae76de35e21478f5c0"),
    ("Artistic-1.0", "7a014cb9a40d2fe952c1b8eae0040ad4e5abbe0dfef51573876d7457517eef27"),
    ("CC0-1.0", "85fe8c5f6c898b7b7bdfb62efa4192f21f8c92b0d94d318e4a52dc7de615fc93"),
    ("GFDL-1.2", "1e0799dbe013b893e0f8366ca347564b369a20cdbb071ba0e4dce07d71915360"),
    ("GFDL-1.3", "2760531842edbf5ec38b8560f472645a595c6650cc491b725add51d9bcbe12cb"),
    ("GPL-1.0", "227cd29a65dab6ee00f6b779e50499f35a0c46ed2f7cbd294ef3ba077075007f"),
    ("GPL-1.0", "c45ed589e970c60e369b51abe8aa58f6cb7ed805117ad22e7d25f11f01fc2d52"),
    ("GPL-1.0", "4465b79d18dd5dc59fd4e1b153dc5ab04381d3c8500c403db9e2c7b2eddb760b"),
    ("GPL-2.0", "2f537d14620b2de21eeeeb629c3c7207e71044c5bdf3fe315c8af51cee3ca92c"),
    ("GPL-2.0", "6c7ba36af5e5bb7b859c343603254d38a4095c3954a0f6b2a11fa28563a7a365"),
    ("GPL-2.0", "21d54888ca73a9fabc0b12a87a74d4a147c16fdabbe4526993a79395328366ab"),
    ("GPL-3.0", "23929444ff76c71d549a33db37d697688efe77eff180a76483bce8768bd7b897"),
    ("GPL-3.0", "3e156fe8020d26d54dbf7bfa627ddc6134b6879c2b812ee364877fd1a2181156"),
    ("GPL-3.0", "6a01e67a8415075cea94ffb8680535c07bfddc30182e9876ef88edb47d506add"),
    ("LGPL-2.0", "1b2051ca361c0870e071cc4ecdd807ce16b0785e082978314ea3d28fb5bc4d0f"),
    ("LGPL-2.0", "02e051b343d483f3fd190271e1cfd937585328c3f945a90b8ed6a7e428ad1be2"),
    ("LGPL-2.0", "b0d4e4f2e637261d3739f1c2fa12cc9f00c54334ea787b4da9c6584dc7268635"),
    ("LGPL-2.1", "39a05c8b924163302753055fcb6073c2e20bdb81ee0c58047edeecde6202fc20"),
    ("LGPL-2.1", "47b3e18673966595fdb14a882bf6c15d4da7a0816fccbfe4d4431ec5631ef54a"),
    ("LGPL-2.1", "7acfac256bb885cb8fa10f8bd6e07b2a3aee5715fce1f0b1957de713f9499c0f"),
    ("LGPL-3.0", "4df2d113ee825ef23660104d6f246ff8ed2b29136e2cd6808361a218967aa148"),
    ("MPL-1.1", "32e581cffc3aa02e6fa6e816f75c67d1e9bdb0dcb4898bcb570736c1b7365fa6"),
    ("MPL-2.0", "b7d0a357d4f6b68c43ba94b463b1991225e50a4b8b2e5e80b4871d3f3cf59d56"),
    ("MPL-2.0", "fc384032b1d5ecb57608d2f7a9075b7fc62fdc5b84c56a71776fec0f6bc9ba60"),
    ("Unlicense", "8d3909f4543649cfba0b0b1fc765c67acf3736106a78237ea2972f83eaa7dd3e"),
]
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
]
#: Every known text has one of these in its normal form, and the rules neither make nor join letters: a text without any
#: of them can't match.
MARKS = ["licen", "permission", "redistribut", "released"]
SPDX = ["MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-3.0-only", "MPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"]


def normal_form(text: str) -> str:
    """The normal form in Python, for the known texts and for tests."""
    text = text.translate(str.maketrans(UPPER, LOWER))
    for pattern, to in RULES:
        text = re.sub(pattern, to, text, flags=re.ASCII)
    return text.strip(" ")


def known() -> list[tuple[str, str, str]]:
    """licence, unit, digest of what can be found."""
    rows = [(name, "text", text) for name, text in TEXTS] + [(name, "line", text) for name, text in NOTICES]
    rows += [(name, "line", f"SPDX-License-Identifier: {name}") for name in SPDX]
    return sorted(set(digest_table(rows)) | {(name, "text", digest) for name, digest in DIGESTS})


def digest_table(texts: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """licence, unit, digest of texts given as licence, unit (text or line), text."""
    return [(name, unit, hashlib.sha256(normal_form(text).encode()).hexdigest()) for name, unit, text in texts]


def normalised(text: Column) -> Column:
    out = F.translate(text, UPPER, LOWER)
    for pattern, to in RULES:
        out = F.regexp_replace(out, pattern, to.replace("\\1", "$1"))
    return F.trim(out)


def scan(docs: DataFrame, digests: DataFrame | None = None, marks: list[str] | None = None) -> DataFrame:
    """doc_id, unit (text or line), line (from 1; 0 for the text), licence for each match.

    ``digests``: licence, unit, digest of what is known; ``marks``: letter runs one of which each of these texts has in
    its normal form, none if that is not known.
    """
    if digests is None:
        digests, marks = docs.sparkSession.createDataFrame(known(), "licence string, unit string, digest string"), MARKS
    table = digests.select("licence", F.col("unit").alias("kind"), "digest")
    table = F.broadcast(table) if table.limit(MOST_KNOWN + 1).count() <= MOST_KNOWN else table
    has_mark = lambda text: F.translate(text, UPPER, LOWER).rlike("|".join(map(re.escape, marks))) if marks else F.lit(True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    # the marks are looked for in every whole text and line; only what has one is brought to its normal form
    marked = rows.where(has_mark(F.col("text")))
    whole = marked.select("doc_id", F.lit("text").alias("unit"), F.lit(0).alias("line"), F.col("text").alias("part"))
    lines = marked.select("doc_id", F.lit("line").alias("unit"), F.posexplode(F.split("text", "\n", -1)).alias("line", "part")).withColumn("line", F.col("line") + 1)
    parts = whole.unionByName(lines.where(has_mark(F.col("part")))).withColumn("digest", F.sha2(normalised(F.col("part")).cast("binary"), 256))
    return parts.join(table, ["digest"]).where(F.col("kind") == F.col("unit")).select("doc_id", "unit", "line", "licence")
