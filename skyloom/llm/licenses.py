"""License scans (operator 1, native): digests of canonical texts, joined to the digests of known licences.

A *unit* is an entire text: the whole document, each paragraph of it (between blank lines), each line, and each run of
consecutive paragraphs that is as long as a known licence of several paragraphs. Paragraphs and runs are also taken of
the text as its comments stand (``comment_blocks``): comment signs at the start of lines go, and a paragraph ends where a
block comment begins or ends and where lines with a comment sign meet lines without.
Canonical form: lower case; copyright lines and list markers (``1.``, ``(a)``, bullets) go; equivalent spellings become
one; every run of characters that are neither letters nor digits becomes one space; the places where a licence names
its holder (``SLOTS``) say the same whoever it is. The SHA-256 of a unit's canonical form is hash-joined with the
digests of the known licences, which are made by the same expressions; that of a run is taken over the digests of its
paragraphs, each made once, without those in which nothing is left. Everything is DataFrame functions.

A text can only match if it holds a word that each known licence has (``MARKERS``); rows without one skip the
normalisation. ``registry`` checks this property of the known licences, so no match is lost.

Known licences are texts (``KNOWN``, more with ``known``), with and without their title, and long ones by their digests
alone (``LONG``). The registry is broadcast: its size is that of these lists, whatever the corpus (checked by ``registry``).

Defined cases: null and empty texts have no units and so no licence; units with one canonical form count once; a
unit with that of the whole text, and the run of all paragraphs of the whole, count as ``whole`` only; extra columns are ignored; keys
may repeat or be null, each row has its own result row; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Known licence texts and notices, as published.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "0BSD",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "BSL-1.0",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
)
# Titles that stand above the texts of KNOWN.
TITLES = (
    ("MIT", "MIT License"),
    ("MIT", "The MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("ISC", "ISC License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("0BSD", "BSD Zero Clause License"),
    ("Zlib", "zlib License"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
)
# Full texts as published; paragraphs of the canonical form, its digest, and the digest over those of its paragraphs.
LONG = (
    ("Apache-2.0", 33, "b74773cc32bd9891cf3b6f2cbffee6ba250305f332fe5bf8f80de7f62570d885", "409cc8858bcec9b74413ed0e4caa61e6381af935aa2b1359051f44a5755b77de"),
    ("Artistic-1.0", 29, "b06eda62b7e0c69e6f8a5960610095b69349654af941a79eca834edcd5e64e49", "9cda28846eadee6ae0591bc2659266253c05647f69f3b6a4bdff487f84e7991f"),
    ("CC0-1.0", 13, "d1f73cfb8c84d854460df0cdbd9dfd52af55932e051bb01f837c98b510e0bcdc", "fa3a54d6908afa17b06903585efd2b6e600712677aa85249d4546bbd534b6f13"),
    ("GFDL-1.3", 67, "e7b59b688b1712f9dce09b7c35422aeac689c25333780d26ec6928a9dc056892", "142edc5d7727549a9515f6bb76cddcc9bb76324a439bfae5ee4e0ff4b4258616"),
    ("GPL-2.0", 59, "48aa1cc09278c990143598f5c37c848606b728a4babb43c5f55e16bc66206c59", "d46560d7841a4962b24dd2d5af02ab358f76015471f25813312807e4d9325abc"),
    ("GPL-3.0", 122, "86eda099cbf0d22186ac221b176c2488450c7cb186a4d2abcd0920de5c2cc7ba", "6dd32d7e0d8a96f88a9fe1c29800ef9d31383ca396f16a109973f76ecd91eac6"),
    ("LGPL-2.1", 76, "0ca5c17aaa8deceea63b6afae195c7b8e4c2457d104e2a35bb62009f9d4d603b", "5e7e6ceff396b793ad6b028ee79053472cb9a13ba9d5a59b7b2fbcf8e69396e7"),
    ("LGPL-3.0", 37, "6a1e21cb1f0adda77c68071a8eeadb804a92ffdcaa150c17f976711652333fa0", "0e5880f79b7cba03344c75abbbac6e869ee9f3dd9a5cc93859e4aaf10053a4e4"),
    ("MPL-2.0", 81, "83b881818f64a5a604eac40dee859b955028dd48eb637becace2c63739abca5a", "9e1c0bac38398057908748fbdb9dc489146c26bf54470a9685051bcce3ee45dd"),
)
# Equivalent spellings, after lower case and before punctuation goes.
SPELLINGS = (
    ("licence", "license"),
    ("https://", "http://"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("noncommercial", "non-commercial"),
    ("copyright owner", "copyright holder"),
    ("per cent", "percent"),
    ("sub-license", "sublicense"),
    ("non-infringement", "noninfringement"),
)
#: Each known licence holds one of these in lower case, the long ones too.
MARKERS = ("licen", "permi")
COPYRIGHT_LINE = r"(^|\n)[^\p{L}\p{N}©\n]*(?:copyright[ \t]+(?:\(c\)|©|[0-9]{4}|by )|©|\(c\) *[0-9]|all rights reserved)[^\n]*"
LIST_MARKER = r"(^|[ \t\r\n(])(?:[0-9]{1,2}[.)]|[a-z][)])[ \t\r\n]"
# Places that name the holder, in the canonical form, of 40 words at most, and what stands for them.
SLOTS = (
    (r"neither the names? of (?:[^ ]+ ){1,40}?nor the names of (?:its|their) contributors", "neither the name of holder nor the names of its contributors"),
    (r"this software is provided by (?:[^ ]+ ){1,40}?as is and any", "this software is provided by holder as is and any"),
    (r"in no event shall (?:[^ ]+ ){1,40}?be liable", "in no event shall holder be liable"),
)
PARAGRAPHS = r"\n[ \t\r]*\n"
# Where block comments begin and end, and first lines that name an interpreter; signs of comment lines; signs that start a line inside a comment.
EDGES = r"^#![^\n]*|/[*]+|[*]+/|<!--+|--+>|\"\"\"|\'\'\'|[(][*]|[*][)]|[{]-|-[}]"
COMMENT_LINE = r"^[ \t]*(?:[#;%]|//|--)"
SIGNS = r"^[ \t]*(?:[#;%*]+|//+|--+)"
MAX_KNOWN = 10_000
#: Digest of a paragraph of which nothing is left.
NOTHING = hashlib.sha256(b"").hexdigest()


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty if nothing is left."""
    out = F.regexp_replace(F.lower(text), F.lit(COPYRIGHT_LINE), F.lit("\n"))
    out = F.regexp_replace(out, F.lit(LIST_MARKER), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.trim(F.regexp_replace(out, F.lit(r"[^\p{L}\p{N}]+"), F.lit(" ")))
    for named, same in SLOTS:
        out = F.regexp_replace(out, F.lit(named), F.lit(same))
    return out


def comment_blocks(text: Column) -> Column:
    """A text without comment signs, with a blank line at each edge of a comment."""
    lines = F.split(F.regexp_replace(text, F.lit(EDGES), F.lit("\n\n")), "\n")

    def line(here: Column, before: Column) -> Column:
        bare = F.regexp_replace(here, F.lit(SIGNS), F.lit(""))
        return F.when(F.rlike(here, F.lit(COMMENT_LINE)) != F.rlike(before, F.lit(COMMENT_LINE)), F.concat(F.lit("\n"), bare)).otherwise(bare)

    return F.array_join(F.zip_with(lines, F.concat(F.array(F.lit("")), lines), line), "\n")  # the last, without a line here, is null and goes


def marked(text: Column) -> Column:
    low = F.lower(text)
    out = F.contains(low, F.lit(MARKERS[0]))
    for word in MARKERS[1:]:
        out = out | F.contains(low, F.lit(word))
    return out


def paragraphs(text: Column) -> Column:
    """Digests of the paragraphs of a text, without those of which nothing is left."""
    return F.filter(F.transform(F.split(text, PARAGRAPHS), lambda u: F.sha2(canonical(u), 256)), lambda d: d != NOTHING)


def run_digest(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def entitled(known: tuple[tuple[str, str], ...]) -> list[tuple[str, str]]:
    """The known texts, and those of several paragraphs under each of their titles too."""
    return [*known, *((name, f"{title}\n\n{text}") for name, text in known if "\n\n" in text for of, title in TITLES if of == name)]


def registry(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN, long: tuple[tuple[str, int, str, str], ...] = LONG) -> DataFrame:
    """license_id, digest and n (paragraphs of a run, 0 for a text) of what is known; checked for size and for MARKERS."""
    if len(known) + len(long) > MAX_KNOWN:
        raise ValueError(f"{len(known) + len(long)} licence texts; the broadcast registry holds {MAX_KNOWN}")
    lost = [name for name, text in known if not any(w in text.lower() for w in MARKERS)]
    if lost:
        raise ValueError(f"licence texts without a marker word: {lost}")
    rows = spark.createDataFrame(entitled(known), "license_id string, text string")
    digests = paragraphs(F.col("text"))
    runs = rows.select("license_id", run_digest(digests).alias("digest"), F.size(digests).alias("n")).where("n > 1")
    rows = rows.select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest"), F.lit(0).alias("n")).unionByName(runs)
    if long:
        stored = [(name, d, k) for name, n, text, run in long for d, k in ((text, 0), (run, n))]
        rows = rows.unionByName(spark.createDataFrame(stored, "license_id string, digest string, n int"))
    return rows.distinct()


def license_scan(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN, key: str = "doc_id", text: str = "text", long: tuple[tuple[str, int, str, str], ...] = LONG) -> DataFrame:
    """Per row: key, whole_license (of the entire text, else null), n_units (matching paragraphs, lines and runs), licenses (sorted, comma-joined).

    One shuffle, of row numbers and digests that matched or not, combined in each task before it: a row's units are
    in one task. Texts are not shuffled.
    """
    spark = docs.sparkSession
    names = registry(spark, known, long)
    lengths = sorted(r["n"] for r in names.select("n").where("n > 1").distinct().collect())  # a few lengths of the registry
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("text", F.when(marked(F.col("text")), F.col("text")))
    rows = rows.withColumn("bare", comment_blocks(F.col("text")))
    units = F.filter(F.array_union(F.array_union(F.split("text", PARAGRAPHS), F.split("bare", PARAGRAPHS)), F.split("text", "\n")), lambda u: marked(u))
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"),
        "key",
        F.sha2(canonical(F.col("text")), 256).alias("whole"),
        F.sha2(canonical(F.col("bare")), 256).alias("whole_bare"),
        F.array_distinct(F.transform(units, lambda u: F.sha2(canonical(u), 256))).alias("parts"),
        paragraphs(F.col("text")).alias("of"),
        paragraphs(F.col("bare")).alias("of_bare"),
    )

    def runs(n: int, of: str, most: Column) -> Column:
        """Runs of n paragraphs in a text that has them besides others."""
        starts = F.sequence(F.lit(1), F.size(of) - (n - 1))
        return F.when(most >= n, F.transform(starts, lambda i: run_digest(F.slice(of, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))

    most = F.size("of") - 1
    most_bare = F.when(F.col("whole_bare") != F.col("whole"), F.size("of_bare")).otherwise(F.size("of_bare") - 1)
    rows = rows.withColumn("parts", F.array_distinct(F.concat("parts", *[runs(n, "of", most) for n in lengths], *[runs(n, "of_bare", most_bare) for n in lengths])))
    found = F.concat(
        F.array(F.struct(F.lit(True).alias("entire"), F.col("whole").alias("digest"))),
        F.transform(F.array_except("parts", F.array("whole")), lambda d: F.struct(F.lit(False).alias("entire"), d.alias("digest"))),
    )
    rows = rows.select("row", "key", F.explode_outer(F.when(F.col("whole").isNotNull(), found)).alias("unit")).select("row", "key", "unit.*")
    hits = rows.join(F.broadcast(names.drop("n")), "digest", "left")
    return (
        hits.groupBy("row", "key")
        .agg(
            F.max(F.when(F.col("entire"), F.col("license_id"))).alias("whole_license"),
            F.count(F.when(~F.col("entire"), F.col("license_id"))).alias("n_units"),
            F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("licenses"),
        )
        .select(F.col("key").alias(key), "whole_license", "n_units", "licenses")
    )
