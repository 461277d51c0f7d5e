"""License scan by digest of the canonical text.

A text and each of its lines are brought to a canonical form: lower case, no copyright lines,
punctuation and white space as one blank, one spelling for words with several.  The SHA-256 of the
form is looked up among the digests of known licences and notices with a hash join.  Only the
digest meets the table of known texts, so no text is shuffled.  A table of known texts of checked size is
broadcast, and then nothing of the corpus moves; a larger one meets the digests in a shuffle, so any
number of licences may be known.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

# Spellings that licence matching treats as equal, the second stands for both.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling",
    "labour": "labor", "licence": "license", "licences": "licenses", "maximise": "maximize", "modelled": "modeled",
    "modelling": "modeling", "noncommercial": "non commercial", "offence": "offense", "optimise": "optimize",
    "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program",
    "realise": "realize", "recognise": "recognize", "signalling": "signaling", "sublicence": "sublicense",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}
#: A line of nothing but a copyright mark with names or years, or a reservation of rights.
COPYRIGHT = r"^[^\p{L}\p{N}©]*(?:copyright[\s:]*(?:\(c\)|©|[0-9]{4}|<|\[)|\(c\)|©|all rights reserved[^\p{L}\p{N}]*$).*"

AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
    "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
    "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
    "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the "
    "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution.\n"
)
BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
# Texts of known licences (id, text) and of the notices that point to one.
KNOWN = (
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:\nThe above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + AS_IS,
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted.\n" + AS_IS,
    ),
    ("BSD-2-Clause", BSD_HEAD + BSD_TAIL),
    (
        "BSD-3-Clause",
        BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
        "or promote products derived from this software without specific prior written permission.\n" + BSD_TAIL,
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
)

BROADCAST_ROWS = 20_000  # known digests that may be broadcast
BROADCAST_BYTES = 4 << 20  # and the bytes they may have


def canonical_line(line: Column) -> Column:
    """Canonical form of one line; empty for a copyright line."""
    low = F.lower(line)
    words = F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "))
    spelled = words
    for one, other in SPELLINGS.items():
        spelled = F.regexp_replace(spelled, rf"\b{one}\b", other)
    several = r"\b(?:" + "|".join(SPELLINGS) + r")\b"
    words = F.when(words.rlike(several), spelled).otherwise(words)
    return F.when(low.rlike(r"copyright|\(c\)|©|all rights reserved") & low.rlike(COPYRIGHT), F.lit("")).otherwise(words)


def known_digests(spark: SparkSession, texts: Mapping[str, str] | tuple = KNOWN) -> DataFrame:
    """(digest, license_id) of known texts; of equal texts the first id counts."""
    pairs = list(texts.items()) if isinstance(texts, Mapping) else list(texts)
    rows = spark.createDataFrame([(i, n, t) for n, (i, t) in enumerate(pairs)], "license_id string, n int, text string")
    made = rows.select("license_id", "n", F.sha2(_whole(_lines(F.col("text"))), 256).alias("digest"))
    return made.groupBy("digest").agg(F.min_by("license_id", "n").alias("license_id"))


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, r"\r\n|\n|\r"), canonical_line)


def _whole(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def _fits_broadcast(known: DataFrame) -> bool:
    """Whether the known digests, counted up to one row over the limit, may be broadcast."""
    size = F.octet_length(F.concat_ws("", "digest", "license_id"))
    n, total = known.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.sum(size)).collect()[0]
    return n <= BROADCAST_ROWS and (total or 0) <= BROADCAST_BYTES


def scan_licenses(
    docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, line, digest, license_id): a row with line 0 per row of ``docs`` for the whole text, whether
    known or not (license_id NULL), and a row for each line, numbered from 1, that alone is a known text.

    ``known`` has the columns digest and license_id; a small job measures it before the join is planned.  Missing texts count as empty; an empty
    canonical text is no licence.  Repeated rows and rows without an id come out as they went in; other
    columns are ignored.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    base = docs.select(F.col(id_col), _lines(text_of(text_col)).alias("lines"))
    units = F.concat(
        F.array(F.struct(F.lit(0).alias("line"), _whole(F.col("lines")).alias("text"))),
        F.filter(
            F.transform("lines", lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"))), lambda u: u["text"] != ""
        ),
    )
    rows = base.select(id_col, F.inline(units)).select(id_col, "line", F.sha2("text", 256).alias("digest"), (F.col("text") == "").alias("empty"))
    named = known.select(F.col("digest").alias("__ff_digest"), "license_id")
    if _fits_broadcast(known):
        named = F.broadcast(named)
    joined = rows.join(named, (rows["digest"] == named["__ff_digest"]) & ~rows["empty"], "left")
    return joined.where("line = 0 OR license_id IS NOT NULL").select(id_col, "line", "digest", "license_id")
