"""Licence scan: canonical digests of whole texts, looked up among the digests of known licences.

Normal form, in this order: A-Z to a-z; lines that open with a copyright mark go; every run of
characters that are neither a-z, 0-9 nor beyond ASCII becomes one blank; equivalent spellings
become one; the statement "all rights reserved" goes. The SHA-256 of that is the digest.

The whole text is matched by a hash join with the table of known digests. The same lookup serves
each line of a text, as a licence notice is often one line of a longer document. The known table
is fixed, so it may be sent to every task; there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT_LINE = r"\n[ \t*#/;>-]*(copyright|\(c\)|©)[^\n]*"
OTHER = r"[^a-z0-9\x{80}-\x{10FFFF}]+"

# Spellings that count as equal in licence texts.
SPELLINGS = [
    ("licence", "license"), ("acknowledgement", "acknowledgment"), ("authoris", "authoriz"),
    ("organis", "organiz"), ("recognis", "recogniz"), ("utilis", "utiliz"),
    ("favour", "favor"), ("honour", "honor"), ("behaviour", "behavior"),
    ("fulfilment", "fulfillment"), ("judgement", "judgment"), ("whilst", "while"),
    ("sub license", "sublicense"), ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"), ("per cent", "percent"),
    ("copyright owner", "copyright holder"), ("copyright holders", "copyright holder"),
]

_PERMISSION = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
    "and associated documentation files (the \"Software\"), to deal in the Software without "
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions:\n\nThe above copyright "
    "notice and this permission notice shall be included in all copies or substantial portions of "
    "the Software.\n\n")
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
    "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
    "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
    "SOFTWARE.")
_ISC_TAIL = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
    "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
    "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE.")

# Texts of licences, and one-line notices that name one.
KNOWN: list[tuple[str, str]] = [
    ("MIT", "MIT License\n\nCopyright (c) the authors\n\n" + _PERMISSION + _AS_IS),
    ("MIT", _PERMISSION + _AS_IS),
    ("ISC", "ISC License\n\nCopyright (c) the authors\n\nPermission to use, copy, modify, and/or "
            "distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all "
            "copies.\n\n" + _ISC_TAIL),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose "
             "with or without fee is hereby granted.\n\n" + _ISC_TAIL),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"
                   " (the \"License\"); you may not use this file except in compliance with the "
                   "License. You may obtain a copy of the License at\n\n"
                   "http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law "
                   "or agreed to in writing, software distributed under the License is distributed "
                   "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
                   "express or implied. See the License for the specific language governing "
                   "permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
]


def normal_form(text: Column) -> Column:
    out = F.translate(F.concat(F.lit("\n"), text), UPPER, LOWER)
    out = F.regexp_replace(out, COPYRIGHT_LINE, "\n")
    out = F.regexp_replace(out, OTHER, " ")
    for spelled, canonical in SPELLINGS:
        out = F.replace(out, F.lit(spelled), F.lit(canonical))
    return F.trim(F.replace(out, F.lit("all rights reserved"), F.lit("")))


def digest(text: Column) -> Column:
    return F.sha2(normal_form(text), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(digest, license_id), each digest once; the smallest id if two texts are equal."""
    return spark.createDataFrame(known, "license_id string, text string").groupBy(
        digest(F.col("text")).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(documents: DataFrame, known: DataFrame, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """(doc_id, text_digest, license_id, notices), one row per row.

    ``license_id`` names the licence that the whole text is, null if it is none; ``notices`` joins
    the distinct ids of licences that a line of it is, in order, "" if there are none. A null text
    is empty and equals nothing. Repeated rows repeat, null keys stay, other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    # A fixed, short table: one map literal for the lines of a text, one broadcast for whole texts.
    pairs = {r["digest"]: r["license_id"] for r in known.collect()}
    ids = F.create_map(*[F.lit(x) for pair in sorted(pairs.items()) for x in pair])
    lines = F.transform(F.filter(F.split(body, "\n"), lambda x: F.trim(x) != ""),
                        lambda x: F.try_element_at(ids, digest(x)))
    slim = documents.select(
        F.col(key).cast("long").alias("doc_id"), digest(body).alias("text_digest"),
        F.array_join(F.array_sort(F.array_distinct(F.array_compact(lines))), ",")
        .alias("notices"))
    return slim.join(F.broadcast(known.withColumnRenamed("digest", "text_digest")),
                     "text_digest", "left").select("doc_id", "text_digest", "license_id",
                                                   "notices")


# ------------------------------------------------------------------ SQL
def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def normal_sql(text: str) -> str:
    out = f"translate(chr(10) || {text}, '{UPPER}', '{LOWER}')"
    out = f"regexp_replace({out}, '{COPYRIGHT_LINE}', chr(10), 'g')"
    out = f"regexp_replace({out}, '{OTHER}', ' ', 'g')"
    for spelled, canonical in SPELLINGS:
        out = f"replace({out}, '{spelled}', '{canonical}')"
    return f"trim(replace({out}, 'all rights reserved', ''))"


SCAN_SQL = f"""
with given (license_id, text) as (values {', '.join(
    f"({_quoted(i)}, {_quoted(t)})" for i, t in KNOWN)}),
known as (select sha256({normal_sql('text')}) as digest, min(license_id) as license_id
          from given group by 1),
whole as (select doc_id, coalesce(text, '') as text,
                 sha256({normal_sql("coalesce(text, '')")}) as text_digest, row_number() over () as r
          from documents),
lines as (select r, unnest(string_split(text, chr(10))) as line from whole),
noted as (select r, string_agg(distinct license_id, ',' order by license_id) as notices
          from lines join known on sha256({normal_sql('line')}) = digest
          where trim(line) <> '' group by r)
select doc_id, text_digest, license_id, coalesce(notices, '') as notices
from whole left join known on text_digest = digest left join noted using (r)
"""
