"""Licence scan: canonical digests of entire texts and entire lines, hash-joined to known licence digests."""

from __future__ import annotations

import json
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knowloom.functions.skew import is_small, small_side

# Equivalent spellings (from, to) and known notices by SPDX id.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("honour", "honor"), ("organisation", "organization"),
    ("whilst", "while"), ("wilful", "willful"), ("noncommercial", "non commercial"), ("per cent", "percent"),
    ("copyright holder", "copyright owner"), ("https", "http"),
)
_LINES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("MIT", (
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to "
        "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY "
        "OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.")),
    ("ISC", (
        "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "
        "\"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")),
    ("Zlib", (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including "
        "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of "
        "this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a "
        "product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must "
        "be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or "
        "altered from any source distribution.")),
)

# Whole texts, file headers and title variants: one {license_id, notice} a line.
_SHIPPED = files(__package__).joinpath("licenses.jsonl").read_text(encoding="utf-8").splitlines()
NOTICES = (*_LINES, *((r["license_id"], r["notice"]) for r in map(json.loads, _SHIPPED)))

COPYRIGHT_LINE = r"(?m)^[ \t*/#;-]*(copyright|\(c\)|©)[^\n]*$|^[ \t*/#;-]*all rights reserved\.?[ \t]*$"


def canonical_text(text: Column) -> Column:
    """Lower case; copyright lines removed; everything but letters and digits becomes one space; spellings unified."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical_text(text), 256)


def known_licenses(spark: SparkSession, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """license_id, license_digest; equal digests keep the smallest id."""
    table = spark.createDataFrame([*notices], "license_id string, notice string")
    return table.select("license_id", digest(F.col("notice")).alias("license_digest")).groupBy("license_digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, licenses: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_digest, text_license, line_licenses, n_license_lines.

    ``text_license`` is the licence that the entire text is; ``line_licenses`` lists (sorted, comma-separated) the
    licences of which an entire line is a notice, null without any. Only entire units are looked up, never fragments.
    Null and empty texts have the digest of the empty string and match nothing. The unit digests join the licence table
    by hash; that table is broadcast if it is counted as small, else dealt out by digest. Lines whose canonical form is
    longer than any notice or equal to no digest leave the plan at that inner join; matches are counted per document
    row with a map-side combine, so a notice on a third of all lines is no hot key. Repeated (doc_id, text) rows count
    alike and each returns a row; other columns are not read.
    """
    table = licenses.filter(F.col("license_digest") != F.sha2(F.lit(""), 256))
    table = small_side(table, is_small(table))
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text), 256)
    base = docs.select("doc_id", "text", key.alias("_key"))
    lines = base.select("_key", F.explode(F.split(text, r"\r?\n")).alias("_line")).select("_key", digest(F.col("_line")).alias("license_digest"))
    found = lines.join(table, "license_digest").groupBy("_key").agg(
        F.array_join(F.sort_array(F.collect_set("license_id")), ",").alias("line_licenses"), F.count(F.lit(1)).alias("_n"))
    # Rows that repeat doc_id and text share a key; each has its part of the count.
    repeats = base.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    found = found.join(repeats, "_key", "left").select("_key", "line_licenses", (F.col("_n") / F.coalesce("_rows", F.lit(1))).cast("long").alias("_n"))
    whole = table.select(F.col("license_digest").alias("text_digest"), F.col("license_id").alias("text_license"))
    rows = base.select("doc_id", "_key", digest(F.col("text")).alias("text_digest")).join(whole, "text_digest", "left").join(found, "_key", "left")
    return rows.select("doc_id", "text_digest", "text_license", "line_licenses", F.coalesce("_n", F.lit(0).cast("long")).alias("n_license_lines"))
