"""Licence scan by canonical digests, with DataFrame functions only.

A text is brought to a canonical form (case, punctuation, copyright lines and equivalent spellings levelled) and its digest is
looked up among those of known licences. The units that are looked up as entire texts are the document and each of its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Known licence notices and texts, by identifier.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("all-rights-reserved", "All rights reserved."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        'IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
)
# Equivalent spellings, applied to lower-case words in this order.
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("favour", "favor"),
    ("merchantibility", "merchantability"),
    ("noncommercial", "non commercial"),
    ("whilst", "while"),
)
#: Lines that name a copyright holder and say nothing else.
COPYRIGHT_LINE = r"(?m)^[ \t]*(?:copyright\b|\(c\)|©)[^\n]*$"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, only a-z, 0-9 and single blanks, spellings levelled."""
    plain = F.lower(text)
    marked = F.contains(plain, F.lit("copyright")) | F.contains(plain, F.lit("(c)")) | F.contains(plain, F.lit("©"))
    plain = F.when(marked, F.regexp_replace(plain, COPYRIGHT_LINE, "")).otherwise(plain)
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " ")), F.lit(" "))
    for other, usual in SPELLINGS:
        plain = F.replace(plain, F.lit(f" {other} "), F.lit(f" {usual} "))
    return F.trim(plain)


def digest(text: Column) -> Column:
    return F.md5(canonical(text).cast("binary"))


def known_licenses(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    """license and digest, one row per digest; ``extra`` adds rows (license, text) to the fixed ones."""
    fixed = F.array(*(F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in KNOWN))
    rows = spark.range(1).select(F.inline(fixed))
    if extra is not None:
        rows = rows.unionByName(extra.select("license", "text").where("license IS NOT NULL AND text IS NOT NULL"))
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """doc_id, text_digest, whole_license (of the entire text, else null), licenses (all, of the text and its lines, by comma).

    Null and empty texts have the digest of the empty form and no licence. Rows that repeat an id, null included, share the licences of
    their lines. Every line is digested, however long it is.
    The fixed list has a few rows and is broadcast; with ``extra`` the optimizer chooses the join from the sizes. Known digests
    are unique, so that no join multiplies rows, and only hits are shuffled besides ids and digests.
    """
    spark = docs.sparkSession
    known = known_licenses(spark, extra)
    sized = F.broadcast(known) if extra is None else known
    rows = docs.select(docs["doc_id"], F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    whole = rows.select("doc_id", digest(F.col("text")).alias("text_digest"))
    whole = whole.join(sized, F.col("text_digest") == F.col("digest"), "left").select(
        "doc_id", "text_digest", F.col("license").alias("whole_license")
    )
    lines = rows.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    hits = (
        lines.select("doc_id", digest(F.col("line")).alias("digest"))
        .join(sized, "digest")
        .groupBy(F.col("doc_id").alias("hit_id"))
        .agg(F.collect_set("license").alias("found"))
    )
    every = F.array_union(F.coalesce("found", F.array().cast("array<string>")), F.array("whole_license"))
    return whole.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left").select(
        "doc_id",
        "text_digest",
        "whole_license",
        F.concat_ws(",", F.sort_array(F.filter(every, F.isnotnull))).alias("licenses"),
    )
