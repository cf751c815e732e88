"""Contracts of any size: chunks and sections from lines that come from many splits of a file.

The row form in ``contracts`` needs a whole contract in one row. Here a contract is a table of lines with their place in the file. What
a line has to know of those before it (blocks, headings, numbers) is a running total over all lines in the order of the files, so
a file may lie in any number of tasks. Only a block of lines without a blank one, or a section, is brought together. Joins
by file or by heading are salted, since one file or heading may hold a large share of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procurisk.config import CLAUSE_KEYWORDS, SECTION_CLAUSE_TYPE, SECTION_HEADINGS
from procurisk.functions.text import collapse_ws, contract_vendor_name, detected_clause_type, lines_of, section_clause_type, strip_ws
from procurisk.operators.ranks import running_totals
from procurisk.operators.skew import join_salted

#: Lines have contract_file, split_start (where the split of the file begins), at (rising within the split) and line.
PLACE = ("split_start", "at")
FILE = "contract_file"


def _per_file(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows with the facts (one row a file, with the number of its rows as ``n``)."""
    return join_salted(rows, facts.drop("n"), [FILE], sizes=facts.select(FILE, "n"))


def _names(lines: DataFrame) -> DataFrame:
    """contract_file, vendor_name and ``first`` (place of the title) of every file that has a line that is not blank."""
    first = lines.where(strip_ws(F.col("line")) != "").groupBy(FILE).agg(
        F.min(F.struct(*PLACE, "line")).alias("title"), F.count("*").alias("n")
    )
    return first.select(FILE, contract_vendor_name(F.col("title.line"), F.col(FILE)).alias("vendor_name"), "n")


def clause_chunks(lines: DataFrame, keywords: Mapping[str, Sequence[str]] = CLAUSE_KEYWORDS) -> DataFrame:
    """The clauses that the row form gives, with ``chunk_id`` numbered over all files in name order."""
    blank = (strip_ws(F.col("line")) == "").cast("bigint")
    placed = running_totals(lines.select(FILE, *PLACE, "line"), [FILE, *PLACE], {"block": blank})
    # lines between which no blank one stands have seen the same number of blank ones
    tidy = F.filter(F.transform(lines_of(F.col("line")), collapse_ws), lambda line: line != "")
    blocks = (
        placed.where(strip_ws(F.col("line")) != "")
        .groupBy(FILE, "block")
        .agg(F.sort_array(F.collect_list(F.struct(*PLACE, tidy.alias("parts")))).alias("rows"))
        .select(FILE, "block", F.flatten(F.transform("rows", lambda row: row["parts"])).alias("parts"))
    )
    titles = blocks.groupBy(FILE).agg(F.min("block").alias("title"), F.count("*").alias("n"))
    body = _per_file(blocks, titles).where(F.col("block") > F.col("title"))
    first = F.get("parts", F.lit(0))
    is_heading = (F.size(F.split(first, " ")) <= 5) & ((F.size("parts") > 1) | ~first.endswith("."))
    opened = body.select(FILE, "block", "parts", is_heading.cast("bigint").alias("opens"))
    numbered = running_totals(opened, [FILE, "block"], {"before": F.col("opens"), "chunk_id": F.lit(1).cast("bigint")})
    pieces = numbered.withColumn("piece", F.col("before") + F.col("opens"))
    headings = pieces.where("opens = 1").select(FILE, "piece", first.alias("heading"))
    named = join_salted(pieces, headings, [FILE, "piece"], "left")
    content = F.array_join(F.when(F.col("opens") == 1, F.slice("parts", 2, 2_000_000_000)).otherwise(F.col("parts")), " ")
    text = F.concat(F.coalesce("heading", F.lit("General")), F.when(content == "", "").otherwise(": "), content)
    facts = numbered.groupBy(FILE).agg(F.min("chunk_id").alias("first_id"), F.count("*").alias("n"))
    chunks = _per_file(named.select(FILE, "chunk_id", text.alias("text")), facts.join(_names(lines).drop("n"), FILE))
    return chunks.select(
        "chunk_id",
        FILE,
        (F.col("chunk_id") - F.col("first_id")).cast("int").alias("chunk_no"),
        "text",
        "vendor_name",
        detected_clause_type(F.col("text"), keywords).alias("clause_type"),
        F.col(FILE).alias("source"),
    )


def clause_sections(
    lines: DataFrame, headings: Sequence[str] = SECTION_HEADINGS, types: Mapping[str, str] = SECTION_CLAUSE_TYPE
) -> DataFrame:
    """The sections that the row form gives. A section is brought together in one row."""
    parts = lines.select(FILE, *PLACE, F.posexplode(F.transform(lines_of(F.col("line")), strip_ws)).alias("part", "line")).where("line <> ''")
    opens = F.col("line").isin(*headings).cast("bigint")
    placed = running_totals(parts, [FILE, *PLACE, "part"], {"before": opens}).withColumn("section", F.col("before") + opens)
    heading = F.max(F.when(opens == 1, F.col("line")))
    entry = F.when(opens == 0, F.struct(*PLACE, "part", "line"))
    grouped = placed.groupBy(FILE, "section").agg(heading.alias("heading"), F.sort_array(F.collect_list(entry)).alias("rows"))
    filled = grouped.where(F.size("rows") > 0).select(
        FILE, "section", F.coalesce("heading", F.lit("general")).alias("heading"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text")
    )
    numbered = running_totals(filled, [FILE, "section"], {"number": F.lit(1).cast("bigint")})
    facts = numbered.groupBy(FILE).agg(F.min("number").alias("first_id"), F.count("*").alias("n"))
    return _per_file(numbered, facts.join(_names(lines).drop("n"), FILE)).select(
        FILE,
        "vendor_name",
        (F.col("number") - F.col("first_id")).cast("int").alias("section_no"),
        "heading",
        "text",
        section_clause_type(F.col("heading"), types).alias("clause_type"),
    )
