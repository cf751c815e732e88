"""Contract texts to clause chunks and to sections, and the match between vendors and contract files.

Splitting happens inside the row: the text is cut by regular expressions into arrays and exploded once.
No shuffle is needed, and the numbering of the parts is the array position.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procurisk.config import CLAUSE_KEYWORDS, SECTION_CLAUSE_TYPE, SECTION_HEADINGS
from procurisk.functions.text import (
    contract_file_name,
    contract_vendor_name,
    detected_clause_type,
    file_stem,
    lines_of,
    section_clause_type,
    slug,
    strip_ws,
)
from procurisk.operators.containment import first_containing
from procurisk.operators.ranks import running_totals
from procurisk.operators.skew import join_salted, left_join_spread

# White space of WS_CHARS by kind, as ranges (one test for each of many characters is slow): blanks other than the plain one, and line
# ends other than \n.
ODD_BLANKS = r"\t\x1f\xa0\u1680\u2000-\u200a\u202f\u205f\u3000"
OTHER_ENDS = r"\x0b-\r\x1c-\x1e\x85\u2028\u2029"
# a run of blanks other than one plain one; then, where blanks are single, a run with a line end, its second \n as the group. Each
# is met at its start and read once or twice. Visible ASCII goes by at once.
_BLANK_RUN = rf"(?![!-~])(?:[{ODD_BLANKS}][ {ODD_BLANKS}]*+| [ {ODD_BLANKS}]++)"
_END_RUN = (
    rf"(?![!-~])(?:[ {OTHER_ENDS}]*+\n[ {OTHER_ENDS}]*+(?:(\n)[ \n{OTHER_ENDS}]*+)?| ?[{OTHER_ENDS}][ {OTHER_ENDS}]*+)"
)

# Inside a tidied text blanks are single, lines end in one \n and blocks in two.
# A heading is a line of up to five words: the first of several lines of its block, or a whole block that
# does not end in a period.
_FEW_WORDS = r"[^ \n]+(?: [^ \n]+){0,4}"
_HEADING_START = rf"(?={_FEW_WORDS}\n(?!\n)|{_FEW_WORDS}(?<!\.)(?:\n\n|\z))"


def _tidied(text: Column) -> Column:
    """The text with white space collapsed: paragraphs lie two ``\\n`` apart, their lines one, words a blank; none at the ends.

    White space with two ``\\n`` or more parts paragraphs, other white space with a line end parts lines. The text is changed as a
    whole: a list of its lines, each with regular expressions of its own, costs several times as much.
    """
    return F.regexp_replace(F.regexp_replace(strip_ws(text), _BLANK_RUN, " "), _END_RUN, "\n$1")


def _after_first_line(text: Column) -> Column:
    """The text after its first line; empty for a single line."""
    at = F.instr(text, "\n")
    return F.when(at > 0, F.substr(text, at + 1)).otherwise("")


def _chunk_texts(text: Column) -> Column:
    """Chunk texts of one contract in order.

    The body is first cut before every block that opens with a heading, so that each piece carries its
    own heading over all of its blocks; then each piece is cut into blocks.
    """
    body = F.regexp_replace(_tidied(text), r"(?s)\A.*?(?:\n\n|\z)", "")
    pieces = F.filter(F.split(body, rf"(?<=\n\n){_HEADING_START}"), lambda piece: piece != "")
    # the heading of a piece is worked out once, not again for each of its blocks
    opened = F.transform(
        pieces,
        lambda piece: F.struct(
            F.split(F.rtrim(piece, F.lit("\n")), "\n\n").alias("blocks"),
            F.when(piece.rlike(rf"\A{_HEADING_START}"), F.substring_index(piece, "\n", 1)).alias("heading"),
        ),
    )

    def chunks_of(piece: Column) -> Column:
        def chunk(block: Column, i: Column) -> Column:
            opening = (i == 0) & piece["heading"].isNotNull()
            content = F.when(opening, _after_first_line(block)).otherwise(block)
            heading = F.coalesce(piece["heading"], F.lit("General"))
            separator = F.when(content == "", "").otherwise(": ")
            return F.concat(heading, separator, F.replace(content, F.lit("\n"), F.lit(" ")))

        return F.transform(piece["blocks"], chunk)

    return F.flatten(F.transform(opened, chunks_of))


def clause_chunks(
    contracts: DataFrame, keywords: Mapping[str, Sequence[str]] = CLAUSE_KEYWORDS
) -> DataFrame:
    """One row per clause: (contract_file, chunk_no, text, vendor_name, clause_type, source)."""
    # Name and array first, explode after: the whole text must not travel with every clause. The outer
    # form, because before a plain explode Spark puts a filter that works the array out once more.
    exploded = contracts.select(
        "contract_file",
        contract_vendor_name(F.col("text"), F.col("contract_file")).alias("vendor_name"),
        _chunk_texts(F.col("text")).alias("chunks"),
    ).select("contract_file", "vendor_name", F.posexplode_outer("chunks").alias("chunk_no", "text"))
    return exploded.where(F.col("chunk_no").isNotNull()).select(
        "contract_file",
        "chunk_no",
        "text",
        "vendor_name",
        detected_clause_type(F.col("text"), keywords).alias("clause_type"),
        F.col("contract_file").alias("source"),
    )


def number_chunks(chunks: DataFrame, ranges: int | None = None) -> DataFrame:
    """Add ``chunk_id``: 0, 1, 2, ... over all contracts in file-name order.

    Files are counted, and their offsets are running totals in name order. They meet the chunks by file name; a file with
    a large share of the chunks is salted. ``chunks`` is read twice: chunks that are not stored are split twice.
    """
    counts = chunks.groupBy("contract_file").agg(F.count("*").alias("n"))
    offsets = running_totals(counts, ["contract_file"], {"offset": F.col("n")}, ranges)
    joined = join_salted(chunks, offsets.select("contract_file", "offset"), ["contract_file"], sizes=offsets.select("contract_file", "n"))
    return joined.select((F.col("offset") + F.col("chunk_no")).alias("chunk_id"), *chunks.columns)


def section_array(
    text: Column,
    headings: Sequence[str] = SECTION_HEADINGS,
    types: Mapping[str, str] = SECTION_CLAUSE_TYPE,
) -> Column:
    """Sections of one contract as an array of (heading, text, clause_type).

    Lines are stripped and blank ones dropped; the text is then cut before every line that is exactly a
    known heading. Lines before the first heading form a ``general`` section; sections without lines go.
    """
    stripped = F.filter(F.transform(lines_of(text), strip_ws), lambda line: line != "")
    body = F.array_join(stripped, "\n")
    known = "|".join(_quoted(h) for h in headings)
    pieces = F.filter(F.split(body, rf"(?m)(?:\n|\A)(?=(?:{known})$)"), lambda p: p != "")

    def section(piece: Column) -> Column:
        first = F.substring_index(piece, "\n", 1)
        has_heading = first.isin(*headings)
        heading = F.when(has_heading, first).otherwise("general")
        return F.struct(
            heading.alias("heading"),
            F.when(has_heading, _after_first_line(piece)).otherwise(piece).alias("text"),
            section_clause_type(heading, types).alias("clause_type"),
        )

    return F.filter(F.transform(pieces, section), lambda s: s["text"] != "")


def _quoted(literal: str) -> str:
    return r"\Q" + literal + r"\E"


def clause_sections(
    contracts: DataFrame,
    headings: Sequence[str] = SECTION_HEADINGS,
    types: Mapping[str, str] = SECTION_CLAUSE_TYPE,
) -> DataFrame:
    """One row per section: (contract_file, vendor_name, section_no, heading, text, clause_type)."""
    sections = contracts.select(
        "contract_file",
        contract_vendor_name(F.col("text"), F.col("contract_file")).alias("vendor_name"),
        section_array(F.col("text"), headings, types).alias("sections"),
    )
    return sections.select(
        "contract_file", "vendor_name", F.posexplode_outer("sections").alias("section_no", "section")
    ).where(F.col("section_no").isNotNull()).select("contract_file", "vendor_name", "section_no", "section.*")


def match_contract_names(names: DataFrame, files: DataFrame) -> DataFrame:
    """The contract file of each distinct vendor name that has one: (vendor_name, contract_file).

    A file named after the vendor's slug wins. Otherwise it is the first file, by name, of those ending
    in ``_contract.txt`` whose stem contains the slug or the vendor's lower-case name with underscores.
    """
    wanted = (
        names.select("vendor_name")
        .distinct()
        .select("vendor_name", contract_file_name(F.col("vendor_name")).alias("_wanted"))
    )
    file_names = files.select("contract_file").distinct()
    direct = wanted.join(file_names, F.col("_wanted") == F.col("contract_file"), "left")
    found = direct.where(F.col("contract_file").isNotNull()).select("vendor_name", "contract_file")
    keys = direct.where(F.col("contract_file").isNull()).select(
        "vendor_name",
        F.explode(
            F.array_distinct(
                F.array(slug(F.col("vendor_name")), F.regexp_replace(F.lower("vendor_name"), " ", "_"))
            )
        ).alias("key"),
    )
    stems = file_names.where(F.col("contract_file").endswith("_contract.txt")).select(
        F.lower(file_stem(F.col("contract_file"))).alias("stem"), "contract_file"
    )
    contained = first_containing(keys.select("key"), stems, "contract_file")
    by_stem = keys.join(contained, "key").groupBy("vendor_name").agg(F.min("contract_file").alias("contract_file"))
    return found.unionByName(by_stem)


def match_contract_files(vendors: DataFrame, files: DataFrame) -> DataFrame:
    """The contract file of each vendor row of (vendor_id, vendor_name), null when there is none."""
    matches = match_contract_names(vendors, files)
    return left_join_spread(vendors, matches, "vendor_name", ["vendor_id"]).select("vendor_id", "vendor_name", "contract_file")
