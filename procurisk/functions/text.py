"""Text and number-formatting expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: every character that counts as white space in source text, line ends included --
# (``trim`` and the default class of the JVM know fewer)
WS_CHARS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029])
) + "".join(map(chr, [0x202F, 0x205F, 0x3000]))
LINE_END_CHARS = "".join(map(chr, [*range(0x0A, 0x0E), 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029]))

WS = f"[{WS_CHARS}]"
# a run of white space other than one single blank
_LONG_WS = f"[{WS_CHARS.replace(' ', '')}]{WS}*| {WS}+"
LINE_ENDS = f"[{LINE_END_CHARS}]+"


def strip_ws(c: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.btrim(c, F.lit(WS_CHARS))


def rstrip_ws(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS_CHARS))


def collapse_ws(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, _LONG_WS, " "))


def lines_of(c: Column) -> Column:
    """The lines of a text, unstripped; runs of line ends count as one."""
    return F.split(c, LINE_ENDS)


def is_blank(c: Column) -> Column:
    """Null or nothing but white space; never null itself."""
    return F.coalesce(strip_ws(c.cast("string")) == "", F.lit(True))


def slug(c: Column) -> Column:
    """Lower case, runs of other characters as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def contract_file_name(vendor_name: Column) -> Column:
    return F.concat(slug(vendor_name), F.lit("_contract.txt"))


def file_stem(file_name: Column) -> Column:
    return F.regexp_replace(file_name, r"(?<=.)\.[^.]*$", "")


def contract_vendor_name(text: Column, file_name: Column) -> Column:
    """First line of the contract without its agreement suffix; the file stem for a blank text."""
    started = F.ltrim(text, F.lit(WS_CHARS))
    stem = file_stem(file_name)
    # cut at the first plain line end, then look for other ones in that line only
    first_line = F.split(F.substring_index(started, "\n", 1), LINE_ENDS, 2)[0]
    first = strip_ws(F.when(started == "", stem).otherwise(first_line))
    suffix = f"(?i){WS}+(Master Services Agreement|Services Agreement|Agreement)$"
    name = strip_ws(F.regexp_replace(first, suffix, ""))
    return F.when(name == "", F.initcap(F.regexp_replace(stem, "_", " "))).otherwise(name)


def section_clause_type(heading: Column, types: Mapping[str, str]) -> Column:
    """Exact heading lookup, ``general`` when unknown."""
    if not types:
        return F.lit("general")
    table = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(heading)), F.lit("general"))


def detected_clause_type(text: Column, keywords: Mapping[str, Sequence[str]]) -> Column:
    """Clause type by the words of the heading, then by the first keyword list with a hit."""
    lowered = F.lower(text)
    heading = F.substring_index(lowered, ":", 1)
    result = (
        F.when(heading.contains("payment"), "payment")
        .when(heading.contains("sla") | heading.contains("service level"), "sla")
        .when(heading.contains("compliance"), "compliance")
        .when(heading.contains("renewal"), "renewal")
        .when(heading.contains("termination"), "termination")
        .when(heading.contains("data security") | heading.contains("escalation"), "general")
    )
    for clause_type, words in keywords.items():
        hit = F.lit(False)
        for word in words:
            hit = hit | lowered.contains(word)
        result = result.when(hit, clause_type)
    return result.otherwise("general")


def query_terms(factors: Column, extra: Sequence[str]) -> Column:
    """Distinct words longer than two characters from a factor list, plus fixed ones."""
    words = F.regexp_extract_all(F.lower(F.array_join(factors, " ")), F.lit("[a-z0-9]+"), F.lit(0))
    long_words = F.filter(words, lambda w: F.length(w) > 2)
    return F.array_union(long_words, F.array(*[F.lit(t) for t in extra]))


def preview(c: Column, limit: int) -> Column:
    """Texts over ``limit`` characters are cut three short, right-stripped, and get an ellipsis."""
    cut = F.concat(rstrip_ws(F.substring(c, 1, limit - 3)), F.lit("..."))
    return F.when(F.length(c) > limit, cut).otherwise(c)


def round_half_even(c: Column, digits: int) -> Column:
    """Round a double on its exact binary value, ties to even.

    ``round`` of Spark rounds the shortest decimal text half up (2.675 -> 2.68). ``format_number`` works
    on the binary value, so it gives 2.67. It makes a short text, hence for aggregated rows only.
    """
    text = F.format_number(c.cast("double"), digits)
    return F.regexp_replace(text, ",", "").cast("double")


def money(c: Column) -> Column:
    """``$1,234,568``."""
    return F.concat(F.lit("$"), F.format_number(c.cast("double"), 0))


def plain_number(c: Column, digits: int) -> Column:
    """A number without exponent, separators or trailing zeros: 534400.0 -> 534400."""
    text = F.regexp_replace(F.format_number(c.cast("double"), digits), ",", "")
    return F.regexp_replace(text, r"\.?0+$", "") if digits else text
