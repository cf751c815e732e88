"""Which texts contain which others: an equi join on the rarest gram of each needle, then a check.

A needle of n characters is looked up by grams of the largest length of GRAMS that is not above n, so a gram is at least half as long
as its needle, or as long as the longest of GRAMS. Haystacks give their distinct grams of the lengths in use once: at most
one row per character and length. Grams are counted over the haystacks; each needle keeps the one that fewest haystacks hold and
meets only those. A needle with a gram that no haystack holds is contained nowhere and goes at once. Needles that are as long as their
gram need no check. The blank needle, which every haystack contains, is kept out of the join.

Nulls are contained nowhere and contain nothing; repeated texts count once; comparison is by code points.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procurisk.operators.skew import join_salted

GRAMS = (1, 2, 3, 6, 12, 24)


def gram_length(text: Column) -> Column:
    """The length of the grams a needle is looked up by; null for the blank one."""
    size = F.length(text)
    found = F.when(size >= GRAMS[0], GRAMS[0])
    for length in GRAMS[1:]:
        found = F.when(size >= length, length).otherwise(found)
    return found


def grams(text: Column, length: Column) -> Column:
    """The distinct grams of a text of one length, in time linear in the text."""

    def of_letters(letters: Column) -> Column:
        starts = F.when(F.size(letters) >= length, F.sequence(F.lit(1), F.size(letters) - length + 1))
        parts = F.transform(starts, lambda at: F.array_join(F.slice(letters, at, length), ""))
        return F.coalesce(F.array_distinct(parts), F.array().cast("array<string>"))

    # as the item of an array the letters are worked out once a text, not once a gram
    letters = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))
    return F.flatten(F.transform(F.array(letters), of_letters))


def _with_grams(haystacks: DataFrame, needles: DataFrame) -> DataFrame:
    """Add ``gram``: a row for each distinct gram of the first column, of the lengths (six at most) that needles are looked up by."""
    lengths = needles.agg(F.array_sort(F.collect_set(gram_length(F.col(needles.columns[0]))))).scalar()
    sized = haystacks.withColumn("_length", F.explode(lengths))
    exploded = sized.withColumn("gram", F.explode(grams(F.col(haystacks.columns[0]), F.col("_length"))))
    return exploded.drop("_length")


def haystack_grams(needles: DataFrame, haystacks: DataFrame) -> DataFrame:
    """Rows of (haystack, ``gram``): each haystack's distinct grams of the lengths that needles are looked up by."""
    haystack = haystacks.columns[0]
    return _with_grams(haystacks.select(haystack).where(F.col(haystack).isNotNull()).distinct(), needles)


def keyed_needles(needles: DataFrame, counted: DataFrame) -> DataFrame:
    """Each distinct needle that is not blank with its rarest gram; those with a gram that is not ``counted`` (gram, n) go."""
    needle = needles.columns[0]
    texts = needles.select(needle).where(F.length(needle) > 0).distinct()
    own = texts.select(needle, grams(F.col(needle), gram_length(F.col(needle))).alias("_grams"))
    rows = own.select(needle, F.size("_grams").alias("_wanted"), F.explode("_grams").alias("gram"))
    held = join_salted(rows, counted, ["gram"])
    rarest = held.groupBy(needle).agg(
        F.min(F.struct("n", "gram")).alias("_least"), F.count("*").alias("_found"), F.max("_wanted").alias("_wanted")
    )
    return rarest.where(F.col("_found") == F.col("_wanted")).select(needle, F.col("_least.gram").alias("gram"))


def _blank(needles: DataFrame) -> Column:
    """Whether a blank needle is among them."""
    return F.coalesce(needles.agg(F.max(F.length(needles.columns[0]) == 0)).scalar(), F.lit(False))


def contained(needles: DataFrame, haystacks: DataFrame) -> DataFrame:
    """Distinct pairs (needle, haystack) where the needle occurs inside the haystack. Both inputs have one text column."""
    needle, haystack = needles.columns[0], haystacks.columns[0]
    held = haystack_grams(needles, haystacks)
    keyed = keyed_needles(needles, held.groupBy("gram").agg(F.count("*").alias("n")))
    pairs = join_salted(held, keyed, ["gram"]).where(F.contains(haystack, needle)).select(needle, haystack)
    everywhere = haystacks.select(haystack).where(F.col(haystack).isNotNull()).distinct().where(_blank(needles))
    return pairs.unionByName(everywhere.select(F.lit("").alias(needle), haystack))


def first_containing(needles: DataFrame, haystacks: DataFrame, value: str) -> DataFrame:
    """(needle, ``value``): the least value of the haystacks that contain each needle; needles that none contains are left out.

    ``haystacks`` has the text first and the value beside it. Needles as long as their gram meet one row per gram, not one per haystack.
    """
    needle, haystack = needles.columns[0], haystacks.columns[0]
    least = haystacks.where(F.col(haystack).isNotNull()).groupBy(haystack).agg(F.min(value).alias(value))
    held = _with_grams(least, needles)
    by_gram = held.groupBy("gram").agg(F.count("*").alias("n"), F.min(value).alias(value))
    whole = F.length(needle) == gram_length(F.col(needle))
    exact = needles.select(needle).where(whole).distinct().join(by_gram, F.col(needle) == F.col("gram")).select(needle, value)
    longer = keyed_needles(needles.select(needle).where(~whole), by_gram.select("gram", "n"))
    checked = (
        join_salted(held, longer, ["gram"]).where(F.contains(haystack, needle)).groupBy(needle).agg(F.min(value).alias(value))
    )
    any_value = least.agg(F.min(value).alias(value)).where(_blank(needles)).where(F.col(value).isNotNull())
    return exact.unionByName(checked).unionByName(any_value.select(F.lit("").alias(needle), value))


def contains_or_is_contained(asked: DataFrame, held: DataFrame) -> DataFrame:
    """Distinct pairs (asked, held) where either text contains the other; both have one text column."""
    names: Sequence[str] = (asked.columns[0], held.columns[0])
    return contained(asked, held).unionByName(contained(held, asked).select(*names)).distinct()
