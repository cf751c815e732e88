"""Containment by rarest grams against plain Python, and how many rows it makes."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from procurisk.operators import containment, retrieval, skew

_NAME = st.text(alphabet="ab _é😀", max_size=9)


def texts(spark, values, name):
    return spark.createDataFrame([(x,) for x in values], f"{name} string")


def brute(needles, haystacks):
    return sorted((n, h) for n in set(needles) for h in set(haystacks) if n is not None and h is not None and n in h)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(_NAME, min_size=3, max_size=14), st.lists(_NAME, min_size=3, max_size=14))
def test_contained_agrees_with_brute_force(spark, needles, haystacks):
    got = containment.contained(texts(spark, needles, "needle"), texts(spark, haystacks, "haystack"))
    assert sorted(map(tuple, got.collect())) == brute(needles, haystacks)


def test_all_lengths_nulls_and_blanks(spark):
    base = "the quick brown fox jumps over the lazy dog, twice a day é 😀"
    needles = [base[i : i + n] for n in (0, 1, 2, 3, 4, 5, 6, 7, 11, 12, 13, 23, 24, 25, 40, 60) for i in (0, 3, len(base) - n)]
    needles += [None, "zzz", "the quick brown cat", base + "!", " ", "x" * 30]
    haystacks = [base, base.upper(), "", None, base[:30], base[10:], base + base, "x" * 200, "the"]
    got = containment.contained(texts(spark, needles, "needle"), texts(spark, haystacks, "haystack"))
    assert sorted(map(tuple, got.collect())) == brute(needles, haystacks)
    files = spark.createDataFrame([(h, f"file{i}") for i, h in enumerate(haystacks * 2)], "haystack string, file string")
    first = {n: min(f for h, f in map(tuple, files.collect()) if h is not None and n in h) for n, _ in brute(needles, haystacks)}
    found = containment.first_containing(texts(spark, needles, "needle"), files, "file").collect()
    assert {r["needle"]: r["file"] for r in found} == first and len(found) == len(first)
    for some in (needles, haystacks):
        assert containment.contained(texts(spark, some, "needle").limit(0), texts(spark, haystacks, "haystack")).count() == 0
    assert containment.first_containing(texts(spark, needles, "needle"), files.limit(0), "file").count() == 0


def test_rows_are_linear_in_the_characters(spark):
    """Needles of sixty different lengths: the haystacks give a row per character and gram length, not per character and needle length."""
    random_ = spark.range(40).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: F.md5(F.concat("id", i))), "").alias("haystack"))
    haystacks = random_.cache()
    needles = haystacks.limit(1).select(F.explode(F.sequence(F.lit(1), F.lit(60))).alias("n"), "haystack").select(F.substr("haystack", F.lit(7), F.col("n")).alias("needle"))
    characters = haystacks.agg(F.sum(F.length("haystack"))).first()[0]
    held = containment.haystack_grams(needles, haystacks)
    assert held.count() <= len(containment.GRAMS) * characters
    # long needles meet the haystacks that hold their rarest gram only: here the one they come from
    keyed = containment.keyed_needles(needles.where(F.length("needle") >= 24), held.groupBy("gram").agg(F.count("*").alias("n")))
    assert keyed.count() == 37 and keyed.join(held, "gram").count() == 37


def test_no_blank_key(spark):
    haystacks = texts(spark, [f"name {i}" for i in range(50)], "haystack")
    needles = texts(spark, ["", "name 7"], "needle")
    assert containment.haystack_grams(needles, haystacks).where("gram = ''").count() == 0
    assert containment.contained(needles, haystacks).count() == 51


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_null_keys_spread_in_left_joins(spark, threshold):
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.col("id")).alias("key"), F.lit("x").alias("other"))
    small = spark.range(1500).select(F.col("id").alias("key"), F.lit("y").alias("found"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = skew.left_join_spread(big, small, "key", ["id"])
        rows = joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count_if(F.col("key").isNull()).alias("n")).collect()
        assert joined.columns == ["key", "id", "other", "found"] and joined.count() == 3000
        assert joined.where("found IS NOT NULL").count() == 500
        assert max(r["n"] for r in rows) < 1500, rows  # of 2,000 null keys
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_blank_vendor_names_look_at_every_named_clause(spark):
    clauses = spark.createDataFrame(
        [(1, "Acme", [1.0]), (2, "Beta", [3.0]), (3, None, [9.0]), (4, " ", [2.0])], "chunk_id long, vendor_name string, vector array<float>"
    )
    asked = spark.createDataFrame(
        [("a", " ", [1.0]), ("b", None, [1.0]), ("c", "acme ltd", [1.0])], "vendor_id string, vendor_name string, vector array<float>"
    )
    found = {(r["vendor_id"], r["rank"]): (r["chunk_id"], r["scope"]) for r in retrieval.vendor_preferred_top_k(asked, clauses, 2).collect()}
    assert found == {
        ("a", 1): (2, "vendor"), ("a", 2): (4, "vendor"), ("b", 1): (3, "all"), ("b", 2): (2, "all"), ("c", 1): (4, "vendor"),
        ("c", 2): (1, "vendor"),
    }
