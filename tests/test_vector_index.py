"""The block index: exact results, skipped blocks, bounded blocks, stored tables that stay in place."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from procurisk.operators import vector_index

ITEMS = "item_id long, scope string, vector array<float>"
QUERIES = "query_id long, scope string, vector array<float>"


def rows_of(matrix, scopes, first=0):
    return [(first + i, scope, [float(x) for x in row]) for i, (row, scope) in enumerate(zip(matrix, scopes))]


def brute(queries, items, k):
    found = []
    for q, scope, asked in queries:
        own = [(float(np.dot(np.float64(np.float32(asked)), np.float64(np.float32(v)))), i) for i, s, v in items if s == scope]
        found += [(q, i, rank) for rank, (_, i) in enumerate(sorted(own, key=lambda x: (-x[0], x[1]))[:k], 1)]
    return sorted(found)


def got(rows):
    return sorted((r["query_id"], r["item_id"], r["rank"]) for r in rows.collect())


@pytest.fixture(scope="module")
def clustered(spark):
    """One scope with most of the items, in tight clusters; a small scope; copies of one vector; queries near clusters."""
    random = np.random.default_rng(11)
    centres = random.normal(size=(20, 8)) * 10
    matrix = centres[random.integers(0, 20, 2400)] + random.normal(size=(2400, 8)) * 0.1
    items = rows_of(matrix, ["hot"] * 2000 + ["small"] * 400) + rows_of([matrix[5]] * 1200, ["hot"] * 1200, 5000)
    asked = centres[random.integers(0, 20, 40)] + random.normal(size=(40, 8)) * 0.1
    queries = rows_of(asked, ["hot", "small"] * 20)
    index = vector_index.build_index(spark.createDataFrame(items, ITEMS).repartition(6), 5, 50)
    return items, queries, index, spark.createDataFrame(queries, QUERIES)


def test_exact_and_bounded(clustered):
    items, queries, index, asked = clustered
    assert got(vector_index.search(asked, index, 5, 7)) == brute(queries, items, 5)
    sizes = [len(r["members"]) for r in index.blocks.collect()]
    assert max(sizes) < 100 and sum(sizes) == 2400 + 4  # of 1,201 equal vectors five can be wanted
    with pytest.raises(ValueError):
        vector_index.search(asked, index, 6)


def test_most_blocks_are_skipped(clustered):
    items, queries, index, asked = clustered
    sized = vector_index._in_parts(asked.withColumn("dims", F.size("vector")), "query_id", 7, vector_index.BY_SCOPE)
    found = got(vector_index.search(asked, index, 5))
    score = {(q, i): np.dot(np.float32(a).astype(float), np.float32(v).astype(float)) for q, s, a in queries for i, t, v in items if s == t}
    floors = asked.sparkSession.createDataFrame([(q, float(score[q, i])) for q, i, rank in found if rank == 5], "query_id long, floor double")
    open_ = sized.withColumns({"floor": F.lit(None).cast("double"), "seen": F.array().cast("array<long>")})
    bounded = open_.drop("floor").join(floors, "query_id")
    every = sum(1 for r in index.summaries.collect() for _, s, _ in queries if r["scope"] == s)
    first = vector_index.blocks_to_read(open_, index, 5, True).count()
    rest = vector_index.blocks_to_read(bounded, index, 5, False).count()
    assert vector_index.blocks_to_read(open_, index, 5, False).count() == every  # without a floor nothing is skipped
    assert every > 1000 and first + rest < every / 5


def test_blocks_are_about_as_many_as_the_items_fill(spark):
    """A scope of some more blocks than there are centres does not fall apart into the pairs of centres."""
    matrix = np.random.default_rng(17).normal(size=(6000, 8))
    items = rows_of(matrix, ["all"] * 6000)
    index = vector_index.build_index(spark.createDataFrame(items, ITEMS).repartition(4), 3, 20)
    assert 300 <= index.summaries.count() < 900
    queries = rows_of(matrix[:10], ["all"] * 10)
    assert got(vector_index.search(spark.createDataFrame(queries, QUERIES), index, 3)) == brute(queries, items, 3)


def test_packed_vectors(spark):
    """Packed in either way, alone, together and cut out of a longer list, vectors come back bit by bit."""
    random = np.random.default_rng(19)
    full, few = random.normal(size=(7, 12)), np.where(random.random((9, 12)) < 0.2, random.normal(size=(9, 12)), 0.0)
    few[0], few[1, 3], few[2, 0], few[3, 1] = 0.0, np.nan, -0.0, np.inf
    for matrix in (full, few, np.zeros((3, 0)), np.zeros((4, 1)), np.zeros((2, 500))):
        back = vector_index.matrix_of(vector_index.packed(matrix))
        assert back.shape == matrix.shape and back.tobytes() == matrix.tobytes()
    both, matrix = pa.concat_arrays([vector_index.packed(few), vector_index.packed(full)]), np.vstack([few, full])
    for start, end in ((0, 16), (3, 12), (9, 16), (2, 5)):
        assert vector_index.matrix_of(both.slice(start, end - start)).tobytes() == matrix[start:end].tobytes()
    assert vector_index.packed(few).nbytes < few.nbytes


def test_batches_are_small_only_while_items_are_made_ready(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with vector_index._handing_over(spark, 7):
        assert spark.conf.get(key) == "7"
    with pytest.raises(KeyError), vector_index._handing_over(spark, 10**9):
        assert spark.conf.get(key) == before
        raise KeyError
    assert spark.conf.get(key) == before


def ancestors(plan, leaf):
    """The nodes above the scan whose line holds ``leaf``."""
    lines = plan.splitlines()
    depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in lines]
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and leaf in line)
    above, limit = [], depth[at]
    for i in range(at, -1, -1):
        if depth[i] < limit:
            above.append(lines[i])
            limit = depth[i]
    return above


def test_blocks_stay_in_place(spark, clustered):
    _, _, index, asked = clustered
    sized = asked.withColumn("dims", F.size("vector"))
    pairs = sized.join(index.summaries.select("scope", "block"), "scope").select("query_id", "scope", "dims", "block")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = vector_index.scored(sized, pairs, index, 5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    above = ancestors(plan, "members")
    join = next(i for i, line in enumerate(above) if "Join" in line)
    assert not any("Exchange" in line or "Generate" in line for line in above[:join])
    assert "Generate" not in plan  # nothing is copied


def test_stored_index(spark, clustered, tmp_path):
    items, queries, index, asked = clustered
    index.write(str(tmp_path / "index"))
    again = vector_index.read_index(spark, str(tmp_path / "index"))
    assert got(vector_index.search(asked, again, 3)) == brute(queries, items, 3)
    assert "Bucketed: true" in again.blocks.groupBy("block").count()._jdf.queryExecution().executedPlan().toString()


def test_awkward_vectors(spark):
    """Nulls, odd numbers, other lengths, empty vectors, repeated ids, columns that clash, a query of several scopes, fewer than k items."""
    nan, inf = float("nan"), float("inf")
    items = [
        (1, "a", [1.0, 0.0]), (2, "a", [nan, 1.0]), (3, "a", [inf, 0.0]), (4, "a", None), (5, "a", [1.0]), (6, "b", []), (7, "b", [2.0, 2.0]),
        (8, "a", [None, 1.0]), (9, None, [9.0, 9.0]), (1, "a", [0.5, 0.0]),
    ]
    queries = [(1, "a", [1.0, 1.0]), (1, "b", [1.0, 1.0]), (2, "a", [nan, 1.0]), (3, "b", []), (4, "a", None), (5, "nowhere", [1.0, 1.0])]
    table = spark.createDataFrame(items, ITEMS).select("*", F.lit("x").alias("block"), F.lit("x").alias("cell"), F.lit("x").alias("n"))
    asked = spark.createDataFrame(queries, QUERIES).select("*", F.lit("x").alias("bound"), F.lit("x").alias("rank"))
    index = vector_index.build_index(table, 10, 2)
    found = {}
    for r in vector_index.search(asked, index, 10).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["item_id"], r["score"]))
    ranks = {q: [(i, s) for _, i, s in sorted(rows)] for q, rows in found.items()}
    assert [i for i, _ in ranks[1]] == [3, 7, 1, 1, 2, 8] and [s for _, s in ranks[1]][:4] == [inf, 4.0, 1.0, 0.5]
    everywhere = vector_index.search(asked.where("query_id = 4 OR query_id = 5"), index, 10, everywhere=True)
    assert [r["item_id"] for r in everywhere.orderBy("rank").collect()] == [3, 9, 7, 1, 1, 2, 8]
    inside = vector_index.search(asked.where("query_id = 5"), index.named(), 10, everywhere=True)
    assert [r["item_id"] for r in inside.orderBy("rank").collect()] == [3, 7, 1, 1, 2, 8]
    assert sorted(i for i, _ in ranks[2]) == [1, 1, 2, 3, 8] and set(ranks) == {1, 2, 3}
    assert ranks[3] == [(6, 0.0)]
    assert vector_index.search(asked, vector_index.build_index(table.limit(0), 3), 3).count() == 0
