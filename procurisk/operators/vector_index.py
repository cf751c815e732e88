"""Exact search by inner product over a stored index of blocks that are skipped where a bound allows it.

Items lie in blocks of bounded size; large scopes are cut along sampled centres, so the items of a block are close to each other. A
block's summary holds its centre, its radius and its largest norm: for a query q no item of the block scores above

    min(q * centre + |q| * radius, |q| * largest norm).

A search first looks into the most promising blocks, just enough of them to hold k items; the k-th best score found there is a floor.
Every other block whose bound lies below a query's floor is skipped, the rest is scored exactly. Blocks are stored as a
table bucketed by block: they stay where they are, and only queries travel. Summaries meet the queries of their scope in groups.
Vectors are packed into bytes once, before they are sorted, dealt and stored: a list costs every step some work for each component.

A vector that is null takes no part; vectors of different length never meet. A score that is not a number ranks last; blocks with
components that are not finite, and queries with such, have no bound and are always read. Ties go to the smaller item id. Of equal vectors
of a scope only the ``deepest`` smallest ids are kept: no other can be among the first ``deepest``.
"""

from __future__ import annotations

import math
import sys
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from procurisk.operators.skew import join_salted
from procurisk.session import cut_lineage, ensure_checkpoint_dir, open_bucketed, write_bucketed

# the functions below travel to the workers by value, so the workers do not need the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Items and bytes of vectors of a block, at most about so many.
ITEMS_PER_BLOCK = 2048
BLOCK_BYTES = 1 << 20
#: Bytes of vectors, before they are packed, of a bucket of blocks, about: what a task hands over at a time stays small in a large index.
BUCKET_BYTES = 1 << 25
#: Blocks of an index that is searched everywhere are larger by these factors: most queries read most blocks, and a query travels to
#: each block that it reads.
WIDE_ITEMS, WIDE_BYTES = 4, 16
#: Queries, and block summaries, that meet in one row.
QUERIES_PER_BATCH = 256
SUMMARIES_PER_GROUP = 512
#: Batches, and bytes of vectors, of the queries that come to a block in one row, at most about so many: the block's items are handed
#: over once for all of them.
BATCHES_PER_ROW, QUERY_BYTES = 16, 1 << 24
#: A component of a packed vector where few are not zero.
PLACE = np.dtype([("place", "<u4"), ("value", "<f8")])
#: Vectors, and bytes of them, that a task takes at a time while items are made ready.
VECTORS_AT_ONCE, BYTES_AT_ONCE = 2048, 1 << 23
#: Centres that large scopes are cut along: a scope of n blocks uses the first 4, 16, 64 or 256, or pairs of them. Pairs make up to
#: 65,536 cells, so a scope of fewer blocks than PAIRED would lie in blocks of a few items each, and every search would meet them all.
LEVELS = (4, 16, 64, 256)
PAIRED = 4096
#: What a query and a block have in common, unless the query looks everywhere.
BY_SCOPE = ("scope", "dims")
#: Bounds give way by this share: scores are added in floating point.
SLACK = 1e-9


@dataclass
class VectorIndex:
    """``blocks``: block, scope, dims, members (item_id, vector). ``summaries``: block, scope, dims, n, centre, radius, norm.

    Vectors and centres are packed (see ``packed``).
    """

    blocks: DataFrame
    summaries: DataFrame
    deepest: int

    def named(self) -> VectorIndex:
        """The same index without the blocks of the null scope."""
        return replace(self, summaries=self.summaries.where("scope IS NOT NULL"))

    def write(self, path: str) -> None:
        """Both tables under ``path``, the blocks bucketed as they are here."""
        buckets = self.blocks.rdd.getNumPartitions()
        write_bucketed(self.blocks, f"{path}/blocks", "block", buckets)
        layout = self.summaries.sparkSession.range(1).select(F.lit(buckets).alias("buckets"), F.lit(self.deepest).alias("deepest"))
        self.summaries.write.parquet(f"{path}/summaries")
        layout.write.parquet(f"{path}/layout")


@dataclass
class CelledItems:
    """``rows``: item_id, scope, dims, vector (packed), cells; of equal vectors of a scope the ``deepest`` smallest ids. Stored.

    ``numbers`` is how many components they have in all.
    """

    rows: DataFrame
    deepest: int
    numbers: int

    def everywhere(self, condition: Column | None = None) -> CelledItems:
        """The same items (those of the condition) as one scope."""
        rows = self.rows if condition is None else self.rows.where(condition)
        return replace(self, rows=_without_copies(rows.withColumn("scope", F.lit("")), self.deepest))


def read_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index that was written before, also by another session."""
    layout = spark.read.parquet(f"{path}/layout").first()
    blocks = open_bucketed(spark, f"{path}/blocks", "block", layout["buckets"])
    return VectorIndex(blocks, spark.read.parquet(f"{path}/summaries"), layout["deepest"])


def packed(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as bytes: all components behind a head, or a head and the components that are not zero, if that is shorter."""
    rows, dims = matrix.shape
    some = (matrix != 0) | np.signbit(matrix)
    counts = some.sum(axis=1) + 1
    if PLACE.itemsize * counts.sum() < 8 * rows * (dims + 1):
        ends = np.cumsum(counts)
        held = np.zeros(int(counts.sum()), dtype=PLACE)
        head = np.zeros(len(held), dtype=bool)
        head[ends - counts] = True
        held["value"][head] = dims
        held["place"][~head], held["value"][~head] = some.nonzero()[1], matrix[some]
        offsets, values = np.append(0, ends) * PLACE.itemsize, held.tobytes()
    else:
        whole = np.empty((rows, dims + 1), dtype="<f8")
        whole[:, 0], whole[:, 1:] = np.array([1], dtype="<i8").view("<f8"), matrix
        offsets, values = np.arange(rows + 1) * 8 * (dims + 1), whole.tobytes()
    buffers = [None, pa.py_buffer(offsets.astype("<i8")), pa.py_buffer(values)]
    return pa.Array.from_buffers(pa.large_binary(), rows, buffers).cast(pa.binary())


def _unpacked(vectors: pa.Array) -> np.ndarray:
    """What ``packed`` has made."""
    if not len(vectors):
        return np.zeros((0, 0))
    ends = np.frombuffer(vectors.buffers()[1], dtype="<i4")[vectors.offset : vectors.offset + len(vectors) + 1]
    values = vectors.buffers()[2]
    whole = np.frombuffer(values, dtype=np.uint8)[ends[:-1]] == 1
    if whole.all():
        width = (int(ends[1]) - int(ends[0])) // 8
        held = np.frombuffer(values, dtype="<f8", count=len(vectors) * width, offset=int(ends[0]))
        return held.reshape(len(vectors), width)[:, 1:].copy()
    if whole.any():
        parts = [(rows, _unpacked(vectors.take(pa.array(rows)))) for rows in (np.flatnonzero(whole), np.flatnonzero(~whole))]
        matrix = np.empty((len(vectors), parts[0][1].shape[1]))
        for rows, part in parts:
            matrix[rows] = part
        return matrix
    held = np.frombuffer(values, dtype=PLACE, count=(int(ends[-1]) - int(ends[0])) // PLACE.itemsize, offset=int(ends[0]))
    counts = np.diff(ends) // PLACE.itemsize
    head = np.zeros(len(held), dtype=bool)
    head[np.cumsum(counts) - counts] = True
    matrix = np.zeros((len(vectors), int(held["value"][0])))
    matrix[np.repeat(np.arange(len(vectors)), counts - 1), held["place"][~head]] = held["value"][~head]
    return matrix


def _with_packed(queries: DataFrame) -> DataFrame:
    """The same rows with packed vectors; none is null."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            at = batch.schema.get_field_index("vector")
            vectors = batch.column(at)
            lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
            for dims in np.unique(lengths).tolist():
                some = batch.take(pa.array(np.flatnonzero(lengths == dims)))
                yield some.set_column(at, "vector", packed(matrix_of(some.column(at))))

    fields = [T.StructField("vector", T.BinaryType()) if f.name == "vector" else f for f in queries.schema.fields]
    return queries.mapInArrow(run, T.StructType(fields))


def matrix_of(vectors: pa.Array) -> np.ndarray:
    """A row per vector, packed or a list; all have the same length and none is null. A null component is not a number."""
    if pa.types.is_binary(vectors.type):
        return _unpacked(vectors)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(vectors), len(values) // max(1, len(vectors)))


def nested(rows: pa.Array, i: int) -> pa.StructArray:
    """The items of the i-th row of a list column."""
    return rows[i].values


def _with_cells(items: DataFrame, centres: dict[int, list[list[float]]]) -> DataFrame:
    """Packed vectors and ``cells``: the nearest centre at each level, then the pair of the nearest two; -1 for vectors that are not finite."""

    def assigned(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {dims: np.array(rows, dtype=np.float64) for dims, rows in centres.items()}
        for batch in stream:
            lengths = batch.column("dims").to_numpy(zero_copy_only=False)
            chosen = [np.flatnonzero(lengths == dims) for dims in np.unique(lengths)]
            for rows in (rows[at : at + VECTORS_AT_ONCE] for rows in chosen for at in range(0, len(rows), VECTORS_AT_ONCE)):
                part, dims = batch.take(pa.array(rows)), int(lengths[rows[0]])
                vectors = matrix_of(part.column("vector"))
                cells = np.full((part.num_rows, len(LEVELS) + 1), -1, dtype=np.int64)
                if dims in tables:
                    centre, rows = tables[dims], np.flatnonzero(np.isfinite(vectors).all(axis=1))
                    apart = (centre**2).sum(axis=1) - 2 * vectors[rows] @ centre.T
                    for level, size in enumerate(LEVELS):
                        cells[rows, level] = apart[:, :size].argmin(axis=1)
                    first = cells[rows, len(LEVELS) - 1]
                    apart[np.arange(len(rows)), first] = np.inf
                    cells[rows, -1] = first * LEVELS[-1] + apart.argmin(axis=1)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), cells.shape[1]).cast(pa.list_(pa.int64()))
                columns = [part.column("item_id"), part.column("scope"), part.column("dims"), packed(vectors), lists]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "scope", "dims", "vector", "cells"])
            pa.default_memory_pool().release_unused()

    kinds = T._parse_datatype_string("vector binary, cells array<long>")
    fields = [items.schema[c] for c in ("item_id", "scope", "dims")]
    return items.select("item_id", "scope", "dims", "vector").mapInArrow(assigned, T.StructType([*fields, *kinds.fields]))


def _summarised(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        found: list[tuple] = []
        for i in range(batch.num_rows):
            vectors = matrix_of(nested(batch.column("members"), i).field("vector"))
            if np.isfinite(vectors).all():
                centre = vectors.mean(axis=0) if vectors.size else np.zeros(vectors.shape[1])
                radius = np.sqrt(((vectors - centre) ** 2).sum(axis=1)).max()
                norm = np.sqrt((vectors**2).sum(axis=1)).max()
            else:
                centre, radius, norm = np.zeros(vectors.shape[1]), np.inf, np.inf
            found.append((len(vectors), centre, float(radius), float(norm)))
        n, centre, radius, norm = zip(*found) if found else ((),) * 4
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("block", "scope", "dims")),
                pa.array(n, pa.int64()),
                pa.array([packed(c[None])[0] for c in centre], pa.binary()),
                pa.array(radius, pa.float64()),
                pa.array(norm, pa.float64()),
            ],
            ["block", "scope", "dims", "n", "centre", "radius", "norm"],
        )


def _without_copies(items: DataFrame, deepest: int) -> DataFrame:
    """Of equal vectors of a scope, the ``deepest`` smallest ids; cut down in every task before the copies meet."""
    # a digest first, so that the sort seldom compares whole vectors
    number = F.row_number().over(W.partitionBy("_digest", "scope", "vector").orderBy("item_id"))
    numbered = items.withColumn("_digest", F.xxhash64("vector")).withColumn("_copy", number)
    return numbered.where(F.col("_copy") <= deepest).drop("_copy", "_digest")


@contextmanager
def _handing_over(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside hands Python at most so many rows at a time: the lists of vectors are held several times on their way."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if int(before) <= 0 or int(before) > rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def celled_items(items: DataFrame, deepest: int) -> CelledItems:
    """(item_id, scope, vector) made ready for indexes: packed, told apart by the nearest centres, without needless copies, and stored.

    The driver sees at most LEVELS[-1] sampled vectors of each of a few lengths.
    """
    rows = items.select("item_id", "scope", "vector").where("vector IS NOT NULL").withColumn("dims", F.size("vector"))
    sampled = (
        rows.where("forall(vector, x -> x IS NOT NULL AND abs(x) < double('Infinity'))")
        .orderBy(F.xxhash64("item_id"), "item_id")
        .limit(LEVELS[-1])
        .select("dims", "vector")
    )
    centres: dict[int, list[list[float]]] = {}
    for dims, vector in sampled.collect():
        centres.setdefault(dims, []).append(list(vector))
    with _handing_over(items.sparkSession, max(1, min(VECTORS_AT_ONCE, BYTES_AT_ONCE // (8 * max([1, *centres]))))):
        stored = cut_lineage(_without_copies(_with_cells(rows, centres), deepest))
    return CelledItems(stored, deepest, stored.agg(F.sum("dims")).first()[0] or 0)


def build_index(
    items: DataFrame | CelledItems, deepest: int, items_per_block: int = ITEMS_PER_BLOCK, block_bytes: int = BLOCK_BYTES
) -> VectorIndex:
    """Index of (item_id, scope, vector), or of what ``celled_items`` has made ready, for searches up to ``deepest``.

    Sizes of scopes and cells meet the items by salted joins, so a scope or a cell with a large share of the items spreads over many
    tasks. Items are dealt to the buckets of their blocks once, and put together there.
    """
    ready = items if isinstance(items, CelledItems) else celled_items(items, deepest)
    if deepest > ready.deepest:
        raise ValueError(f"the items were made ready for searches up to {ready.deepest}")
    celled = ready.rows

    fitting = F.greatest(F.lit(1), F.least(F.lit(items_per_block), F.floor(F.lit(block_bytes) / F.greatest(F.col("dims") * 8, F.lit(1)))))
    sizes = celled.groupBy("scope", "dims", "cells").agg(F.count("*").alias("n"))
    # a scope has at most as many of these rows as there are pairs of centres
    wanted = F.ceil(F.sum("n").over(W.partitionBy("scope", "dims")) / fitting)
    level = F.when(wanted <= 1, 0)
    for number, size in enumerate(LEVELS, 1):
        level = level.when(wanted <= (size if size < LEVELS[-1] else PAIRED), number)
    leveled = sizes.withColumn("level", level.otherwise(len(LEVELS) + 1))
    cell = F.when(F.col("level") == 0, 0).otherwise(F.get("cells", F.col("level") - 1))
    parts = F.ceil(F.sum("n").over(W.partitionBy("scope", "dims", "cell")) / fitting).cast("long")
    plan = leveled.withColumn("cell", cell).select("scope", "dims", "cells", "cell", parts.alias("parts"))
    dealt = join_salted(celled, plan, ["scope", "dims", "cells"], sizes=sizes)
    part = F.pmod(F.xxhash64("item_id"), F.col("parts"))
    spark = celled.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(8 * ready.numbers / BUCKET_BYTES))
    blocks = (
        dealt.select("item_id", "scope", "dims", "vector", F.xxhash64("scope", "dims", "cell", part).alias("block"))
        .repartition(buckets, "block")
        .groupBy("block", "scope", "dims")
        .agg(F.collect_list(F.struct("item_id", "vector")).alias("members"))
    )
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    stored = write_bucketed(blocks, folder, "block", buckets, deal=False)
    kinds = "n long, centre binary, radius double, norm double"
    schema = T.StructType([stored.schema[c] for c in ("block", "scope", "dims")] + list(T._parse_datatype_string(kinds)))
    return VectorIndex(stored, cut_lineage(stored.mapInArrow(_summarised, schema)), deepest)


def _bounds(asked: np.ndarray, centre: np.ndarray, radius: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """A row per query, a column per block: no item of the block scores higher. Infinite where nothing is known."""
    with np.errstate(invalid="ignore", over="ignore"):
        size = np.sqrt((asked**2).sum(axis=1))[:, None]
        by_centre = asked @ centre.T + size * radius
        bound = np.minimum(by_centre, size * norm) + SLACK * size * (norm + radius)
    return np.where(np.isnan(bound), np.inf, bound)


def _in_parts(rows: DataFrame, key: str, per: int | Column, by: Sequence[str]) -> DataFrame:
    """Add ``part``: rows of equal ``by`` are dealt into parts of about ``per``. The sizes are one narrow row a group."""
    parts = rows.groupBy(*by).agg(F.ceil(F.count("*") / per).cast("long").alias("_parts"))
    dealt = rows.join(parts, list(by)).withColumn("part", F.pmod(F.xxhash64(key), F.col("_parts")))
    return dealt.drop("_parts")


def _met(queries: DataFrame, summaries: DataFrame, by: Sequence[str]) -> DataFrame:
    """Batches of queries and groups of summaries with equal ``by``, a row for each of both: the summaries stay whole and few."""

    def packed(df: DataFrame, entry: Column, name: str) -> DataFrame:
        return df.groupBy(*by, "part").agg(F.collect_list(entry).alias(name)).drop("part")

    asked = packed(queries, F.struct("query_id", "vector", "floor", "seen"), "asked")
    groups = _in_parts(summaries, "block", SUMMARIES_PER_GROUP, by)
    known = packed(groups, F.struct("block", "scope", "n", "centre", "radius", "norm"), "known")
    return asked.join(known, list(by))


def _first_places(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest scores of every row, best first, equal ones by column. Only what reaches the k-th is sorted."""
    width = scores.shape[1]
    if width > k:
        row, column = np.nonzero(scores >= np.partition(scores, width - k, axis=1)[:, width - k, None])
    else:
        row, column = (places.ravel() for places in np.indices(scores.shape))
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], column[first]


def blocks_to_read(queries: DataFrame, index: VectorIndex, k: int, first: bool, by: Sequence[str] = BY_SCOPE) -> DataFrame:
    """(query_id, dims, block, scope, bound, n). ``first``: the best blocks of each group that hold k items; else all that reach the floor.

    ``queries`` has query_id, scope, dims, part, vector, ``floor`` (null: none known) and ``seen`` (blocks that were read before).
    """

    def chosen(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for i in range(batch.num_rows):
                asked, known = nested(batch.column("asked"), i), nested(batch.column("known"), i)
                bound = _bounds(
                    matrix_of(asked.field("vector")),
                    matrix_of(known.field("centre")),
                    *(known.field(c).to_numpy(zero_copy_only=False) for c in ("radius", "norm")),
                )
                n, block = (known.field(c).to_numpy(zero_copy_only=False) for c in ("n", "block"))
                if first:
                    order = np.lexsort((np.broadcast_to(block, bound.shape), -bound), axis=1)
                    before = np.cumsum(n[order], axis=1) - n[order]
                    row, place = np.nonzero(before < k)
                    column = order[row, place]
                else:
                    floor = pc.fill_null(asked.field("floor"), -np.inf).to_numpy(zero_copy_only=False)
                    row, column = np.nonzero(bound >= floor[:, None])
                    seen = asked.field("seen").to_pylist()
                    new = np.array([b not in seen[r] for r, b in zip(row.tolist(), block[column].tolist())], dtype=bool)
                    row, column = row[new], column[new]
                found = [
                    asked.field("query_id").take(pa.array(row)),
                    pa.repeat(batch.column("dims")[i], len(row)),
                    pa.array(block[column]),
                    known.field("scope").take(pa.array(column)),
                    pa.array(bound[row, column]),
                    pa.array(n[column]),
                ]
                yield pa.RecordBatch.from_arrays(found, ["query_id", "dims", "block", "scope", "bound", "n"])

    kinds = T._parse_datatype_string("block long, bound double, n long")
    fields = [queries.schema["query_id"], queries.schema["dims"], kinds["block"], index.summaries.schema["scope"], kinds["bound"], kinds["n"]]
    schema = T.StructType(fields)
    return _met(queries, index.summaries, by).mapInArrow(chosen, schema)


def scored(
    queries: DataFrame,
    pairs: DataFrame,
    index: VectorIndex,
    k: int,
    queries_per_batch: int = QUERIES_PER_BATCH,
    by: Sequence[str] = BY_SCOPE,
) -> DataFrame:
    """(query_id, item_id, score): the k best items of each block for each query that reads it.

    The queries of a block come some batches in a row, and each such row meets the block's one row; the table of blocks is not shuffled.
    """
    reading = pairs.select("query_id", "scope", "dims", "block").join(queries.select("query_id", *by, "vector"), ["query_id", *by])
    fitting = F.floor(F.lit(QUERY_BYTES) / F.greatest(F.max("dims") * 8, F.lit(1)))
    per = F.greatest(F.lit(queries_per_batch), F.least(F.lit(queries_per_batch * BATCHES_PER_ROW), fitting))
    batches = (
        _in_parts(reading, "query_id", per, ("block",))
        .groupBy(F.col("block").alias("_block"), F.col("scope").alias("_scope"), F.col("dims").alias("_dims"), "part")
        .agg(F.collect_list(F.struct("query_id", "vector")).alias("asked"))
    )
    # only the block is a join key, since the table is bucketed by it; two blocks with one number would differ in the rest
    same = F.col("scope").eqNullSafe(F.col("_scope")) & (F.col("dims") == F.col("_dims"))
    met = index.blocks.join(batches, F.col("block") == F.col("_block")).select("members", "asked", same.alias("same"))

    def best(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for i in range(batch.num_rows):
                if not batch.column("same")[i].as_py():
                    continue
                members, asked = nested(batch.column("members"), i), nested(batch.column("asked"), i)
                ids = members.field("item_id")
                order = pc.sort_indices(ids)
                members, ids = members.take(order), ids.take(order)
                vectors = matrix_of(members.field("vector")).T
                for start in range(0, len(asked), queries_per_batch):
                    some = asked.slice(start, queries_per_batch)
                    with np.errstate(invalid="ignore", over="ignore"):
                        scores = matrix_of(some.field("vector")) @ vectors
                    ranked = np.where(np.isnan(scores), -np.inf, scores)
                    row, places = _first_places(ranked, k)
                    yield pa.RecordBatch.from_arrays(
                        [
                            some.field("query_id").take(pa.array(row)),
                            ids.take(pa.array(places)),
                            pa.array(scores[row, places]),
                        ],
                        ["query_id", "item_id", "score"],
                    )

    item_field = index.blocks.schema["members"].dataType.elementType["item_id"]
    return met.mapInArrow(best, T.StructType([queries.schema["query_id"], item_field, T.StructField("score", T.DoubleType())]))


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """Add ``rank`` and keep the first k per query; scores that are not numbers come last, ties go to the smaller id."""
    score = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(score.desc(), "item_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def search(
    queries: DataFrame, index: VectorIndex, k: int, queries_per_batch: int = QUERIES_PER_BATCH, everywhere: bool = False
) -> DataFrame:
    """(query_id, item_id, score, rank) of the k best items over the scopes that each query names: a row per (query_id, scope, vector).

    With ``everywhere`` the queries are rows (query_id, vector) that look at all scopes. The queries and what the first look finds (k
    rows a query) are stored, because they are read several times.
    """
    if k > index.deepest:
        raise ValueError(f"the index was built for searches up to {index.deepest}")
    by = ("dims",) if everywhere else BY_SCOPE
    sized = queries.where("vector IS NOT NULL").withColumn("dims", F.size("vector")).select("query_id", *by, "vector")
    asked = cut_lineage(_in_parts(_with_packed(sized), "query_id", queries_per_batch, by))
    open_ = asked.withColumns({"floor": F.lit(None).cast("double"), "seen": F.array().cast("array<long>")})
    order = W.partitionBy("query_id").orderBy(F.col("bound").desc(), "block")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = blocks_to_read(open_, index, k, True, by).withColumn("_before", before).where(F.col("_before") < k)
    looked = cut_lineage(first.drop("_before", "bound", "n"))
    found = cut_lineage(ranked(scored(asked, looked, index, k, queries_per_batch, by), k))
    floors = found.where(F.col("rank") == k).select(
        "query_id", F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score")).alias("floor")
    )
    seen = looked.groupBy("query_id").agg(F.collect_list("block").alias("seen"))
    bounded = asked.join(floors, "query_id", "left").join(seen, "query_id")
    rest = blocks_to_read(bounded, index, k, False, by)
    return ranked(found.drop("rank").unionByName(scored(asked, rest, index, k, queries_per_batch, by)), k)
