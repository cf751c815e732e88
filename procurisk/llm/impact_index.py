"""Exact top-k search by inner product over an impact-ordered index.

Items are dealt evenly into blocks of bounded size. The index of a block holds posting segments: for a level and a dimension, the items whose
component there rounds to that level (the quantised impact). A search adds segments in falling order of |level|, for all queries of
a batch at once. What a pair can still gain is at most |query| times the norm of the item's unread rest, which the index stores for
each level. Reading stops when that bound proves that no other item can enter the top k of its block; the items that may belong to
it, ties included, are then scored exactly. Blocks send k rows per query, and a last step merges them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Items of a block and queries of a batch, at most about so many; blocks of wide vectors hold fewer, so that these numbers fit.
BLOCK_ITEMS = 4096
QUERY_BATCH = 256
BLOCK_NUMBERS = 1 << 22
#: Batches that travel to a block in one row: the block's vectors go to Python once for all of them.
BATCHES_A_ROW = 16
#: Width of an impact level in units of the components, at least; a block of larger components has wider ones and MOST_LEVELS at most.
LEVEL_WIDTH = 8
MOST_LEVELS = 64
LARGEST = (1 << 63) - 1


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers that are held as floating point: in it while all sums fit, else as Python integers."""
    most = np.abs(vectors).max(initial=0.0) * np.abs(query).max(initial=0.0) * max(1, len(query))
    if most < 2.0**53:
        return (vectors @ query).astype(np.int64)
    wide = [int(x) for x in query]
    exact = [sum(int(a) * b for a, b in zip(row, wide)) for row in vectors]
    return np.array([max(-LARGEST, min(LARGEST, x)) for x in exact], dtype=np.int64)


def packed_numbers(vectors: np.ndarray) -> bytes:
    """Whole numbers that are held as floating point, in the fewest bytes that hold all of them."""
    most = np.abs(vectors).max(initial=0.0)
    return vectors.astype("<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8").tobytes()


def unpacked_numbers(packed: bytes, rows: int, dims: int) -> np.ndarray:
    """What ``packed_numbers`` made, as floating point."""
    kind = {2: "<i2", 4: "<i4"}.get(len(packed) // max(1, rows * dims), "<f8")
    return np.frombuffer(packed, dtype=kind).astype("<f8").reshape(rows, dims)


class ImpactIndex:
    """Posting segments of one block of vectors. ``rows`` are numbers of their own, so that items may share an id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((rows, ids))
        self.ids, self.rows, self.vectors = ids[order], rows[order], vectors[order]
        self.by_row = np.argsort(self.rows)
        n, dims = self.vectors.shape
        self.width = max(float(LEVEL_WIDTH), np.abs(self.vectors).max(initial=0.0) / MOST_LEVELS)
        levels = np.rint(self.vectors / self.width).astype(np.int64)
        size = np.abs(levels).ravel()
        # impacts fall; level 0 adds nothing and is not stored
        posting = np.argsort(-size, kind="stable")[: int((size > 0).sum())]
        self.items, self.dims = np.divmod(posting, max(1, dims))
        self.levels = levels.ravel()[posting]
        self.steps = np.unique(size[posting])[::-1].tolist()
        #: where the segments of each step end, after those of none
        self.ends = [0, *np.searchsorted(-size[posting], [-step for step in self.steps], side="right").tolist()]
        # norms of the unread rest before the first level and after each; too large ones are infinite and prove nothing
        rest = self.vectors.copy()
        with np.errstate(over="ignore"):
            self.rests = [np.sqrt((rest**2).sum(axis=1))]
            for step in self.steps:
                rest = rest - np.where(np.abs(levels) == step, levels * self.width, 0.0)
                self.rests.append(np.sqrt((rest**2).sum(axis=1)))

    def gained(self, start: int, end: int, weights: np.ndarray) -> np.ndarray:
        """A row per query: what the segments of the steps from ``start`` to ``end`` add to each item."""
        part = slice(self.ends[start], self.ends[end])
        read = np.zeros(self.vectors.shape)
        read[self.items[part], self.dims[part]] = self.levels[part]
        # what overflows is not a number, and is scored exactly
        with np.errstate(invalid="ignore", over="ignore"):
            return weights @ read.T

    def search(self, query_rows: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the query, item id and score of the top k of this block, ties to smaller ids."""
        none = (np.zeros(0, dtype=np.int64),) * 3
        if not len(self.ids) or not len(queries):
            return none
        with np.errstate(over="ignore"):
            norms = np.sqrt((queries**2).sum(axis=1))
            weights = queries * self.width
        total = np.zeros((len(queries), len(self.ids)))
        position = np.minimum(np.searchsorted(self.rows, query_rows, sorter=self.by_row), len(self.rows) - 1)
        own = self.by_row[position]
        own = np.where(self.rows[own] == query_rows, own, -1)
        open_queries = np.arange(len(queries))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        done = 0
        for depth in range(len(self.steps) + 1):
            last = depth == len(self.steps)
            # a look costs as much as a few levels: look when the rest is small, and at the end
            if not last and self.rests[depth].max(initial=0.0) > self.look_at():
                continue
            if depth:
                with np.errstate(invalid="ignore", over="ignore"):
                    total += self.gained(done, depth, weights)
                done = depth
            closed = []
            for place, query in enumerate(open_queries):
                # the last term covers the rounding of the sums
                with np.errstate(invalid="ignore", over="ignore"):
                    slack = norms[query] * (self.rests[depth] + 1e-9 * self.rests[0] * math.sqrt(weights.shape[1] + 1))
                    low, high = total[place] - slack, total[place] + slack
                unknown = ~(np.isfinite(low) & np.isfinite(high))
                low[unknown], high[unknown] = -np.inf, np.inf
                if own[query] >= 0:
                    low[own[query]] = high[own[query]] = -np.inf
                least = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
                members = np.flatnonzero((high >= least) & (high > -np.inf))
                if last or len(members) <= max(8 * k, len(self.ids) // 16):
                    exact = products(self.vectors[members], queries[query])
                    best = np.lexsort((members, -exact))[:k]
                    found.append((np.full(len(best), query), self.ids[members[best]], exact[best]))
                    closed.append(place)
            if closed:
                keep = np.setdiff1d(np.arange(len(open_queries)), closed)
                open_queries, total, weights = open_queries[keep], total[keep], weights[keep]
            if not len(open_queries):
                break
        return tuple(np.concatenate([x[i] for x in found]) for i in range(3)) if found else none  # type: ignore[return-value]

    def look_at(self) -> float:
        return 0.2 * float(np.median(self.rests[0])) if len(self.ids) else 0.0


def components(embeddings: DataFrame) -> DataFrame:
    """vec_id, row (a number of its own), v (the components floor(256 * x), whole numbers as doubles) and dims of the rows that take part.

    Rows with a null id, a null vector, or a null or non-finite component take no part. Rows that share an id are items of their own. A
    whole number of any size is exact as a double here, since 256 is a power of two; beyond the range of doubles the largest one stands.
    """
    value = F.col("embedding").cast("array<double>")
    numbered = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("x"), F.monotonically_increasing_id().alias("row"))
    whole = numbered.where("vec_id IS NOT NULL AND x IS NOT NULL AND forall(x, c -> c IS NOT NULL AND abs(c) < double('Infinity'))")
    # from 2**45 on a double times 256 is whole already, and floor to a long would overflow
    most = 1.7976931348623157e308

    def scaled(c: Column) -> Column:
        wide = F.greatest(F.lit(-most), F.least(F.lit(most), c * 256))
        return F.when(F.abs(c) < 2.0**45, F.floor(c * 256).cast("double")).otherwise(wide)

    return whole.select("vec_id", "row", F.transform("x", scaled).alias("v"), F.size("x").alias("dims"))


def top_k(embeddings: DataFrame, is_query: str, k: int) -> DataFrame:
    """query_id, rank, vec_id and score of the k best other items of each row where the SQL condition ``is_query`` (on vec_id) holds.

    Only vectors of equal length meet. Fewer than k others give fewer rows, none gives none; a query of a repeated id gives its rows for each
    of its vectors. A score beyond a long is given as the largest or least one and ranks as such. Items are dealt to blocks by a hash of
    their number, queries go to all blocks of their length, some batches in a row; a task holds one block and one such row at a time.
    """
    rows = components(embeddings)
    n_items, n_queries = embeddings.count(), embeddings.where(is_query).count()

    def shares(number: int, most: int) -> Column:
        # wider vectors lie in more blocks, and travel in more rows
        share = F.greatest(F.lit(1.0), F.col("dims") * (most / BLOCK_NUMBERS))
        return F.greatest(F.lit(1), F.ceil(share * number / most)).cast("int")

    blocks = shares(n_items, BLOCK_ITEMS)
    shape = "dims int, block int, ids binary, rows binary, vectors binary"

    def packed(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ids, numbers = (group[c].to_numpy(dtype="<i8") for c in ("vec_id", "row"))
        vectors = np.array(group["v"].tolist(), dtype="<f8").reshape(len(ids), key[0])
        return pd.DataFrame(
            {"dims": [key[0]], "block": [key[1]], "ids": [ids.tobytes()], "rows": [numbers.tobytes()], "vectors": [packed_numbers(vectors)]}
        )

    def in_blocks(part: DataFrame, number: Column) -> DataFrame:
        dealt = part.withColumn("block", F.pmod(F.xxhash64("row"), number).cast("int"))
        return dealt.groupBy("dims", "block").applyInPandas(packed, shape)

    items = in_blocks(rows, blocks)
    queries = in_blocks(rows.where(is_query), shares(n_queries, QUERY_BATCH * BATCHES_A_ROW)).select(
        "dims",
        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"),
        F.col("ids").alias("query_ids"),
        F.col("rows").alias("query_rows"),
        F.col("vectors").alias("queries"),
    )
    columns = ("dims", "ids", "rows", "vectors", "query_ids", "query_rows", "queries")

    def search(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, index = None, None
        for frame in stream:
            for dims, ids, numbers, vectors, query_ids, query_rows, asked in zip(*(frame[c] for c in columns)):
                if held != (dims, numbers):
                    own = np.frombuffer(ids, dtype="<i8")
                    index = ImpactIndex(own, np.frombuffer(numbers, dtype="<i8"), unpacked_numbers(vectors, len(own), dims))
                    held = (dims, numbers)
                names, places = np.frombuffer(query_ids, dtype="<i8"), np.frombuffer(query_rows, dtype="<i8")
                wanted = unpacked_numbers(asked, len(names), dims)
                for start in range(0, len(names), QUERY_BATCH):
                    batch = slice(start, start + QUERY_BATCH)
                    row, vec_id, score = index.search(places[batch], wanted[batch], k)
                    yield pd.DataFrame({"query_row": places[batch][row], "query_id": names[batch][row], "vec_id": vec_id, "score": score})

    # by size the queries look small enough to be broadcast: their copies, one for each block, are made after Spark's estimate, and they
    # would all pass through the driver. They are the side that streams: a task keeps one block for them
    pairs = queries.hint("merge").join(items, ["dims", "block"]).select(*columns)
    best = pairs.mapInPandas(search, "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
