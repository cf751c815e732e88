"""Product codes of vectors, exact in integers, with LAESA pivots that order and prune the comparisons.

Components become integers, vectors are cut into parts, and each part position has a codebook that starts as the parts of the
first vectors and is moved a few times to the floored means of the parts assigned to its entries. The distances of every part to
a few fixed pivots are worked out once and stored. In each round the distances between pivots and entries give, by the triangle
inequality, a lower bound for every part and entry; a part looks at the entries in rising order of that bound, compares exactly,
and stops when the bound passes its best distance. Ties go to the lower index, so a bound equal to the best is still looked at.

Vectors that are null or hold null or non-finite components take no part. Shorter vectors, and vectors whose length is no
multiple of the number of parts, are filled with zeros at the end up to the longest one's. Rows with a null vec_id are coded but
come last where the first vectors are chosen; equal ids are ordered by their vectors. Components of any finite size are exact: large ones
are compared as Python integers; an error beyond a long is given as the largest long. Other columns are ignored. No vector, no row.

The driver holds the codebooks only (entries x width numbers, fixed by the parameters). Each round is one pass over the stored
table, whose sums are combined per task before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurisk.llm import shared
from procurisk.operators.skew import join_salted

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Fixed pivots of each part position.
PIVOTS = 4
#: Rows that are compared at a time.
ROWS = 8192
#: Integers below this are compared in machine words, larger ones as Python integers.
WORD = 1 << 24
#: Pivot distances are stored in single precision; bounds give way by this share.
SLACK = 1e-6
LARGEST = (1 << 63) - 1


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(256 * x) of every component, a row per vector, filled with zeros; of type object if large ones are among them."""
    counts = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if values.size and np.abs(values).max() >= WORD // 256:
        whole = np.array([floor(Fraction(x) * 256) for x in values.tolist()], dtype=object)
    else:
        whole = np.floor(values * 256).astype(np.int64)
    if len(counts) and (counts == width).all():
        return whole.reshape(len(counts), width)
    out = np.zeros((len(counts), width), dtype=whole.dtype)
    rows = np.repeat(np.arange(len(counts)), counts)
    starts = np.repeat(np.cumsum(counts) - counts, counts)
    out[rows, np.arange(len(values)) - starts] = whole
    return out


def fitted(values: list) -> np.ndarray:
    """An array of integers in machine words if all are small, of Python integers otherwise."""
    whole = np.array(values, dtype=object)
    return whole.astype(np.int64) if all(abs(x) < WORD for x in whole.ravel().tolist()) else whole


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances over the last axis."""
    if a.dtype != b.dtype or a.shape[-1] > 1 << 12:
        a, b = a.astype(object), b.astype(object)
    difference = a - b
    return (difference * difference).sum(axis=-1)


def real(values: np.ndarray) -> np.ndarray:
    """In floating point; what is too large is infinite, and an infinite distance bounds nothing."""
    if values.dtype != object:
        return values.astype(np.float64)
    flat = [float(x) if abs(x) < 1 << 1000 else np.inf for x in values.ravel().tolist()]
    return np.array(flat, dtype=np.float64).reshape(values.shape)


def roots(values: np.ndarray) -> np.ndarray:
    return np.sqrt(real(values))


def nearest(part: np.ndarray, entries: np.ndarray, to_pivots: np.ndarray, pivot_entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of the nearest entry of every part, and how many distances were worked out.

    ``to_pivots`` has a row per part and a column per pivot, ``pivot_entries`` a row per pivot and a column per entry.
    """
    bound = np.zeros((len(part), len(entries)))
    for p in range(len(pivot_entries)):
        own, other = to_pivots[:, p, None].astype(np.float64), pivot_entries[p]
        with np.errstate(invalid="ignore"):
            apart = np.abs(own - other) - SLACK * (own + other)
        bound = np.fmax(bound, np.where(np.isfinite(apart), apart, 0.0))
    order = np.argsort(bound, axis=1, kind="stable")
    open_rows = np.arange(len(part))
    code = order[:, 0].copy() if len(part) else np.zeros(0, dtype=np.int64)
    best = squares(part, entries[code]) if len(part) else np.zeros(0, dtype=np.int64)
    evaluated = len(part)
    for turn in range(1, len(entries)):
        candidate = order[open_rows, turn]
        near = bound[open_rows, candidate] ** 2 <= real(best[open_rows])
        open_rows, candidate = open_rows[near], candidate[near]
        if not len(open_rows):
            break
        distance = squares(part[open_rows], entries[candidate])
        evaluated += len(open_rows)
        held = best[open_rows]
        better = ((distance < held) | ((distance == held) & (candidate < code[open_rows]))).astype(bool)
        best[open_rows[better]], code[open_rows[better]] = distance[better], candidate[better]
    return code, best, evaluated


@dataclass
class Codebooks:
    """``entries`` and ``pivots``: integers by part position, index, place within the part. ``width``: that of the filled vectors."""

    entries: list
    pivots: list
    width: int

    def sha256(self) -> str:
        """Digest of all entries' decimal components by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(x) for book in self.entries for entry in book for x in entry).encode()).hexdigest()

    def assigned(self, vectors: pa.Array, to_pivots: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Part position, parts, codes and squared distances, position by position."""
        whole = integers(vectors, self.width)
        distances = to_pivots.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), len(self.entries), -1)
        for position, part in enumerate(np.split(whole, len(self.entries), axis=1)):
            entries, pivots = fitted(self.entries[position]), fitted(self.pivots[position])
            between = roots(squares(pivots[:, None, :], entries[None, :, :]))
            code, best, _ = nearest(part, entries, distances[:, position], between)
            yield position, part, code, best


def fixed_pivots(book: list, pivots: int) -> list:
    """Entries far from each other: the first one, then each time the one farthest from those chosen, ties to the lower index."""
    entries = fitted(book)
    chosen = [0]
    nearest_chosen = squares(entries, entries[0])
    while len(chosen) < min(pivots, len(book)):
        chosen.append(int(np.argmax(nearest_chosen)))
        nearest_chosen = np.minimum(nearest_chosen, squares(entries, entries[chosen[-1]]))
    return [book[i] for i in chosen]


def kept(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and embedding of the rows that take part."""
    value = F.col("embedding")
    if embeddings.schema["embedding"].dataType != T.ArrayType(T.FloatType()):
        value = value.cast("array<double>")
    whole = embeddings.select("vec_id", "label", value.alias("embedding"))
    return whole.where("embedding IS NOT NULL AND forall(embedding, c -> c IS NOT NULL AND abs(c) < double('Infinity'))")


def first_codebooks(vectors: DataFrame, parts: int, entries: int, pivots: int) -> Codebooks | None:
    """The parts of the first vectors by vec_id; None if there is no vector."""
    longest = vectors.agg(F.max(F.size("embedding"))).first()[0]
    if longest is None:
        return None
    width = -(-longest // parts) * parts
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    whole = integers(pa.array([row[0] for row in first], pa.list_(pa.float64())), width)
    books = [part.tolist() for part in np.split(whole, parts, axis=1)]
    return Codebooks(books, [fixed_pivots(book, pivots) for book in books], width)


def with_pivot_distances(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """The vectors with the distance of each part to each pivot of its position, in a flat list."""

    def measured(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = [fitted(position) for position in books.pivots]
        for batch in stream:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                parts = np.split(integers(rows.column("embedding"), books.width), len(pivots), axis=1)
                with np.errstate(over="ignore"):
                    apart = [
                        roots(squares(part[:, None, :], p[None, :, :])).astype(np.float32) for part, p in zip(parts, pivots)
                    ]
                flat = np.concatenate(apart, axis=1)
                offsets = np.arange(rows.num_rows + 1, dtype=np.int32) * flat.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([*rows.columns, lists], [*rows.schema.names, "to_pivots"])

    schema = T.StructType([*vectors.schema.fields, T.StructField("to_pivots", T.ArrayType(T.FloatType()))])
    return vectors.mapInArrow(measured, schema)


def moved(measured: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry at the floored mean of the parts assigned to it; entries without parts stay.

    A task sends one row for each entry's component. Sums are cut into 32-bit places, which a long can add up.
    """

    def sums(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = books.width // len(books.entries)
        totals = [np.zeros((len(book), wide), dtype=object) for book in books.entries]
        counts = [np.zeros(len(book), dtype=np.int64) for book in books.entries]
        for batch in stream:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                for position, part, code, _ in books.assigned(rows.column("embedding"), rows.column("to_pivots")):
                    some = np.zeros((len(counts[position]), wide), dtype=part.dtype)
                    np.add.at(some, code, part)
                    totals[position] = totals[position] + some.astype(object)
                    counts[position] += np.bincount(code, minlength=len(counts[position]))
        found = []
        for position, (total, count) in enumerate(zip(totals, counts)):
            for entry in np.flatnonzero(count).tolist():
                found.append((position, entry, -1, 0, int(count[entry])))
                for place, value in enumerate(total[entry].tolist()):
                    digit = 0
                    while not -(1 << 40) < value < 1 << 40:
                        found.append((position, entry, place, digit, value & 0xFFFFFFFF))
                        value, digit = value >> 32, digit + 1
                    found.append((position, entry, place, digit, value))
        columns = list(zip(*found)) or [()] * 5
        arrays = [pa.array(c, pa.int32()) for c in columns[:4]] + [pa.array(columns[4], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["position", "entry", "place", "digit", "total"])

    added = (
        measured.select("embedding", "to_pivots")
        .mapInArrow(sums, "position int, entry int, place int, digit int, total long")
        .groupBy("position", "entry", "place", "digit")
        .agg(F.sum("total").alias("total"))
    )
    whole: dict = {}
    for position, entry, place, digit, total in added.collect():  # at most entries x width places
        whole[position, entry, place] = whole.get((position, entry, place), 0) + (total << 32 * digit)
    entries = [
        [
            [whole[p, e, i] // whole[p, e, -1] for i in range(len(old))] if (p, e, -1) in whole else old
            for e, old in enumerate(book)
        ]
        for p, book in enumerate(books.entries)
    ]
    return Codebooks(entries, books.pivots, books.width)


def coded(measured: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of every vector."""

    def codes(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                error = np.zeros(rows.num_rows, dtype=object)
                code = np.zeros((rows.num_rows, len(books.entries)), dtype=np.uint8)
                for position, _, some, best in books.assigned(rows.column("embedding"), rows.column("to_pivots")):
                    code[:, position] = some
                    error = error + best.astype(object)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("vec_id"),
                        rows.column("label"),
                        pa.array([row.tobytes().hex() for row in code], pa.string()),
                        pa.array([min(int(x), LARGEST) for x in error], pa.int64()),
                    ],
                    ["vec_id", "label", "code", "error"],
                )

    fields = [measured.schema["vec_id"], measured.schema["label"]]
    schema = T.StructType([*fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return measured.mapInArrow(codes, schema)


def with_label_errors(codes: DataFrame) -> DataFrame:
    """The codes with the error summed over equal labels, null ones together. Labels are summed before they meet their rows."""
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    totals = codes.groupBy("label").agg(F.least(total, F.lit(LARGEST)).cast("long").alias("label_error"), F.count("*").alias("n"))
    return join_salted(codes, totals.drop("n"), ["label"], sizes=totals.select("label", "n"))


def encode(
    embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS
) -> tuple[DataFrame, Codebooks | None]:
    """A row (vec_id, label, code, error, label_error) for every vector that takes part, and the last codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part, so there are 1 to 256 entries")
    vectors = kept(embeddings)
    books = first_codebooks(vectors, parts, entries, pivots)
    if books is None:
        none = vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return none.withColumn("label_error", F.lit(0).cast("long")), None
    measured = shared.stored(with_pivot_distances(vectors, books), "pivot-distances")
    for _ in range(rounds):
        books = moved(measured, books)
    return with_label_errors(shared.stored(coded(measured, books), "vector-codes")), books
