"""Helpers for functions that see a table as Arrow batches: bounded pieces of text, words, sums over rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step takes at a time (a single longer text is taken alone).
PIECE_BYTES = 4 << 20


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose ``column`` holds about ``limit`` bytes each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cells = np.cumsum(sizes.astype(np.int64)) // limit
    cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:]):
        if end > start:
            yield batch.slice(start, end - start)
    pa.default_memory_pool().release_unused()


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    return pc.fill_null(batch.column(column), "")


def flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """All items of a list column, and the number of items per row."""
    return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of all rows in order, and the number of words per row."""
    items, counts = flat(pc.ascii_split_whitespace(column))
    present = pc.not_equal(items, "")
    return items.filter(present), per_row(present.to_numpy(zero_copy_only=False), counts)


def bounds(counts: np.ndarray) -> np.ndarray:
    """Where each row's items start, and at the end their number."""
    return np.concatenate([[0], np.cumsum(counts)])


def per_row(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the values of each row; rows without items have 0."""
    sums = np.concatenate([[0], np.cumsum(values)])
    edges = bounds(counts)
    return sums[edges[1:]] - sums[edges[:-1]]


def codes(items: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each item, and the distinct items by number."""
    coded = items.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
