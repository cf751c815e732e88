"""Counts of hashed words, worked out for whole batches of texts: a word is hashed once a batch, not each time it occurs."""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column
from pyspark.sql import functions as F

# the functions below travel to the workers by value, so the workers do not need the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: Lists of words that are counted in one step.
LISTS_AT_ONCE = 2048


def place(word: str, width: int) -> int:
    """The first 28 bits of a word's MD5 digest, modulo ``width``."""
    return int(hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()[:7], 16) % width


def counted(words: pa.Array, width: int) -> pa.StructArray:
    """For each list of words the sparse vector of the counts of its places."""
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    places = np.array([place(word, width) for word in coded.dictionary.to_pylist()], dtype=np.int64)
    rows = np.repeat(np.arange(len(words)), lengths)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    keys, counts = np.unique(rows * width + places[codes] if len(codes) else rows, return_counts=True)
    ends = pa.array(np.searchsorted(keys, np.arange(len(words) + 1) * width), pa.int32())
    return pa.StructArray.from_arrays(
        [
            pa.array(np.zeros(len(words)), pa.int8()),  # the mark of a sparse vector
            pa.array(np.full(len(words), width), pa.int32()),
            pa.ListArray.from_arrays(ends, pa.array(keys % width, pa.int32())),
            pa.ListArray.from_arrays(ends, pa.array(counts, pa.float64())),
        ],
        ["type", "size", "indices", "values"],
    )


def word_counts(words: Column, width: int) -> Column:
    """A vector column: how often each place occurs among the words."""

    def run(lists: pa.Array) -> pa.Array:
        parts = [counted(lists.slice(at, LISTS_AT_ONCE), width) for at in range(0, len(lists), LISTS_AT_ONCE)]
        return pa.concat_arrays(parts) if parts else counted(lists, width)

    return F.arrow_udf(run, VectorUDT())(words)
