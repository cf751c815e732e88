"""Quality rules: how much of a text repeats itself, from a suffix array over its words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from procurisk.llm import batches

#: A text is failed by the base when it has fewer words, or a larger share of words in repeated 3-word windows (per cent).
LEAST_WORDS = 50
WINDOW_WORDS = 3
MOST_WINDOW_PERCENT = 50
#: The method: repeats of at least so many words count; the share of words they may cover (per cent); the longest repeat.
REPEAT_WORDS = 16
MOST_COVERED_PERCENT = 20
LONGEST_REPEAT_WORDS = 200

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered_words long, "
    "longest_repeat_words long, base_failed boolean, kept boolean, repeats array<struct<first_word: long, end_word: long>>"
)


def repeat_lengths(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each word position, the length of the longest word sequence from there that occurs again in the same text.

    A suffix array of all texts at once, by prefix doubling: ``levels[l]`` ranks the positions by their first 2**l words.
    Ranks hold the text's number, so that no sequence crosses texts; positions whose rank is already their own drop out.
    Neighbours in the final order meet at their longest common prefix, read off the levels from the largest down.
    """
    n = len(codes)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    ends = np.repeat(np.cumsum(counts), counts)
    text = np.repeat(np.arange(len(counts)), counts)
    key = text * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    rank, left = _ranks(key[order], order, n)
    levels = [rank]
    width = 1
    while left.size:
        ahead = left + width
        following = np.where(ahead < ends[left], rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[left] * (n + 1) + following
        by_key = np.argsort(key, kind="stable")
        positions, key = left[by_key], key[by_key]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        parent = key // (n + 1)
        new_parent = np.concatenate([[True], parent[1:] != parent[:-1]])
        index = np.arange(len(key))
        first_of_group = np.maximum.accumulate(np.where(fresh, index, 0))
        first_of_parent = np.maximum.accumulate(np.where(new_parent, index, 0))
        rank = rank.copy()
        rank[positions] = parent + first_of_group - first_of_parent
        alone = fresh & np.concatenate([fresh[1:], [True]])
        left = positions[~alone]
        levels.append(rank)
        width *= 2
    suffixes = np.empty(n, dtype=np.int64)
    suffixes[rank] = np.arange(n)
    one, two = suffixes[:-1].copy(), suffixes[1:].copy()
    common = np.zeros(n - 1, dtype=np.int64)
    open_pairs = np.arange(n - 1)
    for level in range(len(levels) - 1, -1, -1):
        a, b = one[open_pairs], two[open_pairs]
        inside = (a < n) & (b < n)
        ranks = levels[level]
        same = inside & (ranks[np.minimum(a, n - 1)] == ranks[np.minimum(b, n - 1)])
        # a rank of its own text: positions past a text's end belong to the next text and never match
        same &= ends[np.minimum(a, n - 1)] == ends[np.minimum(b, n - 1)]
        hit = open_pairs[same]
        common[hit] += 1 << level
        one[hit] += 1 << level
        two[hit] += 1 << level
    longest = np.zeros(n, dtype=np.int64)
    longest[suffixes[1:]] = common
    longest[suffixes[:-1]] = np.maximum(longest[suffixes[:-1]], common)
    return longest


def _ranks(sorted_key: np.ndarray, order: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each position (first place of its group), and the positions that share their rank."""
    fresh = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    alone = fresh & np.concatenate([fresh[1:], [True]])
    return rank, order[~alone]


def covered(lengths: np.ndarray, least: int, width: int | None = None) -> np.ndarray:
    """Which words lie in a repeat of at least ``least`` words (or in one of its windows of ``width``)."""
    starts = np.flatnonzero(lengths >= least)
    steps = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + (lengths[starts] if width is None else width), -1)
    return np.cumsum(steps[:-1]) > 0


def repeated_lines(column: pa.Array) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line of it."""
    lines, counts = batches.flat(pc.split_pattern(column, "\n"))
    row = np.repeat(np.arange(len(counts)), counts)
    some = pc.not_equal(pc.ascii_trim_whitespace(lines), "").to_numpy(zero_copy_only=False)
    code, distinct = batches.codes(lines.filter(pa.array(some)))
    row = row[some]
    key = row * (len(distinct) + 1) + code
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), dtype=bool)
    again[first] = False
    return np.bincount(row[again], minlength=len(counts)).astype(np.int64)


def measure(column: pa.Array) -> dict[str, pa.Array]:
    """The columns of ``MEASURES`` for some whole texts."""
    items, counts = batches.words(column)
    code, _ = batches.codes(items)
    lengths = repeat_lengths(code, counts)
    in_window = covered(lengths, WINDOW_WORDS, WINDOW_WORDS)
    in_repeat = covered(lengths, REPEAT_WORDS)
    n_repeat, n_covered = batches.per_row(in_window, counts), batches.per_row(in_repeat, counts)
    edges = batches.bounds(counts)
    longest = np.zeros(len(counts), dtype=np.int64)
    filled = np.flatnonzero(counts)
    if filled.size:
        longest[filled] = np.maximum.reduceat(lengths, edges[filled])
    base_failed = (counts < LEAST_WORDS) | (100 * n_repeat > MOST_WINDOW_PERCENT * counts)
    kept = ~base_failed & (100 * n_covered <= MOST_COVERED_PERCENT * counts) & (longest <= LONGEST_REPEAT_WORDS)
    # spans: where the cover begins and ends, never across texts
    text = np.repeat(np.arange(len(counts)), counts)
    change = np.concatenate([[True], text[1:] != text[:-1]]) if len(text) else np.zeros(0, dtype=bool)
    starts = np.flatnonzero(in_repeat & (change | ~np.concatenate([[False], in_repeat[:-1]])))
    last = np.concatenate([change[1:], [True]]) if len(text) else change
    ends = np.flatnonzero(in_repeat & (last | ~np.concatenate([in_repeat[1:], [False]]))) + 1
    spans = pa.StructArray.from_arrays(
        [pa.array(starts - edges[text[starts]]), pa.array(ends - edges[text[starts]])], names=["first_word", "end_word"]
    )
    per_text = batches.bounds(np.bincount(text[starts], minlength=len(counts)))
    return {
        "n_words": pa.array(counts),
        "word_chars": pa.array(
            batches.per_row(pc.utf8_length(items).to_numpy(zero_copy_only=False).astype(np.int64), counts)
        ),
        "n_symbols": pc.count_substring_regex(column, "[#*$%&|<>]").cast(pa.int64()),
        "n_dup_lines": pa.array(repeated_lines(column)),
        "n_repeat_words": pa.array(n_repeat),
        "n_covered_words": pa.array(n_covered),
        "longest_repeat_words": pa.array(longest),
        "base_failed": pa.array(base_failed),
        "kept": pa.array(kept),
        "repeats": pa.ListArray.from_arrays(pa.array(per_text.astype(np.int32)), spans),
    }


def quality_rules(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per text with the measures of ``MEASURES``; ``repeats`` are the merged spans of its repeats, in words.

    Null text: no words, hence ``base_failed``. A null id stays null. Repeated rows give repeated results, an empty table
    none. Occurrences may overlap ("a a a" repeats "a a"). No shuffle; a task holds about ``PIECE_BYTES`` of text
    at a time, or one longer text.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for piece in batches.pieces(batch, "text"):
                found = measure(batches.texts(piece))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *found.values()], names=["doc_id", *found])

    kind = docs.schema[id_column].dataType.simpleString()
    slim = docs.select(docs[id_column].alias("doc_id"), docs[text].cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, {MEASURES}")


def passing(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all columns; null and empty texts are not. No shuffle."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for piece in batches.pieces(batch, text):
                yield piece.filter(measure(batches.texts(piece, text))["kept"])

    return docs.mapInArrow(run, docs.schema)
