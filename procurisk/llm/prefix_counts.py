"""Token counts: the exact number of tokens of every prefix of a text, under a sentencepiece BPE model.

Pieces of the model hold white space only at their start. So a text falls into chunks (a run of blanks and the word after
it) that are encoded independently: the count of a prefix is the count of the chunks before it plus that of the part of
the chunk that it cuts. Chunks repeat, hence each distinct one is encoded once per task. Inside a chunk a dynamic program
finds the count of all prefixes: the encoding of a prefix ends in exactly one piece that is compatible with the piece
before it, so one step per position is enough. The counts at every prefix can be stored, and then answer any question by a look-up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procurisk.llm import batches

#: Distinct chunks that a task remembers before it starts anew, by number and by characters (in scripts without blanks a chunk is
#: as long as a paragraph), and pairs of pieces.
REMEMBERED = 400_000
REMEMBERED_CHARS = 16 << 20
REMEMBERED_PAIRS = 1_000_000
BLANKS = " ▁"
#: The first blank of a run after a word; what follows it is a chunk, its other blanks included.
CHUNK_END = re.compile(f"(?<=[^{BLANKS}])[{BLANKS}]")
IRREGULAR = f"^[{BLANKS}]|[{BLANKS}]$|[{BLANKS}][{BLANKS}]|▁"


class ChunkCounter:
    """Counts the tokens of chunks, and of all prefixes of one chunk."""

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.known: dict[str, int] = {}
        self.known_chars = 0
        self.pairs: dict[tuple[str, str], bool] = {}
        self.vocabulary: set[str] | None = None

    def counts(self, chunks: Sequence[str]) -> np.ndarray:
        """Tokens of each chunk, given without its first blank."""
        if len(self.known) > REMEMBERED or self.known_chars > REMEMBERED_CHARS:
            self.known.clear()
            self.known_chars = 0
        new = [chunk for chunk in chunks if chunk not in self.known]
        if new:
            self.known.update(zip(new, map(len, self.model.encode(new, num_threads=1))))
            self.known_chars += sum(map(len, new))
        return np.fromiter((self.known[chunk] for chunk in chunks), dtype=np.int64, count=len(chunks))

    def pieces(self, text: str) -> list[str]:
        """The pieces of ``text`` without the blank that the model puts before a text."""
        return self.model.encode("\n" + text, out_type=str)[2:]

    def fits(self, before: str, piece: str) -> bool:
        pair = (before, piece)
        if len(self.pairs) > REMEMBERED_PAIRS:
            self.pairs.clear()
        if pair not in self.pairs:
            self.pairs[pair] = self.pieces(before + piece) == ([before, piece] if before else [piece])
        return self.pairs[pair]

    def prefix_counts(self, chunk: str) -> list[int]:
        """Tokens of ``chunk[:i]`` behind its first blank, for i from 0 to its length."""
        if self.vocabulary is None:
            ids = range(self.model.get_piece_size())
            odd = (self.model.is_control, self.model.is_unknown, self.model.is_byte)
            self.vocabulary = {self.model.id_to_piece(i) for i in ids if not any(kind(i) for kind in odd)}
            self.longest = max(map(len, self.vocabulary))
        text = "▁" + chunk.replace(" ", "▁")
        counts, last = [0], [""]
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - self.longest), end):
                piece = text[start:end]
                # a character outside the vocabulary becomes its bytes and separates what stands around it
                before = last[start]
                if piece in self.vocabulary and self.fits("", piece) and (not before or self.fits(before, piece)):
                    counts.append(counts[start] + 1)
                    last.append(piece)
                    break
            else:
                counts.append(counts[end - 1] + len(text[end - 1].encode()))
                last.append("")
        return counts[1:]


def chunked(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts without their first blank, and their number per text (an empty text has one, empty)."""
    odd = pc.match_substring_regex(column, IRREGULAR).to_numpy(zero_copy_only=False)
    if not odd.any():
        return batches.flat(pc.split_pattern(column, " "))
    lists = pc.split_pattern(column, " ").to_pylist()
    for row in np.flatnonzero(odd):
        lists[row] = CHUNK_END.split(column[int(row)].as_py())
    return batches.flat(pa.array(lists, type=pa.list_(pa.string())))


def prefix_table(column: pa.Array, counter: ChunkCounter) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks, their number per text, the tokens of each text up to each chunk's end, and the characters up to there."""
    chunks, counts = chunked(column)
    code, distinct = batches.codes(chunks)
    tokens = counter.counts(distinct.to_pylist())[code]
    first = batches.bounds(counts)[:-1]
    empty = pc.equal(chunks, "").to_numpy(zero_copy_only=False)
    tokens[empty] = 1  # a blank at the end of a text
    tokens[first[empty[first]]] = 0  # an empty text
    chars = pc.utf8_length(chunks).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    return chunks, counts, _running(tokens, counts), _running(chars, counts) - 1


def _running(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums from the start of each row."""
    sums = np.cumsum(values)
    before = np.concatenate([[0], sums])[batches.bounds(counts)[:-1]]
    return sums - np.repeat(before, counts)


def tokens_of_prefix(counter: ChunkCounter, text: str, n_chars: int) -> int:
    """Tokens of ``text[:n_chars]``, from the table of the whole text."""
    chunks, _, tokens, ends = prefix_table(pa.array([text]), counter)
    if n_chars <= 0:
        return 0
    at = int(np.searchsorted(ends, n_chars))
    if at >= len(ends):
        return int(tokens[-1])
    begin = int(ends[at - 1]) + 1 if at else 0
    done = int(tokens[at - 1]) if at else 0
    if n_chars < begin:
        return done
    return done + counter.prefix_counts(chunks[at].as_py())[n_chars - begin]


def longest_within(counter: ChunkCounter, chunks: pa.Array, tokens: np.ndarray, ends: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix with at most ``budget`` tokens, of a text given by its table."""
    at = int(np.searchsorted(tokens, budget, side="right"))
    if at >= len(tokens):
        return int(ends[-1])
    done = int(tokens[at - 1]) if at else 0
    inside = counter.prefix_counts(chunks[at].as_py())
    begin = int(ends[at - 1]) + 1 if at else 0
    fitting = [i for i, count in enumerate(inside) if done + count <= budget]
    if at and not fitting:
        return int(ends[at - 1])
    return begin + (fitting[-1] if fitting else 0)


def prefixes(docs: DataFrame, model: bytes, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id and ``prefix_tokens``: the tokens of the text's first n characters at place n, for every n from 0 to its length.

    Stored, this table answers all questions on truncation and budgets (:func:`tokens_of` and :func:`longest_prefix`) by look-ups in
    DataFrame expressions; nothing is encoded any more. Each distinct chunk of a piece of text goes through the dynamic program once. Null
    text counts as empty; null ids and repeated rows stay.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = ChunkCounter(model)
        for batch in stream:
            for piece in batches.pieces(batch, "text", 1 << 20):
                chunks, counts, tokens, _ = prefix_table(batches.texts(piece), counter)
                code, distinct = batches.codes(chunks)
                inside = [np.array(counter.prefix_counts(chunk), dtype=np.int64) for chunk in distinct.to_pylist()]
                first = batches.bounds(counts)[:-1]
                done = np.concatenate([[0], tokens[:-1]])
                done[first] = 0
                parts = [inside[c] + d for c, d in zip(code.tolist(), done.tolist())]
                lengths = np.array([len(part) for part in parts], dtype=np.int64)
                flat = np.concatenate(parts)
                edges = batches.bounds(lengths)[batches.bounds(counts)]
                flat[edges[:-1]] = 0  # no character, no token
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), lists], names=["doc_id", "prefix_tokens"])

    kind = docs.schema[id_column].dataType.simpleString()
    slim = docs.select(docs[id_column].alias("doc_id"), docs[text].cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, prefix_tokens array<int>")


def tokens_of(n_chars: Column | int) -> Column:
    """Tokens of the first ``n_chars`` characters, of a row of :func:`prefixes`; all of them where the text is shorter."""
    place = F.least(F.greatest(F.lit(n_chars) if isinstance(n_chars, int) else n_chars, F.lit(0)), F.size("prefix_tokens") - 1)
    return F.get("prefix_tokens", place)


def longest_prefix(budget: Column | int) -> Column:
    """Characters of the longest prefix with at most ``budget`` tokens, of a row of :func:`prefixes`. Counts may fall from one prefix to the next."""
    limit = F.lit(budget) if isinstance(budget, int) else budget
    return F.array_max(F.transform("prefix_tokens", lambda n, at: F.when(n <= limit, at)))


def count_tokens(
    docs: DataFrame, model: bytes, budget: int, text: str = "text", id_column: str = "doc_id", tables: bool = False
) -> DataFrame:
    """Per text: bytes, tokens, whether they exceed ``budget``, and the characters of the longest prefix within it.

    With ``tables``, also the table itself: ``chunk_tokens`` and ``chunk_chars``, tokens and characters up to the end of
    each chunk, from which :func:`longest_within` answers any other budget without the text being encoded again.

    Null text counts as empty (0 tokens). A null id stays null; repeated rows give repeated results. No shuffle; a task
    holds about 4 MB of text, or one longer text, and ``REMEMBERED`` chunks.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = ChunkCounter(model)
        for batch in stream:
            for piece in batches.pieces(batch, "text"):
                column = batches.texts(piece)
                chunks, counts, tokens, ends = prefix_table(column, counter)
                edges = batches.bounds(counts)
                total, fit = tokens[edges[1:] - 1], ends[edges[1:] - 1].copy()
                for row in np.flatnonzero(total > budget):
                    a, b = edges[row], edges[row + 1]
                    fit[row] = longest_within(counter, chunks[a:b], tokens[a:b], ends[a:b], budget)
                columns = {
                    "doc_id": piece.column("doc_id"),
                    "n_bytes": pc.binary_length(column).cast(pa.int64()),
                    "n_tokens": pa.array(total),
                    "over_limit": pa.array(total > budget),
                    "fit_chars": pa.array(fit),
                }
                if tables:
                    offsets = pa.array(edges.astype(np.int32))
                    columns["chunk_tokens"] = pa.ListArray.from_arrays(offsets, pa.array(tokens))
                    columns["chunk_chars"] = pa.ListArray.from_arrays(offsets, pa.array(ends))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = docs.schema[id_column].dataType.simpleString()
    slim = docs.select(docs[id_column].alias("doc_id"), docs[text].cast("string").alias("text"))
    more = ", chunk_tokens array<long>, chunk_chars array<long>" if tables else ""
    schema = f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long{more}"
    return slim.mapInArrow(run, schema)
