"""Packing: each document is cut into pieces whose lengths are powers of two, and pieces of one length share a bucket.

A sequence is one piece, so it never crosses documents and needs no padding; batches are drawn from one bucket at a time.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from procurisk.llm import batches

#: Tokens of the longest sequence, a power of two, and the id that ends a document.
SEQUENCE_TOKENS = 1024
END_ID = 0
# Fixed value: how byte-level BPE cuts a text before it merges.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that every library takes for the same kind: texts with others, or with what may be a special token, and texts with
#: a run of more than ``LONG_RUN`` bytes without a blank or of ``LONG_GAP`` blanks go to the tokenizer itself.
COMMON = (
    r"\t\n\r -~\x{a1}-\x{ac}\x{ae}-\x{21f}\x{391}-\x{3a1}\x{3a3}-\x{3ce}\x{401}-\x{40c}\x{40e}-\x{44f}\x{451}-\x{45c}"
    r"\x{2013}-\x{2014}\x{2018}-\x{201a}\x{201c}-\x{201e}\x{2022}\x{2026}\x{20ac}\x{3001}-\x{3002}\x{3041}-\x{3094}"
    r"\x{30a1}-\x{30fa}\x{4e00}-\x{9fa5}\x{ac00}-\x{d7a3}"
)
LONG_RUN, LONG_GAP = 2000, 100
OTHER = rf"[^{COMMON}]|<\||[\t\n\r ]{{{LONG_GAP}}}"


def merge_ranks(tokenizer: bytes) -> dict[bytes, int] | None:
    """The bytes of each token and its id, if ids follow the order of the merges; else None.

    A byte-level vocabulary writes a byte as the character of that number if it is printable, else as one from 256 on.
    """
    model = json.loads(tokenizer)["model"]
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)) - set(printable))
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    vocabulary = model["vocab"]
    merged = ["".join(pair.split(" ") if isinstance(pair, str) else pair) for pair in model["merges"]]
    if any(vocabulary[token] != 256 + i for i, token in enumerate(merged)):
        return None
    return {bytes(byte_of[c] for c in token): vocabulary[token] for token in [*byte_of, *merged]}


def long_runs(column: pa.Array) -> np.ndarray:
    """Which texts hold a run of more than ``LONG_RUN`` bytes without a blank."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    edges = batches.bounds(sizes)
    joined = np.frombuffer(b"".join(column.cast(pa.binary()).to_pylist()), dtype=np.uint8)
    stops = np.unique(np.concatenate([np.flatnonzero(joined <= 0x20), edges]))
    ends = stops[1:][np.diff(stops) > LONG_RUN]
    found = np.zeros(len(sizes), dtype=bool)
    found[np.searchsorted(edges, ends - 1, side="right") - 1] = True
    return found


class Encoder:
    """Ids of texts under a byte-level BPE tokenizer; common texts take the faster library for the same merges."""

    def __init__(self, tokenizer: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_buffer(tokenizer)
        ranks = merge_ranks(tokenizer)
        self.fast = ranks and tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and their number per text."""
        odd = pc.match_substring_regex(column, OTHER).to_numpy(zero_copy_only=False) | long_runs(column)
        found = [
            self.fast.encode_to_numpy(text, disallowed_special=())
            if self.fast and not whole
            else np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
            for text, whole in zip(column.to_pylist(), odd.tolist())
        ]
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.concatenate([np.zeros(0, dtype=np.uint32), *found]), counts


def binary_pieces(lengths: np.ndarray, longest: int = SEQUENCE_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """Text number and length of each piece: as many of the longest as fit, then the binary digits of the rest, falling."""
    sizes = [longest >> i for i in range(longest.bit_length())]
    number = np.stack([lengths // longest, *((lengths // size) % 2 for size in sizes[1:])], axis=1)
    text = np.repeat(np.arange(len(lengths)), number.sum(axis=1))
    return text, np.repeat(np.tile(sizes, len(lengths)), number.ravel())


def pack(docs: DataFrame, tokenizer: bytes, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (unsigned little-endian 32-bit), doc_tokens, sequence_id, offset, bucket.

    Null and empty texts hold ``END_ID`` only. A null id stays null; a repeated row is packed again. ``bucket`` is the
    binary logarithm of ``length``. ``sequence_id`` numbers the pieces by partition and place. No shuffle; a task holds
    about 4 MB of text at a time, or one longer text.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in stream:
            for piece in batches.pieces(batch, "text"):
                ids, counts = encoder.ids(batches.texts(piece))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, END_ID)
                counts = counts + 1
                row, length = binary_pieces(counts)
                edges = batches.bounds(length)
                start = edges[:-1] - batches.bounds(counts)[row]
                offsets = pa.py_buffer((edges * 4).astype(np.int32))
                binary = pa.Array.from_buffers(
                    pa.binary(), len(length), [None, offsets, pa.py_buffer(ids.astype("<u4"))]
                )
                columns = [
                    piece.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), binary,
                    pa.array(counts[row]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids", "doc_tokens"])

    kind = docs.schema[id_column].dataType.simpleString()
    slim = docs.select(docs[id_column].alias("doc_id"), docs[text].cast("string").alias("text"))
    cut = slim.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long")
    return cut.select(
        "*",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.log2("length").cast("int").alias("bucket"),
    )
