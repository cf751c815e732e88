"""Toxicity: multiple-instance learning. A document is toxic if one of its sentences is, and only documents have labels.

A sentence has the probability s = sigmoid(bias + sum of the weights of its words); its document has 1 - prod(1 - s)
(noisy-or). The likelihood of the document labels trains the weights, so sentences learn their part without labels. Sentences
without evidence (no word that is a feature) take no part, so the length of a text alone does not make it toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procurisk.llm import batches

#: The model is fitted on at most so many toxic documents and CLEAN_SHARE times as many others, none longer than FIT_CHARS,
#: chosen by a hash of the id.
FIT_DOCUMENTS = 1_000
CLEAN_SHARE = 2
FIT_CHARS = 100_000
#: Features kept (largest difference of document frequency between the labels) and the fewest documents that hold one.
FEATURES = 300
FEATURE_DOCUMENTS = 5
#: Word beginnings that are features besides whole words.
BEGINNINGS = (4, 5)
STEPS, RATE, DECAY, FIRST_BIAS = 300, 0.3, 2e-5, -9.0
#: Smaller weights become 0 after the fit, so that long texts do not add up noise.
LEAST_WEIGHT = 0.5
#: Documents at or over it are predicted toxic; sentences at or over it are reported.
DOCUMENT_SCORE = 0.3
SENTENCE_SCORE = 0.3
SENTENCE_END = r"[.!?]+\s+|\n+"
PUNCTUATION = ".,;:!?\"'()[]{}<>|*#$%&-_/\\«»“”‘’…"
HELD_OUT = "pmod(crc32(cast(cast({0} as string) as binary)), 4) = 2"


@dataclass
class Model:
    names: list[str]
    weights: np.ndarray
    bias: float

    def word_weights(self, distinct: pa.Array) -> np.ndarray:
        """The sum of the weights of each word's features."""
        known = pa.array(self.names, type=pa.string())
        padded = np.append(self.weights, 0.0)
        total = np.zeros(len(distinct))
        for column in word_features(distinct):
            at = pc.fill_null(pc.index_in(column, value_set=known), len(self.names))
            total += padded[at.to_numpy(zero_copy_only=False)]
        return total


def word_features(distinct: pa.Array) -> list[pa.Array]:
    """Columns of features of each word; null where a word has none."""
    length = pc.utf8_length(distinct)
    starts = [
        pc.if_else(
            pc.greater(length, n),
            pc.binary_join_element_wise(pc.utf8_slice_codeunits(distinct, 0, n), "*", ""),
            pa.scalar(None, pa.string()),
        )
        for n in BEGINNINGS
    ]
    return [distinct, *starts]


def sentence_words(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, pa.Array]:
    """Word numbers, distinct words, words per sentence, sentences per text, and the sentences."""
    sentences, per_text = batches.flat(pc.split_pattern_regex(column, SENTENCE_END))
    items, counts = batches.words(pc.utf8_lower(sentences))
    code, distinct = batches.codes(items)
    return code, pc.utf8_trim(distinct, characters=PUNCTUATION), counts, per_text, sentences


def sentence_logits(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Log-odds of each sentence, sentences per text, and the sentences. A sentence whose words do not speak for toxicity has none (-inf)."""
    code, distinct, counts, per_text, sentences = sentence_words(column)
    weights = model.word_weights(distinct)
    telling = np.flatnonzero((weights != 0)[code])
    sentence = np.searchsorted(batches.bounds(counts), telling, side="right") - 1
    # a word counts once per sentence
    pair = np.unique(sentence * max(1, len(weights)) + code[telling])
    owner, word = pair // max(1, len(weights)), pair % max(1, len(weights))
    evidence = np.bincount(owner, weights[word], minlength=len(counts))
    return np.where(evidence > 0, model.bias + evidence, -np.inf), per_text, sentences


def noisy_or(logits: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """1 - prod(1 - sigmoid(logit)) over the sentences of each text; 0 without sentences."""
    return -np.expm1(-batches.per_row(np.logaddexp(0, logits), per_text))


def fit(texts: list[str], labels: np.ndarray) -> Model:
    """Gradient steps (Adagrad) on the likelihood of the labels under the noisy-or of the sentences."""
    if not len(texts):
        return Model([], np.zeros(0), FIRST_BIAS)
    code, distinct, counts, per_text, _ = sentence_words(pa.array(texts, type=pa.string()))
    sentence = np.repeat(np.arange(len(counts)), counts)
    document = np.repeat(np.arange(len(per_text)), per_text)
    names: list[str] = []
    entries: list[tuple[np.ndarray, np.ndarray]] = []
    for column in word_features(distinct):
        number, values = batches.codes(column.fill_null(""))
        feature = number[code]
        use = np.array([bool(x) for x in values.to_pylist()])[feature]
        pair = np.unique(document[sentence[use]] * len(values) + feature[use])
        own, label = pair % len(values), labels[pair // len(values)]
        holders = np.bincount(own, minlength=len(values))
        toxic = np.bincount(own[label == 1], minlength=len(values)) / max(1, int((labels == 1).sum()))
        clean = np.bincount(own[label == 0], minlength=len(values)) / max(1, int((labels == 0).sum()))
        score = np.where(holders >= FEATURE_DOCUMENTS, np.abs(toxic - clean), 0)
        best = np.argsort(-score, kind="stable")[:FEATURES]
        best = best[score[best] > 0]
        place = np.full(len(values), -1)
        place[best] = len(names) + np.arange(len(best))
        names += values.take(pa.array(best)).to_pylist()
        held = use & (place[feature] >= 0)
        once = np.unique(sentence[held] * len(values) + feature[held])
        entries.append((once // len(values), place[once % len(values)]))
    row, column = (np.concatenate([e[i] for e in entries]) for i in (0, 1))
    weights, bias = np.zeros(len(names)), FIRST_BIAS
    squares, bias_square = np.full(len(names), 1e-6), 1e-6
    full = np.bincount(row, minlength=len(counts)) > 0
    share = 1 / len(texts)
    for _ in range(STEPS):
        logits = bias + np.bincount(row, weights[column], minlength=len(counts))
        chance = np.where(full, 1 / (1 + np.exp(-logits)), 0)
        whole = noisy_or(np.where(full, logits, -np.inf), per_text)
        # d loss / d logit: chance for clean documents, -chance * (1 - whole) / whole for toxic ones
        pull = np.where(labels == 1, -(1 - whole) / np.maximum(whole, 1e-9), 1.0)
        slope = share * chance * pull[document]
        change = np.bincount(column, slope[row], minlength=len(names)) + DECAY * weights
        squares += change**2
        weights = weights - RATE * change / np.sqrt(squares)
        step = slope.sum()
        bias_square += step**2
        bias -= RATE * step / np.sqrt(bias_square)
    kept = np.flatnonzero(np.abs(weights) >= LEAST_WEIGHT)
    return Model([names[i] for i in kept], weights[kept], float(bias))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled documents outside the held-out part.

    The ids of the sample come from the labels alone (at most 3 * ``FIT_DOCUMENTS`` of them, hence the broadcast); the documents
    are then picked in one scan without a shuffle. Labels that are null or neither 0 nor 1 are left out; a document
    with several labels counts as toxic if one says so. Without labels the model has no features and scores near 0.
    """
    usable = (
        labels.where(f"toxic IN (0, 1) AND doc_id IS NOT NULL AND NOT ({HELD_OUT.format('doc_id')})")
        .groupBy(F.col("doc_id").alias("labelled_id"))
        .agg(F.max("toxic").alias("label"))
    )
    order = (F.xxhash64("labelled_id"), F.col("labelled_id"))
    chosen = [
        usable.where(F.col("label") == label).orderBy(*order).limit(share * FIT_DOCUMENTS)
        for label, share in ((1, 1), (0, CLEAN_SHARE))
    ]
    sample = docs.select(docs["doc_id"].alias("id"), docs["text"].cast("string").alias("body")).where(
        f"body IS NOT NULL AND char_length(body) <= {FIT_CHARS}"
    )
    rows = sample.join(F.broadcast(chosen[0].unionAll(chosen[1])), F.col("id") == F.col("labelled_id"))
    # repeated rows of one id count once, so that the sample stays bounded
    table = rows.groupBy("id").agg(F.min("body").alias("body"), F.max("label").alias("label")).toArrow().sort_by("id")
    return fit(table["body"].to_pylist(), table["label"].to_numpy().astype(np.int64))


def score(docs: DataFrame, model: Model, sentences: bool = True) -> DataFrame:
    """Per document: held_out, score, predicted, and with ``sentences`` the offending ones with their scores and places.

    Null, empty and word-less texts have no sentence and score 0. A null id stays null and is not held out; repeated rows give
    repeated results. No shuffle; a task holds about 4 MB of text at a time, or one longer text.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for piece in batches.pieces(batch, "text"):
                logits, per_text, parts = sentence_logits(model, batches.texts(piece))
                result = noisy_or(logits, per_text)
                columns = [piece.column("doc_id"), pa.array(result)]
                if sentences:
                    chance = 1 / (1 + np.exp(-logits))
                    bad = np.flatnonzero(chance >= SENTENCE_SCORE)
                    edges = batches.bounds(per_text)
                    owner = np.searchsorted(edges, bad, side="right") - 1
                    found = pa.StructArray.from_arrays(
                        [pa.array(bad - edges[owner]), pa.array(chance[bad]), parts.take(pa.array(bad))],
                        names=["place", "score", "sentence"],
                    )
                    cuts = batches.bounds(np.bincount(owner, minlength=len(per_text))).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts), found))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "sentences"][: len(columns)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", sentences array<struct<place: long, score: double, sentence: string>>" if sentences else ""
    slim = docs.select(docs["doc_id"], docs["text"].cast("string").alias("text"))
    scored = slim.mapInArrow(run, f"doc_id {kind}, score double{more}")
    return scored.select(
        "doc_id",
        F.coalesce(F.expr(HELD_OUT.format("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= DOCUMENT_SCORE, 1).otherwise(0).cast("int").alias("predicted"),
        *["sentences"] * sentences,
    )


def below(docs: DataFrame, model: Model, limit: float = DOCUMENT_SCORE) -> DataFrame:
    """The rows of ``docs`` that score under ``limit``, with all columns; texts without words score 0 and stay. No shuffle."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for piece in batches.pieces(batch, "text"):
                logits, per_text, _ = sentence_logits(model, batches.texts(piece))
                yield piece.filter(pa.array(noisy_or(logits, per_text) < limit))

    return docs.mapInArrow(run, docs.schema)
