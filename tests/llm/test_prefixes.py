"""Questions on prefixes answered from the stored table alone."""

import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from procurisk.llm import prefix_counts, queries

TEXTS = [
    None, "", " ", "word", "  two  blanks ", "a b c d e f g", "Ünïcödé 日本語 文字列 😀😀", "▁under ▁scores▁", "tab\tand\nline\r\n", "x" * 300,
    "https://example.org/a?b=c&d=e#f", "1234567890 12.5 -3e7", "naïve café coöperate", "日本語の文章には空白がありません。" * 5,
]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    choose = random.Random(2)
    words = ["the", "The", "ing", "straße", "é", "日本", "12", "a-b", "", "▁", "end."]
    texts = TEXTS + [" ".join(choose.choice(words) for _ in range(choose.randint(0, 30))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("prefix_tokens", F.lit("x"))
    path = str(tmp_path_factory.mktemp("prefixes") / "table")
    prefix_counts.prefixes(docs, queries.vocabulary(queries.COUNT_MODEL)).write.parquet(path)
    return texts, spark.read.parquet(path)


def test_every_prefix_and_budget(stored, monkeypatch):
    texts, table = stored
    library = sentencepiece.SentencePieceProcessor(model_proto=queries.vocabulary(queries.COUNT_MODEL))
    expected = {i: [len(library.encode((text or "")[:n])) for n in range(len(text or "") + 1)] for i, text in enumerate(texts)}
    # from here on nothing may be encoded
    monkeypatch.setattr(prefix_counts, "ChunkCounter", None)
    assert {r["doc_id"]: r["prefix_tokens"] for r in table.collect()} == expected
    for n in (-1, 0, 3, 17, 10_000):
        found = {r[0]: r[1] for r in table.select("doc_id", prefix_counts.tokens_of(n)).collect()}
        assert found == {i: counts[max(0, min(n, len(counts) - 1))] for i, counts in expected.items()}
    for budget in (0, 1, 5, 20, 10_000):
        found = {r[0]: r[1] for r in table.select("doc_id", prefix_counts.longest_prefix(budget)).collect()}
        assert found == {i: max(n for n, count in enumerate(counts) if count <= budget) for i, counts in expected.items()}


def test_no_rows_and_bounded_memory(spark, stored, monkeypatch):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string").limit(0)
    assert prefix_counts.prefixes(docs, queries.vocabulary(queries.COUNT_MODEL)).count() == 0
    monkeypatch.setattr(prefix_counts, "REMEMBERED_CHARS", 100)
    monkeypatch.setattr(prefix_counts, "REMEMBERED_PAIRS", 10)
    counter = prefix_counts.ChunkCounter(queries.vocabulary(queries.COUNT_MODEL))
    for i in range(50):
        counter.counts([f"{i}" + "long " * 10])
        counter.prefix_counts(f"chunk{i}")
    assert counter.known_chars < 300 and len(counter.pairs) <= 11
