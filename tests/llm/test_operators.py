"""Each training-data operator against brute force, a round trip or held-out labels, and on awkward tables."""

import hashlib
import math
import os
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import check_queries
import corpus_pipeline
from procurisk.llm import (
    batches, forest, html_text, impact_index, licenses, mixing, oracle, packing, prefix_counts, queries, repetition, toxicity, warc,
)

SF_DIR = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
LONG = "word " * 30_000
#: nulls, empty, blank, one word, very long, odd white space, non-ASCII, special tokens, repeated rows; columns that clash.
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (6, "a  b \n c\x0bd  "), (7, "é 日本語 😀 x y"),
    (8, "<|endoftext|> <s> tail "), (4, "one"), (None, "no id here"), (None, None), (9, "Same text.\nSame text.\nSame text."),
    (9, "another text under one id"),
]


def documents(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string")
    clashing = ("kept", "score", "component_id", "set_key", "rep", "block", "mix_source", "near_copy_id", "n", "ids", "start")
    return table.select("doc_id", "text", F.lit("s").alias("source"), *(F.lit("x").alias(c) for c in clashing))


@pytest.fixture(scope="module")
def awkward(spark):
    return documents(spark, AWKWARD)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, AWKWARD).limit(0)


@needs_data
@pytest.mark.parametrize("name", list(oracle.ORACLE_SQL))
def test_against_sql(spark, name, monkeypatch):
    monkeypatch.setattr(check_queries.entry_point, "queries", lambda: queries.QUERIES)
    monkeypatch.setattr(check_queries.entry_point, "oracle_sql", lambda: oracle.ORACLE_SQL)
    outcome, _ = check_queries.compare(spark, check_queries.duckdb_connection(SF_DIR), SF_DIR, name)
    assert outcome.startswith("same"), outcome


# exact top-k


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1))


def brute_top_k(rows, k):
    items = []
    for vec_id, x in rows:
        if vec_id is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        items.append((vec_id, [math.floor(Fraction(float(np.float32(c))) * 256) for c in x]))
    found = []
    for at, (q, v) in enumerate(items):
        if q % 50 == 0:
            scored = sorted(
                (-max(-impact_index.LARGEST, min(impact_index.LARGEST, sum(a * b for a, b in zip(v, w)))), i)
                for place, (i, w) in enumerate(items) if place != at and len(w) == len(v)
            )
            found += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(found)


def found_top_k(table, k):
    got = impact_index.top_k(table, "vec_id % 50 = 0", k)
    return sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect()))


def test_top_k(spark, monkeypatch):
    random_ = np.random.default_rng(5)
    rows = [(i, random_.normal(0, 0.12, 16).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[50][1]) for i in range(60)] + [(7, rows[7][1]), (7, rows[8][1])]
    rows += [(2000, None), (2050, [None] * 16), (2100, [float("nan")] * 16), (2150, [float("inf")] * 16), (None, rows[0][1])]
    rows += [(3000, [0.5, 0.5]), (3001, [0.1, 0.2]), (3050, []), (3051, []), (3100, [0.0] * 16)]
    # rows that share an id are candidates, and queries, of their own
    rows += [(50, rows[60][1]), (50, rows[50][1]), (1, [0.9] * 16)]
    clashing = vectors(spark, rows).select("*", *(F.lit("x").alias(c) for c in ("row", "rank", "score", "block", "dims", "v")))
    monkeypatch.setattr(impact_index, "BLOCK_ITEMS", 64)
    monkeypatch.setattr(impact_index, "QUERY_BATCH", 4)
    assert found_top_k(clashing, 5) == brute_top_k(rows, 5)
    assert impact_index.top_k(vectors(spark, rows).limit(0), "vec_id % 50 = 0", 5).count() == 0


def test_top_k_of_large_components(spark, monkeypatch):
    """No component is too large: not for taking part, not for exact scores, and not for the number of levels."""
    random_ = np.random.default_rng(6)
    rows = [(50, [1.0, 1.0]), (2, [70000.0, 0.0]), (3, [0.1, 0.2]), (4, [-3.0e38, 1.0]), (100, [1e10, -1e10]), (5, [1e10, 1e10 + 4096])]
    assert found_top_k(vectors(spark, rows), 5) == brute_top_k(rows, 5)
    rows = [(i, (random_.normal(0, 1, 8) * 10.0 ** random_.integers(-2, 8)).astype(np.float32).tolist()) for i in range(300)]
    monkeypatch.setattr(impact_index, "BLOCK_ITEMS", 100)
    monkeypatch.setattr(impact_index, "BLOCK_NUMBERS", 400)  # eight numbers a vector: fifty items a block
    assert found_top_k(vectors(spark, rows), 4) == brute_top_k(rows, 4)
    for deviation in (0.125, 40.0, 1000.0):
        matrix = np.floor(256 * random_.normal(0, deviation, (500, 16)))
        index = impact_index.ImpactIndex(np.arange(500), np.arange(500), matrix)
        assert len(index.steps) <= impact_index.MOST_LEVELS


def test_top_k_sends_no_query_copies_through_the_driver(spark, monkeypatch):
    """Queries look small enough to be broadcast, but a copy of them goes to every block."""
    random_ = np.random.default_rng(7)
    rows = [(i, random_.normal(0, 0.12, 16).astype(np.float32).tolist()) for i in range(300)]
    monkeypatch.setattr(impact_index, "BLOCK_ITEMS", 20)
    monkeypatch.setattr(impact_index, "QUERY_BATCH", 2)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 1 << 20
    found = impact_index.top_k(vectors(spark, rows), "vec_id % 50 = 0", 5)
    assert sorted(map(tuple, found.collect())) == brute_top_k(rows, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_numbers_of_a_block_are_packed_without_loss():
    for most in (0, 1, 2**15 - 1, 2**15, 2**31 - 1, 2**31, 2**53, 1e300):
        matrix = np.array([[most, -most, 0.0], [1.0, -1.0, most]])
        packed = impact_index.packed_numbers(matrix)
        assert len(packed) <= matrix.nbytes and (impact_index.unpacked_numbers(packed, 2, 3) == matrix).all()
    assert impact_index.unpacked_numbers(impact_index.packed_numbers(np.zeros((4, 0))), 4, 0).shape == (4, 0)


# repetition


def longest_repeats(words):
    n = len(words)
    found = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            found[i] = max(found[i], k)
    return found


def test_repeat_lengths():
    choose = random.Random(3)
    for _ in range(150):
        texts = [[choose.choice("abc"[: choose.randint(1, 3)]) for _ in range(choose.randint(0, 14))] for _ in range(4)]
        items, counts = batches.words(pa.array([" ".join(text) for text in texts]))
        code, _ = batches.codes(items)
        assert repetition.repeat_lengths(code, counts).tolist() == sum(map(longest_repeats, texts), [])


def test_quality_rules(spark, awkward, empty):
    rows = {(r["doc_id"], r["n_words"]): r for r in repetition.quality_rules(awkward).collect()}
    assert len(repetition.quality_rules(awkward).collect()) == len(AWKWARD)
    assert rows[(5, 30_000)]["longest_repeat_words"] == 29_999 and rows[(5, 30_000)]["base_failed"]
    assert rows[(9, 6)]["n_dup_lines"] == 2 and rows[(9, 6)]["n_repeat_words"] == 6
    assert rows[(1, 0)]["base_failed"] and not rows[(1, 0)]["kept"]
    passage = " ".join(f"p{i}" for i in range(30))
    text = " ".join([*(f"a{i}" for i in range(60)), passage, *(f"b{i}" for i in range(60)), passage])
    row = repetition.quality_rules(documents(spark, [(1, text)])).first()
    assert [tuple(x) for x in row["repeats"]] == [(60, 90), (150, 180)]
    assert not row["base_failed"] and not row["kept"]  # 60 of 180 words
    assert repetition.quality_rules(empty).count() == 0
    assert repetition.passing(documents(spark, [(1, text), (2, " ".join(f"w{i}" for i in range(60)))])).count() == 1


# licences


def test_licenses(spark, awkward, empty):
    texts = [
        (1, "intro\n  RELEASED under the MIT-Licence!!\nend"), (2, "(c) 2020 Someone\nAll rights reserved"), (3, "the MIT License"),
        (4, licenses.KNOWN[-1][1].replace("copyright notice", "Copyright  notice")), (5, None), (5, "All rights reserved."),
    ]
    rows = licenses.scan(documents(spark, texts)).collect()
    found = {r["doc_id"]: (r["whole_license"], r["licenses"]) for r in rows if r["doc_id"] < 5}
    assert found == {1: (None, "MIT"), 2: ("all-rights-reserved",) * 2, 3: (None, ""), 4: ("ISC", "ISC")}
    assert len(rows) == 6 and licenses.scan(awkward).count() == len(AWKWARD) and licenses.scan(empty).count() == 0
    # a long line counts as well as a long text
    long = [(1, "=" * 300_000 + " All rights reserved."), (2, "x\n" + "=" * 300_000 + " All rights reserved.\ny")]
    assert {r["doc_id"]: r["licenses"] for r in licenses.scan(documents(spark, long)).collect()} == {1: "all-rights-reserved", 2: "all-rights-reserved"}
    extra = spark.createDataFrame([("own", "The MIT licence")], "license string, text string")
    assert licenses.scan(documents(spark, texts), extra).where("whole_license = 'own'").count() == 1


# archives


def test_salvage():
    records = [warc.record(str(i), f"http://x/{i}", f"<p>{i} WARC/1.1\r\n</p>".encode() * 9, None) for i in range(6)]
    for make in (warc.member, bytes):
        parts = [make(r) for r in records]
        data = b"".join(parts)
        whole = list(warc.salvage(data))
        assert [p[3]["record_id"] for p in whole] == [f"<urn:page:{i}>" for i in range(6)]
        assert sum(p[1] for p in whole) == len(data)
        broken = bytearray(data)
        at = len(parts[0]) + len(parts[1]) // 2
        broken[at : at + 7] = b"\0" * 7
        salvaged = list(warc.salvage(bytes(broken[: -len(parts[5]) // 2])))
        good = [p[3]["record_id"] for p in salvaged if p[2] is None]
        assert good == [f"<urn:page:{i}>" for i in (0, 2, 3, 4)]
        gaps = [(p[0], p[1]) for p in salvaged if p[2] is not None]
        assert gaps[0] == (len(parts[0]), len(parts[1])) and len(gaps) == 2
    assert list(warc.salvage(b"")) == [] and [p[:2] for p in warc.salvage(b"junk")] == [(0, 4)]


def test_salvage_inside_a_member():
    choose = random.Random(3)
    texts = [" ".join(str(choose.random()) for _ in range(4000)).encode() for _ in range(6)]
    records = [warc.record(str(i), None, text, None) for i, text in enumerate(texts)]
    page = "<urn:page:{}>".format

    def read(data):
        parts = list(warc.salvage(data))
        return [p[3]["record_id"] for p in parts if p[2] is None], [p for p in parts if p[2] is not None]

    # one bad record among good ones of a member that is whole
    bad = records[2].replace(texts[2][:9], b"#" * 9)
    last = warc.member(warc.record("9", None, b"x", None))
    one = warc.member(b"".join([*records[:2], bad, *records[3:]]))
    good, gaps = read(one + last)
    assert good == [page(i) for i in (0, 1, 3, 4, 5, 9)] and len(gaps) == 1
    first = len(records[0]) + len(records[1])
    assert f"(inflated bytes {first} to {first + len(bad)})" in gaps[0][2] and gaps[0][:2] == (0, len(one))
    # a member that is cut off, one with a wrong check sum, and one with damaged compressed bytes, each before a good member
    whole = warc.member(b"".join(records))
    assert read(whole[: len(whole) * 5 // 12])[0] == [page(0), page(1)]
    assert read(whole[:-8] + bytes(4) + whole[-4:] + last)[0] == [*(page(i) for i in range(6)), page(9)]
    damaged = bytearray(whole)
    damaged[len(whole) * 5 // 12 : len(whole) * 5 // 12 + 400] = b"\xff" * 400
    good, gaps = read(bytes(damaged) + last)
    assert good[:2] == [page(0), page(1)] and good[-1] == page(9) and gaps


def test_archives(spark, tmp_path):
    rows = [(1, "http://a b", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (None, "u", "x"), (5, "u", "é" * 70_000), (5, "u", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    warc.write_archives(pages, str(tmp_path / "w"))
    read = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert len(read) == len(rows) and all(r["quarantined"] is None for r in read)
    found = {(r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in read}
    page = "<urn:page:{}>".format
    assert found == {
        (page(1), "revisit", page(2), 1), (page(2), "response", None, 1), (page(3), "revisit", page(4), 0),
        (page(4), "response", None, 0), (None, "revisit", page(2), 1), (page(5), "response", None, 140_000), (page(5), "response", None, 1),
    }
    assert {bytes(r["payload"]) for r in read if r["record_type"] == "response"} == {b"x", b"", ("é" * 70_000).encode(), b"y"}
    warc.write_archives(pages, str(tmp_path / "none"), least=2)
    assert {r["record_type"] for r in warc.read_archives(spark, str(tmp_path / "none")).collect()} == {"response"}
    warc.write_archives(pages.limit(0), str(tmp_path / "empty"))
    assert warc.read_archives(spark, str(tmp_path / "empty")).count() == 0


# toxicity


@needs_data
def test_toxicity_held_out(spark):
    path = SF_DIR.replace("sf0.001", "sf0.1")
    docs, labels = (queries.table(spark, path, name) for name in ("documents", "labels"))
    rows = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r["toxic"] == 1]
    clean = [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in toxic) >= 0.9 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.03 * len(clean)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    assert all(r["sentences"] for r in toxic if r["score"] > 0.9) and any(r["sentences"][0]["sentence"] for r in toxic if r["sentences"])


def test_toxicity_awkward(spark, awkward, empty):
    model = toxicity.fit(["Good words here. You fool.", "fool again", "Good words here.", "fine words"] * 9, np.array([1, 1, 0, 0] * 9))
    rows = toxicity.score(awkward, model).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in rows)
    assert [r["score"] for r in rows if r["doc_id"] in (1, 2, 3)] == [0, 0, 0]
    assert toxicity.noisy_or(np.array([0.0, 0.0]), np.array([2, 0])).tolist() == [0.75, 0.0]
    labels = spark.createDataFrame([(1, None), (None, 1), (4, 2)], "doc_id long, toxic int")
    unfitted = toxicity.train(awkward, labels)
    assert toxicity.score(empty, unfitted).count() == 0 and toxicity.below(awkward, unfitted).count() == len(AWKWARD)
    known = toxicity.Model(["fool"], np.array([12.0]), -9.0)
    located = toxicity.score(documents(spark, [(1, "Good words. a fool there.\nfine")]), known).first()
    assert located["sentences"][0]["place"] == 1


def test_long_clean_text_is_not_toxic():
    fitted = toxicity.fit(["Good words here. You fool.", "fool again", "Good words here.", "fine words"] * 9, np.array([1, 1, 0, 0] * 9))
    for model in (fitted, toxicity.Model(["fool"], np.array([12.0]), -9.0)):
        for sentence, toxic in (("Nothing to see, good day.\n" * 50_000, False), ("Nothing to see.\n" * 50_000 + "You fool.", True)):
            logits, per_text, _ = toxicity.sentence_logits(model, pa.array([sentence]))
            assert (toxicity.noisy_or(logits, per_text)[0] >= toxicity.DOCUMENT_SCORE) == toxic


# near copies


def word_sets(text):
    words = [bytes(w.lower() if w.isascii() else w, "utf-8") for w in (text or "").encode().decode().split(" ") if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(rows):
    sets = [(i, word_sets(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if s and u and 100 * len(s & u) >= 75 * len(s | u):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i, _ in rows}


def copies(seed=1, groups=30, size=7, words=60):
    choose = random.Random(seed)
    rows = []
    for group in range(groups):
        base = [f"w{choose.randrange(900)}" for _ in range(words)]
        for _ in range(size):
            text = list(base)
            for _ in range(choose.randrange(3)):
                text[choose.randrange(words)] = f"v{choose.randrange(900)}"
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("region", [2048, 8])
def test_near_copies(spark, monkeypatch, region):
    monkeypatch.setattr(forest, "REGION", region)
    rows = copies() + copies(seed=2, groups=1, size=60, words=80)
    rows = [(i, text) for i, (_, text) in enumerate(rows)]
    got = {r["doc_id"]: r for r in forest.near_copies(documents(spark, rows)).collect()}
    want = brute_components(rows)
    wrong = [i for i in want if got[i]["component_id"] != want[i]]
    # regions of 8 force the deeper levels, where chains of links may miss one
    assert len(wrong) <= (0 if region > 8 else 0.05 * len(rows))
    assert all(got[i]["n_shingles"] == len(word_sets(t)) and got[i]["kept"] == (got[i]["component_id"] == i) for i, t in rows)


def test_edge_of_a_large_group(spark, monkeypatch):
    """A tight group larger than a region, and texts that are close to it but not to one another."""
    monkeypatch.setattr(forest, "REGION", 32)
    monkeypatch.setattr(forest, "PIVOTS", 8)
    choose = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(240):
        text = list(base)
        for place in choose.sample(range(390), 1 if i < 200 else 9):
            text[place] = f"v{i}_{place}"
        rows.append((i, " ".join(text)))
    got = {r["doc_id"]: r["component_id"] for r in forest.near_copies(documents(spark, rows)).collect()}
    assert got == brute_components(rows) and set(got.values()) == {0}


def test_large_regions_lose_no_pair(spark, monkeypatch):
    """Copies among texts that share boilerplate, and tight groups, in regions far over the limit and with hardly a pivot."""
    monkeypatch.setattr(forest, "REGION", 8)
    monkeypatch.setattr(forest, "PIVOTS", 1)
    choose = random.Random(11)
    boilerplate = [f"b{i}" for i in range(80)]
    texts = [text for _, text in copies(groups=12) + copies(seed=2, groups=1, size=40, words=80)]
    for i in range(60):
        own = [f"o{i}_{j}" for j in range(20)]
        texts += [" ".join(boilerplate + own), " ".join(boilerplate + own[:-1] + [f"v{choose.randrange(900)}"])]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["component_id"] for r in forest.near_copies(documents(spark, rows)).collect()}
    want = brute_components(rows)
    assert len(set(want.values())) > 60 and got == want


def test_pivots_of_unequal_regions(spark):
    """A set that is a pivot only in the smaller region of a later order meets the sets that share an earlier order too."""
    at = [(t, 100 + t, members) for t, members in ((0, 1 << 30), (1, forest.PIVOTS))]
    large = spark.createDataFrame(
        [(name, t, region, 0, members, None) for name in (b"a", b"b") for t, region, members in at],
        "set_key binary, t int, region long, level int, members long, pivoted long",
    )
    sets = spark.createDataFrame([(b"a", 1, 9, b"\1" * 256), (b"b", 2, 9, b"\1" * 256)], "set_key binary, rep long, n_shingles long, sketch binary")
    order = [part.split()[0] for part in forest.KEPT.split(", ")]
    near = forest.close_members(forest.pivot_cells(large).join(sets, "set_key").select(*order)).collect()
    assert {bytes(r["set_key"]) for r in near} == {b"a", b"b"}


def test_near_copies_awkward(spark, awkward, empty):
    rows = forest.near_copies(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1, 2, 3}
    assert all(r["kept"] for r in rows) and next(r for r in rows if r["doc_id"] == 4)["n_shingles"] == 1
    assert forest.near_copies(empty).count() == 0
    mixed_case = documents(spark, [(3, "A b C d"), (2, "a B c D"), (5, "a b c"), (None, "a b c"), (None, "x y")])
    kept = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in forest.near_copies(mixed_case).collect()}
    assert kept[(3, 1)] == (2, False) and kept[(2, 1)] == (2, True) and kept[(5, 1)] == (5, True)
    one = forest.one_of_each(mixed_case).collect()
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in one if r["doc_id"]) == [(2, "x")] or len(one) == 3
    assert len(one) == 3 and forest.one_of_each(awkward).count() == len(AWKWARD) - 1


# tokens


@pytest.fixture(scope="module")
def sample_texts(spark):
    if not os.path.isdir(SF_DIR):
        return [t or "" for _, t in AWKWARD]
    return [r["text"] for r in queries.table(spark, SF_DIR, "documents").collect()] + [t or "" for _, t in AWKWARD]


def test_token_counts(spark, sample_texts, empty):
    model = queries.vocabulary(queries.COUNT_MODEL)
    direct = sentencepiece.SentencePieceProcessor(model_proto=model)
    docs = documents(spark, list(enumerate(sample_texts)))
    rows = prefix_counts.count_tokens(docs, model, 300, tables=True).collect()
    for row in rows:
        text = sample_texts[row["doc_id"]]
        assert row["n_tokens"] == len(direct.encode(text)) and row["n_bytes"] == len(text.encode())
        assert row["over_limit"] == (row["n_tokens"] > 300)
        assert len(direct.encode(text[: row["fit_chars"]])) <= 300
        assert row["chunk_tokens"][-1] == row["n_tokens"] and row["chunk_chars"][-1] == len(text)
    assert prefix_counts.count_tokens(empty, model, 300).count() == 0


def test_every_prefix(sample_texts):
    model = queries.vocabulary(queries.COUNT_MODEL)
    counter, direct = prefix_counts.ChunkCounter(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for text in [t[:150] for t in sample_texts[::9]] + ["a  b ", " x▁y", "日本語 😀!", "internationalisation"]:
        for n in range(len(text) + 1):
            assert prefix_counts.tokens_of_prefix(counter, text, n) == len(direct.encode(text[:n])), (text, n)


def test_packing(spark, sample_texts, empty):
    data = queries.vocabulary(queries.PACK_TOKENIZER)
    direct = Tokenizer.from_buffer(data)
    docs = documents(spark, list(enumerate(sample_texts)))
    pieces = packing.pack(docs, data).collect()
    by_doc = {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        assert p["length"] == 1 << p["bucket"] <= packing.SEQUENCE_TOKENS and p["offset"] == 0
        assert p["start"] == len(by_doc.setdefault(p["doc_id"], []))
        by_doc[p["doc_id"]] += np.frombuffer(p["ids"], dtype="<u4").tolist()
        assert len(p["ids"]) == 4 * p["length"]
    assert len({p["sequence_id"] for p in pieces}) == len(pieces)
    for i, text in enumerate(sample_texts):
        assert by_doc[i] == [*direct.encode(text, add_special_tokens=False).ids, 0]
    assert packing.pack(empty, data).count() == 0
    assert packing.pack(documents(spark, AWKWARD), data).where("doc_id IS NULL").count() > 0


def test_ids_of_every_common_character():
    data = queries.vocabulary(queries.PACK_TOKENIZER)
    encoder, direct = packing.Encoder(data), Tokenizer.from_buffer(data)
    assert encoder.fast
    characters = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}1{c} {c}b {c}{c}  {c}\n{c}'s" for c in characters[::3]]
    # what goes to the tokenizer itself: special strings, odd blanks, long runs
    texts += ["", " ", "<|endoftext|>x", "a<|b", "x" * 5000, " " * 500, "a\x1cb", "a" * 1999 + " " + "b" * 2500, "😀 ok", "\n" * 99]
    ids, counts = encoder.ids(pa.array(texts))
    wanted = [x.ids for x in direct.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == list(map(len, wanted)) and ids.tolist() == [i for ids in wanted for i in ids]


# mixing


def test_exponent(spark):
    totals = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10), ("d", 0)], "source string, tokens long")
    p = np.array([0.9, 0.09, 0.01])

    def entropy(a):
        w = p**a / (p**a).sum()
        return float(-(w * np.log(w)).sum())

    a = mixing.exponent(totals, entropy=0.9)
    assert abs(entropy(a) - 0.9) < 1e-6
    b = mixing.exponent(totals, repetition_limit=4.0)
    assert abs((p[0] / p[2]) ** (1 - b) - 4) < 1e-6
    assert mixing.exponent(totals, entropy=2.0) == pytest.approx(0, abs=1e-8) and mixing.exponent(totals, repetition_limit=1e9) == 0
    assert mixing.exponent(totals, entropy=0.0) == 1.0 and mixing.exponent(totals.limit(0), entropy=1.0) == 1.0


def test_mix(spark, awkward, empty, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 50)
    rows = [(i, "w " * 10, "big" if i < 300 else "small") for i in range(340)] + [(900, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("mix_epoch", F.lit("old"))
    mixed = mixing.mix(docs, repetition_limit=2.0).collect()
    times = {}
    for r in mixed:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert set(times) == {r[0] for r in rows}  # whole epochs first: nothing is left out
    small = sum(times[i] for i in range(300, 340))
    assert max(times.values()) <= 3 and 40 < small <= 80 and sum(times[i] for i in range(300)) == 300
    budget = mixing.mix(docs, entropy=0.0, repetition_limit=None, budget=1700).collect()
    assert 1500 <= sum(10 for r in budget if r["doc_id"] < 900) <= 1700
    assert mixing.mix(awkward).count() >= len(AWKWARD) and mixing.mix(empty).count() == 0


# pages

PAGE = """<!doctype html><title>t</title><body><header class="site-header">Site. Name, here.</header><nav><ul><li><a href=x>Home</a>
<li><a href=y>About us, and more.</a></ul></nav><div class="cookie-notice">We use cookies. Accept, please.</div>
<div id="content"><h2>Heading</h2><p>First &amp; long paragraph, with <b>bold</b> words.<br>Next line, of it.<p>Second one, quite
 long as well; it has marks.</p><ul><li>point one<li>point two</ul><form>Name: <input></form><div class="ad">Buy, now. Cheap, good.</div>
<p>Third, and last. It ends here.</p></div><div class="comments"><p>Great post, thanks. I liked it, really.</p></div>
<script>var a = "<p>no</p>";</script><footer>Copyright, all rights.</footer>"""


def test_main_text(spark):
    want = [
        "Heading", "First & long paragraph, with bold words. Next line, of it.", "Second one, quite long as well; it has marks.", "point one",
        "point two", "Third, and last. It ends here.",
    ]
    assert html_text.main_text(PAGE).split("\n\n") == want
    assert html_text.main_text("") == "" and html_text.main_text("<script>x") == "" and html_text.main_text("a < b") == "a < b"
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "u", "<p>" + LONG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old"))
    found = html_text.extract(pages).collect()
    assert [r["n_chars"] for r in found] == [len(r["text"]) for r in found] and len(found) == 4
    assert found[2]["text"] == "" and found[3]["n_chars"] == len(LONG) - 1 and html_text.extract(pages.limit(0)).count() == 0


def test_names_of_wrappers_do_not_drop_the_article():
    want = html_text.main_text(PAGE)
    for name in ("content-sidebar-wrap", "has-sidebar", "elementor-widget-container", "no-comments", "share-enabled"):
        assert html_text.main_text(PAGE.replace('<div id="content">', f'<div id="content"><div class="{name}">', 1)) == want, name
        assert html_text.main_text(PAGE.replace('<div id="content">', f'<article class="{name}"><h1>Title</h1>', 1)).endswith(want), name
    whole = PAGE.replace("<body>", "<body><form action=x>").replace("<form>Name: <input></form>", "")
    assert html_text.main_text(whole) == want
    comments = '<div class="comments">' + "<article class='comment-body'><p>Long, long reply. Really, it is.</p></article>" * 9
    assert html_text.main_text(PAGE.replace('<div class="comments">', comments, 1)) == want
    assert html_text.main_text("<div class='ad'>Buy, now. Cheap, good, and long.</div><article><h1>A</h1><p>Short.</article>") == "A\n\nShort."
    parts = ["One part, with text. It has marks, too, as text of its kind does.", "The other part, with text. It has marks, and ends."]
    page = "<body><main>" + "".join(f"<article><p>{p}</p><p>{p}</p></article>" for p in [parts[0] * 3, parts[1]]) + "</main>"
    assert parts[0] * 3 in html_text.main_text(page) and parts[1] in html_text.main_text(page)


# pipeline


@needs_data
def test_pipeline(spark):
    docs = queries.table(spark, SF_DIR, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    good = stages["quality rules"](spark, docs, SF_DIR)
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in repetition.quality_rules(docs).where("kept").collect()}
    clean = stages["toxicity"](spark, good, SF_DIR)
    one = stages["near copies"](spark, clean, SF_DIR)
    assert good.columns == clean.columns == one.columns == docs.columns
    texts = [(r["doc_id"], " ".join((r["text"] or "").split())) for r in clean.collect()]
    assert {r["doc_id"] for r in one.collect()} == set(brute_components(texts).values())
    mixed = stages["mixture"](spark, one, SF_DIR)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.select("doc_id").collect()} == {r["doc_id"] for r in one.collect()}
    whole = corpus_pipeline.run(spark, SF_DIR)
    tokenizer = Tokenizer.from_buffer(queries.vocabulary(queries.PACK_TOKENIZER))
    n = sum(len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert whole.agg(F.sum("length")).first()[0] == n


def test_digest_of_sets():
    keys, counts = forest.shingle_sets(pa.array(["a b c d e f", "A B C D E F", "a b c d e", "", "a b", "b a"]))
    assert counts.tolist() == [2, 2, 1, 0, 1, 1]
    edges = batches.bounds(counts)
    names = [hashlib.md5(keys[a:b].tobytes()).hexdigest() for a, b in zip(edges[:-1], edges[1:])]
    assert names[0] == names[1] and names[4] != names[5] and keys[edges[2]] in keys[:2]
