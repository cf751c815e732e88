import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from procurisk.operators import contracts as contract_ops
from procurisk.operators import evidence, retrieval
from procurisk.plans import jobs

SHORT = (
    "Acme Master Services Agreement\n\nPayment Terms\nInvoices and payment.\n\nSLA Obligations\nThe translated text.\n"
    "\nRenewal Terms\nnothing\n"
)
REQUEST = "vendor_id string, vendor_name string, top_risk_factors array<string>"


def contracts(spark, *rows):
    return spark.createDataFrame(list(rows), "contract_file string, text string")


def test_keyword_evidence(spark):
    requests = spark.createDataFrame(
        [("1", "Acme", ["2 SLA breach events"]), ("2", "Unknown", ["x"])], REQUEST
    )
    rows = retrieval.keyword_evidence(
        requests, contracts(spark, ("acme_contract.txt", SHORT)), 3, ["sla", "invoice", "payment", "renewal"]
    ).collect()
    got = {r["vendor_id"]: r["evidence"] for r in rows}
    assert got["2"] == []
    # terms: sla breach events invoice payment renewal; "sla" also hits inside "translated"
    assert [(e["clause_type"], e["score"]) for e in got["1"]] == [
        ("payment", round(2 / 6, 4)),
        ("sla", round(1 / 6, 4)),
        ("renewal", round(1 / 6, 4)),
    ]
    assert got["1"][0]["text"] == "Payment Terms\nInvoices and payment."
    assert {(e["vendor_name"], e["source"]) for e in got["1"]} == {("Acme", "acme_contract.txt")}


def test_no_terms_give_the_default_score(spark):
    df = spark.range(1).select(retrieval.keyword_score(F.lit("h"), F.lit("t"), F.array().cast("array<string>")))
    assert df.first()[0] == 0.1


def vectors(spark, matrix, key):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(matrix)], f"{key} long, vector array<float>")


@pytest.mark.parametrize("per_cell, per_block", [(20_000, 1_000), (13, 4), (1, 1)])
def test_search_agrees_with_brute_force(spark, per_cell, per_block):
    random = np.random.default_rng(7)
    items = random.normal(size=(60, 8)).astype("float32")
    items[10:25] = items[9]  # copies: ties go to the smaller id
    queries = random.normal(size=(9, 8)).astype("float32")
    got = retrieval.inner_product_top_k(
        vectors(spark, queries, "query_id"), vectors(spark, items, "item_id"), 5,
        items_per_block=per_cell, queries_per_batch=per_block,
    )
    found = {(r["query_id"], r["rank"]): r["item_id"] for r in got.collect()}
    scores = queries.astype("float64") @ items.astype("float64").T
    for q in range(9):
        order = sorted(range(60), key=lambda i: (-round(scores[q, i], 12), i))[:5]
        assert [found[q, rank] for rank in range(1, 6)] == order


def test_both_sides_may_come_from_one_table(spark):
    table = spark.range(40).select(
        F.col("id").alias("chunk_id"),
        F.concat(F.lit("V"), (F.col("id") % 4).cast("string")).alias("vendor_name"),
        F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vector"),
    )
    queries = table.where("chunk_id < 8").select(F.col("chunk_id").alias("vendor_id"), "vendor_name", "vector")
    rows = retrieval.vendor_preferred_top_k(queries, table, 1, items_per_block=3).collect()
    assert {r["vendor_id"]: r["chunk_id"] for r in rows} == {i: 36 + i % 4 for i in range(8)} | {0: 0}  # query 0 scores 1 everywhere


def test_search_without_items_or_queries(spark):
    some = vectors(spark, np.eye(2, dtype="float32"), "item_id")
    none = some.where("false")
    queries = some.withColumnRenamed("item_id", "query_id")
    assert retrieval.inner_product_top_k(queries, none).count() == 0
    assert retrieval.inner_product_top_k(queries.where("false"), some).count() == 0


@pytest.mark.parametrize("per_cell, per_block", [(20_000, 1_000), (5, 1_000), (7, 1)])
def test_vendor_preferred_search(spark, per_cell, per_block):
    random = np.random.default_rng(3)
    matrix = random.normal(size=(90, 6)).astype("float32")
    owners = ["Acme" if i % 3 == 0 else f"Vendor {i % 5}" for i in range(90)]
    clauses = spark.createDataFrame(
        [(i, owners[i], matrix[i].tolist()) for i in range(90)], "chunk_id long, vendor_name string, vector array<float>"
    )
    asked = {"a": " ACME ", "b": "Vendor 1 Holdings", "c": "Nobody", "d": "vendor"}
    query = {k: random.normal(size=6).astype("float32") for k in asked}
    queries = spark.createDataFrame(
        [(k, n, query[k].tolist()) for k, n in asked.items()], "vendor_id string, vendor_name string, vector array<float>"
    )
    got = {}
    for r in retrieval.vendor_preferred_top_k(
        queries, clauses, 4, items_per_block=per_cell, queries_per_batch=per_block
    ).collect():
        got.setdefault(r["vendor_id"], {})[r["rank"]] = (r["chunk_id"], r["score"], r["scope"])
    for key, name in asked.items():
        plain = name.strip().lower()
        own = [i for i in range(90) if plain in owners[i].lower() or owners[i].lower() in plain]
        pool, scope = (own, "vendor") if own else (range(90), "all")
        score = {i: float(matrix[i].astype("float64") @ query[key].astype("float64")) for i in pool}
        best = sorted(pool, key=lambda i: (-score[i], i))[:4]
        assert [got[key][r] for r in range(1, 5)] == [(i, round(score[i], 4), scope) for i in best]


def test_text_vectors_have_unit_length(spark):
    texts = spark.createDataFrame([("payment terms apply",), ("renewal of terms",), ("security",)], "text string")
    model = retrieval.fit_text_vectors(texts, width=64)
    rows = retrieval.text_vectors(model, texts).collect()
    assert all(len(r["vector"]) == 64 for r in rows)
    assert all(math.isclose(sum(x * x for x in r["vector"]), 1.0, rel_tol=1e-5) for r in rows)


def test_vector_evidence_from_stored_chunks(spark, tmp_path):
    other = "Beta Agreement\n\nData Security\nEncrypt everything at rest.\n"
    model = jobs.ingest_contracts(
        contracts(spark, ("acme_contract.txt", SHORT), ("beta_contract.txt", other)), str(tmp_path / "chunks")
    )
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    assert sorted(r["chunk_id"] for r in chunks.collect()) == [0, 1, 2, 3]
    meta = spark.read.json(str(tmp_path / "chunks_metadata")).first()
    assert (meta["chunk_count"], meta["contract_count"], meta["embedding_dimension"]) == (4, 2, 384)
    requests = spark.createDataFrame([("1", "Acme", ["payment invoices"]), ("2", "Gamma", ["encrypt rest"])], REQUEST)
    got = {
        r["vendor_id"]: r["evidence"]
        for r in jobs.retrieve_evidence(requests, chunks, "vector", 2, model).collect()
    }
    assert [e["source"] for e in got["1"]] == ["acme_contract.txt"] * 2
    assert got["1"][0]["clause_type"] == "payment"
    assert got["2"][0]["source"] == "beta_contract.txt" and len(got["2"]) == 2
    with pytest.raises(ValueError):
        jobs.retrieve_evidence(requests, chunks, "vector")


def test_contract_file_filter(spark):
    entries = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(i).alias("n")) for i, s in enumerate("aba")])
    df = spark.createDataFrame([("a",), ("z",)], "file string")
    got = df.select(retrieval.keep_contract_file(entries, F.col("file")).alias("kept")).collect()
    assert [[e["n"] for e in r["kept"]] for r in got] == [[0, 2], [0, 1, 2]]


EVIDENCE = "vendor_name string, top_risk_factors array<string>, evidence array<struct<text:string,clause_type:string,source:string>>"


def test_groups_and_explanation(spark):
    df = spark.createDataFrame(
        [
            ("Acme", ["f1", "f2"], [("t1", "sla", "b"), ("x" * 200, "payment", "a"), ("t3", "sla", "a")]),
            ("Beta", ["f1"], []),
            ("Gamma", [], []),
            ("Delta", [], [("t", "general", "d")]),
        ],
        EVIDENCE,
    )
    groups = df.select(evidence.evidence_groups(F.col("evidence")).alias("g")).first()["g"]
    assert [(g["clause_type"], g["text"][:2], g["sources"]) for g in groups] == [
        ("sla", "t1", ["a", "b"]),
        ("payment", "xx", ["a"]),
    ]
    texts = [
        r[0]
        for r in df.select(
            evidence.explanation(F.col("vendor_name"), F.col("top_risk_factors"), F.col("evidence"))
        ).collect()
    ]
    assert texts == [
        "For Acme, retrieved contract evidence was compared against: f1; f2. sla: t1 Source: a, b. payment: "
        + "x" * 177
        + "... Source: a.",
        "No contract clauses were retrieved for Beta. Review f1 manually.",
        "No contract clauses were retrieved for Gamma. Review the supplied risk factors manually.",
        "For Delta, retrieved contract evidence was compared against: the vendor risk factors. general: t Source: d.",
    ]


def test_chunk_table_feeds_name_pairs(spark):
    chunks = contract_ops.clause_chunks(contracts(spark, ("acme_contract.txt", SHORT)))
    asked = spark.createDataFrame([("ACME inc",), ("ac",), ("z",)], "vendor_name string")
    pairs = retrieval.vendor_name_pairs(asked, chunks).collect()
    assert sorted(r["requested"] for r in pairs) == ["ACME inc", "ac"]


def test_search_needs_no_package_on_the_workers(tmp_path):
    """Workers start elsewhere: the function sent to them must not import this package."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from procurisk.session import build_session\n"
        "from procurisk.operators import retrieval\n"
        "spark = build_session('local[2]', 2)\n"
        "items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], 'item_id long, vector array<float>')\n"
        "print(retrieval.inner_product_top_k(items.withColumnRenamed('item_id', 'query_id'), items, 1).count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "2", done.stderr[-2000:]


def test_unasked_scopes_null_and_nan_vectors(spark):
    """One asked scope among 500: the others never reach a search task, and odd vectors do not end the search."""
    unasked = spark.range(2000).select(
        F.concat(F.lit("s"), F.col("id") % 500).alias("scope"), F.col("id").alias("item_id"), F.array(F.lit(1.0)).alias("vector")
    )
    asked = spark.createDataFrame(
        [("mine", 5000, [0.5]), ("mine", 5001, [2.0]), ("mine", 5002, [float("nan")]), ("mine", 5003, None)],
        "scope string, item_id long, vector array<double>",
    )
    queries = spark.createDataFrame([("q", "mine", [1.0])], "query_id string, scope string, vector array<double>")
    found = retrieval.top_k_within_scopes(queries, unasked.unionByName(asked.select(*unasked.columns)), 3)
    rows = {r["item_id"]: r["score"] for r in found.collect()}
    assert rows.pop(5002) != rows[5001] and rows == {5001: 2.0, 5000: 0.5}


def test_searches_over_everything_meet_few_blocks(spark, monkeypatch):
    """Clauses of many names, one each: a vendor without clauses must not meet a block for every name."""
    sizes = []
    build = retrieval.vector_index.build_index

    def built(*args, **kwargs):
        index = build(*args, **kwargs)
        sizes.append(index.summaries.count())
        return index

    monkeypatch.setattr(retrieval.vector_index, "build_index", built)
    random = np.random.default_rng(3)
    matrix = random.normal(size=(60, 4))
    clauses = vectors(spark, matrix, "chunk_id").withColumn("vendor_name", F.concat(F.lit("name "), F.format_string("%03d", "chunk_id")))
    asked = spark.createDataFrame([("a", "other", [1.0, 0.0, 0.0, 0.0])], "vendor_id string, vendor_name string, vector array<double>")
    got = retrieval.vendor_preferred_top_k(asked, clauses, 3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == np.argsort(-matrix[:, 0])[:3].tolist()
    assert {r["scope"] for r in got} == {"all"} and sizes == [60, 1]


def test_first_places_with_ties():
    random = np.random.default_rng(5)
    for width, k in ((1, 3), (3, 3), (40, 5), (40, 1)):
        scores = random.integers(0, 6, size=(30, width)).astype(float)
        scores[scores == 0] = -np.inf
        row, place = retrieval.vector_index._first_places(scores, k)
        wanted = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        assert place.tolist() == wanted.ravel().tolist()
        assert row.tolist() == np.repeat(np.arange(30), wanted.shape[1]).tolist()


def test_stored_counts_give_the_same_vectors(spark):
    texts = spark.createDataFrame([(1, "Réseau A1 réseau, naïve"), (2, "x"), (3, ""), (4, "a1 réseau two")], "id long, text string")
    counted = retrieval.with_word_counts(texts, width=64)
    plain = retrieval.text_vectors(retrieval.fit_text_vectors(texts, width=64), texts, kind="float64")
    stored = retrieval.text_vectors(retrieval.fit_text_vectors(counted, width=64), counted, kind="float64")
    assert stored.columns == plain.columns and sorted(stored.collect()) == sorted(plain.collect())
