"""Clause retrieval for whole portfolios: by keyword, or by inner product of vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, CountVectorizerModel, IDFModel, Normalizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurisk.config import DEFAULT, DEFAULT_QUERY_TEXT, EXTRA_QUERY_TERMS, SECTION_CLAUSE_TYPE, SECTION_HEADINGS
from procurisk.functions.text import contract_vendor_name, query_terms, round_half_even, strip_ws
from procurisk.operators import vector_index
from procurisk.operators.containment import contains_or_is_contained
from procurisk.operators.contracts import match_contract_names, section_array
from procurisk.operators.skew import left_join_spread
from procurisk.operators.word_counts import word_counts
from procurisk.session import cut_lineage

VECTOR_WIDTH = 384


# --- keyword path ---------------------------------------------------------------------------------


def keyword_score(heading: Column, text: Column, terms: Column) -> Column:
    """Share of the terms that occur, as substrings, in heading and text; 0.1 without terms."""
    # as the item of an array the haystack is worked out once, not once a term
    haystack = F.array(F.lower(F.concat(heading, F.lit(" "), text)))
    hits = F.get(F.transform(haystack, lambda held: F.size(F.filter(terms, lambda term: F.contains(held, term)))), F.lit(0))
    share = hits.cast("double") / F.size(terms).cast("double")
    return F.when(F.size(terms) == 0, F.lit(0.1)).otherwise(round_half_even(share, 4))


def keyword_evidence(
    requests: DataFrame,
    contracts: DataFrame,
    k: int = DEFAULT.top_k,
    extra_terms: Sequence[str] = EXTRA_QUERY_TERMS,
    headings: Sequence[str] = SECTION_HEADINGS,
    types: Mapping[str, str] = SECTION_CLAUSE_TYPE,
    names: DataFrame | None = None,
) -> DataFrame:
    """The k best sections of each vendor's own contract as ``evidence`` (best first, file order on ties).

    ``requests`` has vendor_id, vendor_name and top_risk_factors. A vendor has at most one contract, so
    its sections are scored and ranked inside the row: the only joins are vendor to file name and file
    name to text. Vendors without a contract get an empty list. ``names`` (vendor_name) may bring the
    vendor names from a cheaper table than the requests.
    """
    matches = match_contract_names(requests if names is None else names, contracts)
    files = matches.select("vendor_name", F.col("contract_file").alias("_file"))
    texts = contracts.select(F.col("contract_file").alias("_file"), F.col("text").alias("_text"))
    named = left_join_spread(requests, files, "vendor_name", ["vendor_id"])
    found = left_join_spread(named, texts, "_file", ["vendor_id"])

    def best(row: Column) -> Column:
        def scored(section: Column, i: Column) -> Column:
            score = keyword_score(section["heading"], section["text"], row["terms"])
            return F.struct((-score).alias("order"), i.alias("section_no"), section.alias("section"))

        def shown(entry: Column) -> Column:
            heading, text = entry["section"]["heading"], entry["section"]["text"]
            return F.struct(
                F.when(heading == "general", text).otherwise(F.concat(heading, F.lit("\n"), text)).alias("text"),
                row["vendor"].alias("vendor_name"),
                entry["section"]["clause_type"].alias("clause_type"),
                F.col("_file").alias("source"),
                (-entry["order"]).alias("score"),
            )

        return F.transform(F.slice(F.array_sort(F.transform(row["sections"], scored)), 1, k), shown)

    # what all sections of a text share is worked out once, as the item of an array; named columns would be worked out for every section
    row = F.struct(
        query_terms(F.col("top_risk_factors"), extra_terms).alias("terms"),
        contract_vendor_name(F.col("_text"), F.col("_file")).alias("vendor"),
        section_array(F.col("_text"), headings, types).alias("sections"),
    )
    evidence = F.get(F.transform(F.array(row), best), F.lit(0))
    none = F.array().cast(EVIDENCE_TYPE)
    return found.select(*requests.columns, F.coalesce(evidence, none).alias("evidence"))


EVIDENCE_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("text", T.StringType()),
            T.StructField("vendor_name", T.StringType()),
            T.StructField("clause_type", T.StringType()),
            T.StructField("source", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
)


# --- vectors --------------------------------------------------------------------------------------


def _words(column: str) -> str:
    """The words of a text: runs of letters and digits of at least two characters, in lower case."""
    return f"filter(split(lower({column}), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> length(w) > 1)"


def _word_stages(column: str, width: int) -> list:
    """Stages that add ``_counts``, the words of each place.

    The place of a word in the vector is that of the first 28 bits of its MD5 digest modulo ``width``, which any engine can work out.
    """
    buckets = (
        f"transform({_words(column)}, "
        f"w -> CAST(CAST(conv(substr(md5(w), 1, 7), 16, 10) AS BIGINT) % {width} AS STRING))"
    )
    return [
        SQLTransformer(statement=f"SELECT *, {buckets} AS _words FROM __THIS__"),
        CountVectorizerModel.from_vocabulary(list(map(str, range(width))), inputCol="_words", outputCol="_counts"),
    ]


def with_word_counts(texts: DataFrame, column: str = "text", width: int = VECTOR_WIDTH) -> DataFrame:
    """The texts with ``_counts``: stored like this, their words are looked up once for the fit and the vectors.

    The counts are those of ``_word_stages``, worked out for whole batches of texts.
    """
    return texts.withColumn("_counts", word_counts(F.expr(_words(column)), width))


def fit_text_vectors(texts: DataFrame, column: str = "text", width: int = VECTOR_WIDTH) -> PipelineModel:
    """Hashed TF-IDF vectors of unit length, fitted on a text column (see ``_word_stages``) or on the counts of ``with_word_counts``."""
    words = _word_stages(column, width)
    weights = [
        IDF(inputCol="_counts", outputCol="_weights"),
        Normalizer(inputCol="_weights", outputCol="_unit", p=2.0),
    ]
    if "_counts" in texts.columns:
        return PipelineModel([*words, *Pipeline(stages=weights).fit(texts).stages])
    return Pipeline(stages=[*words, *weights]).fit(texts)


def text_vectors(model: PipelineModel, texts: DataFrame, output: str = "vector", kind: str = "float32") -> DataFrame:
    stages = [stage for stage in model.stages if "_counts" not in texts.columns or isinstance(stage, (IDFModel, Normalizer))]
    return (
        PipelineModel(stages)
        .transform(texts)
        .withColumn(output, vector_to_array(F.col("_unit"), kind))
        .drop("_words", "_counts", "_weights", "_unit")
    )


def top_k_within_scopes(
    queries: DataFrame,
    items: DataFrame,
    k: int = DEFAULT.top_k,
    items_per_block: int = vector_index.ITEMS_PER_BLOCK,
    queries_per_batch: int = vector_index.QUERIES_PER_BATCH,
) -> DataFrame:
    """The k items with the largest inner product for every query, over the items of the query's scopes.

    ``queries`` has (query_id, scope, vector), one row per scope the query looks at; ``items`` has
    (item_id, scope, vector). The items of the scopes that are asked for are indexed in blocks (see ``vector_index``); a block is
    read by those queries only that it may hold a result for. Rows without a vector take no part; a score that is not a number ranks last.
    """
    asked = items.join(queries.select("scope").distinct(), "scope", "left_semi")
    index = vector_index.build_index(asked, k, items_per_block)
    return vector_index.search(queries, index, k, queries_per_batch)


def inner_product_top_k(
    queries: DataFrame,
    items: DataFrame,
    k: int = DEFAULT.top_k,
    items_per_block: int = vector_index.ITEMS_PER_BLOCK,
    queries_per_batch: int = vector_index.QUERIES_PER_BATCH,
) -> DataFrame:
    """The same over all items: ``queries`` has (query_id, vector), ``items`` (item_id, vector)."""
    index = vector_index.build_index(items.select("item_id", F.lit("").alias("scope"), "vector"), k, items_per_block)
    return vector_index.search(queries, index, k, queries_per_batch, everywhere=True)


def vendor_name_pairs(requested: DataFrame, present: DataFrame) -> DataFrame:
    """Pairs of requested and present vendor names where one contains the other, case and ends ignored."""

    def plain(c: str) -> Column:
        return F.lower(strip_ws(F.col(c)))

    asked = requested.select(F.col("vendor_name").alias("requested"), plain("vendor_name").alias("asked")).distinct()
    held = present.select(F.col("vendor_name").alias("present"), plain("vendor_name").alias("held")).distinct()
    pairs = contains_or_is_contained(asked.select("asked"), held.select("held"))
    return pairs.join(asked, "asked").join(held, "held").select("requested", "present")


def vendor_preferred_top_k(
    queries: DataFrame,
    clauses: DataFrame,
    k: int = DEFAULT.top_k,
    items_per_block: int = vector_index.ITEMS_PER_BLOCK,
    queries_per_batch: int = vector_index.QUERIES_PER_BATCH,
) -> DataFrame:
    """The k best clauses of the vendor itself, or of all clauses where the vendor has none.

    ``queries`` has (vendor_id, vendor_name, vector), ``clauses`` (chunk_id, vendor_name, vector). A
    vendor looks at the clauses of every name that contains its own or is contained in it; only vendors
    without such clauses search everything. A blank name is contained in every name: such vendors look at all clauses that have one.
    Searches over everything have an index of their own, without scopes: its blocks are as many as the clauses fill, while the other
    has a block for every name, and each query would travel to each of them.
    """
    named = cut_lineage(queries.select(F.col("vendor_id").alias("query_id"), F.col("vendor_name").alias("requested"), "vector"))
    blank = F.coalesce(strip_ws(F.col("requested")) == "", F.lit(False))
    asked = named.where(~blank)
    pairs = cut_lineage(vendor_name_pairs(asked.withColumnRenamed("requested", "vendor_name"), clauses))
    items = clauses.select(F.col("chunk_id").alias("item_id"), F.col("vendor_name").alias("scope"), "vector")
    # both kinds of index take the items from one stored table, packed and told apart by cells
    ready = vector_index.celled_items(items, k)
    index = vector_index.build_index(ready, k, items_per_block)
    scoped = asked.join(pairs, "requested").select("query_id", F.col("present").alias("scope"), "vector")
    ranked = vector_index.search(scoped, index, k, queries_per_batch).withColumn("scope", F.lit("vendor"))
    without = left_join_spread(asked, pairs.select("requested", F.lit(1).alias("found")).distinct(), "requested", ["query_id"])
    for scope, some, pool in (
        ("all", without.where("found IS NULL"), None),
        ("vendor", named.where(blank), F.col("scope").isNotNull()),
    ):
        some = cut_lineage(some.select("query_id", "vector"))
        if not some.isEmpty():
            wide = (items_per_block * vector_index.WIDE_ITEMS, vector_index.BLOCK_BYTES * vector_index.WIDE_BYTES)
            found = vector_index.search(some, vector_index.build_index(ready.everywhere(pool), k, *wide), k, queries_per_batch, everywhere=True)
            ranked = ranked.unionByName(found.withColumn("scope", F.lit(scope)))
    return ranked.select(
        F.col("query_id").alias("vendor_id"),
        F.col("item_id").alias("chunk_id"),
        round_half_even(F.col("score"), 4).alias("score"),
        "rank",
        "scope",
    )


def attach_clauses(hits: DataFrame, clauses: DataFrame) -> DataFrame:
    """The clause record of every hit."""
    return hits.join(clauses.drop("vector"), "chunk_id")


def evidence_lists(hits: DataFrame) -> DataFrame:
    """Hits with their clause columns -> one ``evidence`` list per vendor, best first (at most k entries)."""
    entry = F.struct("rank", "text", "vendor_name", "clause_type", "source", "score")
    ordered = F.array_sort(F.collect_list(entry))
    return hits.groupBy("vendor_id").agg(
        F.transform(
            ordered,
            lambda e: F.struct(
                e["text"].alias("text"),
                e["vendor_name"].alias("vendor_name"),
                e["clause_type"].alias("clause_type"),
                e["source"].alias("source"),
                e["score"].alias("score"),
            ),
        ).alias("evidence")
    )


def vector_evidence(
    requests: DataFrame, chunks: DataFrame, model: PipelineModel, k: int = DEFAULT.top_k
) -> DataFrame:
    """Evidence by text vectors; the query is the vendor name and the joined factors.

    ``chunks`` is the numbered chunk table with vectors. ``requests`` should be stored or checkpointed:
    it is read for the queries and again for the result.
    """
    factors = F.array_join("top_risk_factors", " ")
    query = F.concat_ws(
        " ",
        F.coalesce(F.col("vendor_name"), F.col("vendor_id")),
        F.when(factors == "", F.lit(DEFAULT_QUERY_TEXT)).otherwise(factors),
    )
    # rows without factors are ids that nobody knows
    asking = requests.where(F.col("top_risk_factors").isNotNull())
    queries = text_vectors(model, asking.select("vendor_id", "vendor_name", query.alias("text"))).drop("text")
    hits = vendor_preferred_top_k(queries, chunks, k)
    lists = evidence_lists(attach_clauses(hits, chunks))
    none = F.array().cast(EVIDENCE_TYPE)
    return requests.join(lists, "vendor_id", "left").withColumn("evidence", F.coalesce("evidence", none))


def keep_contract_file(evidence: Column, contract_file: Column) -> Column:
    """The entries of one contract file when there are any, else all entries."""
    own = F.filter(evidence, lambda e: e["source"] == contract_file)
    return F.when(F.size(own) > 0, own).otherwise(evidence)
