"""The registered queries: every operator over the role views of a data folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procurisk.config import DEFAULT, DRIFT_THRESHOLDS, EXTRA_QUERY_TERMS, MODEL_TARGET
from procurisk.functions import risk
from procurisk.functions.text import query_terms
from procurisk.operators import contracts as contract_ops
from procurisk.operators import drift, evidence, features, portfolio, quality, ranks, retrieval, scoring, training
from procurisk.plans import jobs
from procurisk.session import cut_lineage, ensure_checkpoint_dir
from procurisk.sources import feature_store, roles, sinks
from procurisk.sources.schemas import INVOICES, TICKETS, VENDORS

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def _query(function: Query) -> Query:
    _REGISTRY[function.__name__.lstrip("_")] = function
    return function


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


# --- shared inputs --------------------------------------------------------------------------------


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        VENDORS: roles.raw_vendors(spark, sf_dir),
        INVOICES: roles.raw_invoices(spark, sf_dir),
        TICKETS: roles.raw_tickets(spark, sf_dir),
    }


def built_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features from the raw tables."""
    return features.vendor_features(
        roles.vendors(spark, sf_dir),
        roles.invoices_portfolio(spark, sf_dir),
        roles.tickets(spark, sf_dir),
        roles.REFERENCE_DATE,
    )


#: what a session has stored for a data folder: written once, read by the queries that come after
_STORES: dict[tuple[str, str], feature_store.FeatureStore] = {}


def portfolio_store(spark: SparkSession, sf_dir: str) -> feature_store.FeatureStore:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/features-{uuid.uuid4().hex}"
        tables = (roles.vendors(spark, sf_dir), roles.invoices_portfolio(spark, sf_dir), roles.tickets(spark, sf_dir))
        _STORES[key] = feature_store.write_store(*tables, roles.REFERENCE_DATE, folder)
    return _STORES[key]


def portfolio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored features."""
    return portfolio_store(spark, sf_dir).features


def _plain(df: DataFrame) -> DataFrame:
    """Money as doubles, days as ISO text, lists as joined text: values every engine shows alike."""
    columns = []
    for field in df.schema.fields:
        column, kind = F.col(field.name), field.dataType.simpleString()
        if kind.startswith("decimal"):
            column = column.cast("double")
        elif kind == "date":
            column = column.cast("string")
        elif kind == "array<string>":
            column = F.array_join(column, "; ")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def _issues_plain(df: DataFrame) -> DataFrame:
    return df.select(
        "dataset", "severity", F.coalesce("field", F.lit("")).alias("field"), "message", "affected_rows"
    )


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.score_portfolio_rules(portfolio_features(spark, sf_dir))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scored row for every contract text; the scores are stored, since ids, names and rows are read apart."""
    return roles.contract_requests(cut_lineage(_scored(spark, sf_dir)), spark, sf_dir)


def _analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _requests(spark, sf_dir)
    # ids of tickets too: some of them nobody knows
    requested = roles.tickets(spark, sf_dir).select("vendor_id").unionByName(requests.select("vendor_id"))
    return jobs.analyze_portfolio(requests, roles.contracts(spark, sf_dir), requested)


# --- data quality ---------------------------------------------------------------------------------


@_query
def dq_vendors(spark, sf_dir):
    return _issues_plain(quality.vendor_issues(roles.raw_vendors(spark, sf_dir)))


@_query
def dq_invoices(spark, sf_dir):
    tables = raw_tables(spark, sf_dir)
    return _issues_plain(quality.invoice_issues(tables[INVOICES], tables[VENDORS]))


@_query
def dq_tickets(spark, sf_dir):
    tables = raw_tables(spark, sf_dir)
    return _issues_plain(quality.ticket_issues(tables[TICKETS], tables[VENDORS]))


@_query
def dq_report(spark, sf_dir):
    report = jobs.validate(raw_tables(spark, sf_dir))

    def listed(name):
        return F.array_join(
            F.transform(name, lambda i: F.concat(i["message"], F.lit(" ("), i["affected_rows"].cast("string"), F.lit(")"))),
            "; ",
        ).alias(name)

    shape = F.map_entries("datasets")
    return report.select(
        F.col("passed").cast("int").alias("passed"),
        listed("errors"),
        listed("warnings"),
        F.array_join(
            F.transform(
                F.array_sort(F.transform(shape, lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))),
                lambda e: F.concat_ws(":", e["k"], e["v"]["rows"].cast("string"), e["v"]["columns"].cast("string")),
            ),
            "; ",
        ).alias("datasets"),
        "error_count",
        "warning_count",
        "duplicate_invoice_rows",
    )


@_query
def dq_missing_columns(spark, sf_dir):
    """Tables that lack columns: one issue each, and no other check."""
    gone = {VENDORS: ["contract_end", "criticality"], INVOICES: ["po_match", "amount"], TICKETS: ["severity"]}
    return _issues_plain(quality.issues({name: df.drop(*gone[name]) for name, df in raw_tables(spark, sf_dir).items()}))


@_query
def dq_empty(spark, sf_dir):
    """Invoices and tickets of a vendor that has none."""
    tables = raw_tables(spark, sf_dir)
    for name in (INVOICES, TICKETS):
        tables[name] = tables[name].where("vendor_id = 'nobody'")
    return _issues_plain(quality.issues(tables))


@_query
def dq_unknown_vendors(spark, sf_dir):
    return quality.unknown_vendor_rows(roles.tickets(spark, sf_dir), roles.vendors(spark, sf_dir))


@_query
def dq_duplicates(spark, sf_dir):
    return _plain(quality.duplicate_groups(roles.invoices_by_quantity(spark, sf_dir)))


@_query
def dataset_shapes(spark, sf_dir):
    return quality.dataset_shapes(raw_tables(spark, sf_dir))


# --- features -------------------------------------------------------------------------------------


@_query
def invoice_features(spark, sf_dir):
    return _plain(features.invoice_features(roles.invoices_all(spark, sf_dir)))


@_query
def ticket_features(spark, sf_dir):
    return _plain(features.ticket_features(roles.tickets(spark, sf_dir)))


@_query
def duplicate_flags(spark, sf_dir):
    flagged = features.duplicate_flags(roles.invoices_by_quantity(spark, sf_dir))
    return _plain(
        flagged.select(
            "invoice_id",
            "vendor_id",
            "invoice_date",
            "amount",
            F.col("duplicate_invoice_flag").cast("int").alias("duplicate_invoice_flag"),
        )
    )


@_query
def vendor_features(spark, sf_dir):
    return _plain(built_features(spark, sf_dir)).withColumn(
        "missing_compliance", F.col("missing_compliance").cast("int")
    )


@_query
def vendor_features_all(spark, sf_dir):
    """The features over all invoices, the heaviest input."""
    table = features.vendor_features(
        roles.vendors(spark, sf_dir),
        roles.invoices_by_quantity(spark, sf_dir),
        roles.tickets(spark, sf_dir),
        roles.REFERENCE_DATE,
    )
    return _plain(table).withColumn("missing_compliance", F.col("missing_compliance").cast("int"))


# --- scores ---------------------------------------------------------------------------------------


@_query
def rule_scores(spark, sf_dir):
    return portfolio_features(spark, sf_dir).select(
        "vendor_id",
        "risk_score_rule",
        "risk_level_rule",
        risk.level(F.col("risk_score_rule") / 100.0, DEFAULT.probability_bands).alias("portfolio_risk_level"),
        risk.additive_score().alias("additive_score"),
        risk.level(risk.additive_score(), DEFAULT.additive_bands).alias("additive_level"),
        "high_risk_vendor",
    )


@_query
def risk_factors(spark, sf_dir):
    return portfolio_features(spark, sf_dir).select(
        "vendor_id",
        F.array_join(risk.model_factors(), "; ").alias("model_factors"),
        F.array_join(risk.rule_factors(), "; ").alias("rule_factors"),
        F.array_join(F.array_sort(query_terms(risk.rule_factors(), EXTRA_QUERY_TERMS)), " ").alias("query_terms"),
    )


@_query
def vendor_exposure(spark, sf_dir):
    return _scored(spark, sf_dir).select(
        "vendor_id", "risk_level", "estimated_financial_exposure", risk.duplicate_exposure().alias("duplicate_exposure")
    )


@_query
def exposure_capped(spark, sf_dir):
    return portfolio_features(spark, sf_dir).select("vendor_id", risk.exposure_capped().alias("capped_exposure"))


@_query
def actions(spark, sf_dir):
    fallback = jobs.score_portfolio_model(portfolio_features(spark, sf_dir))
    return fallback.select(
        "vendor_id",
        "model_name",
        "risk_score",
        "risk_level",
        F.col("recommended_action").alias("scorer_action"),
        risk.workflow_action(F.col("risk_level")).alias("workflow_action"),
        F.col("human_review_required").cast("int").alias("human_review_required"),
        "estimated_financial_exposure",
    )


@_query
def score_normalization(spark, sf_dir):
    rows = portfolio_features(spark, sf_dir).select(
        "vendor_id", ((F.col("risk_score_rule") - 50.0) / 10.0).alias("decision")
    )
    return scoring.min_max(rows, "decision", "scaled").select(
        "vendor_id",
        F.round(scoring.logistic(F.col("decision")), 6).alias("logistic"),
        F.round("scaled", 6).alias("scaled"),
    )


# --- portfolio ------------------------------------------------------------------------------------


@_query
def review_queue(spark, sf_dir):
    queue = portfolio.review_queue(portfolio_features(spark, sf_dir))
    return _plain(ranks.with_positions(queue, portfolio.review_order())).orderBy("position")


@_query
def portfolio_summary(spark, sf_dir):
    return jobs.portfolio_summary(portfolio_features(spark, sf_dir))


@_query
def portfolio_summary_additive(spark, sf_dir):
    return jobs.portfolio_summary(portfolio_features(spark, sf_dir), "additive")


@_query
def spend_by_category(spark, sf_dir):
    return portfolio.spend_by_category(portfolio_features(spark, sf_dir))


@_query
def risk_distribution(spark, sf_dir):
    return portfolio.risk_distribution(portfolio_features(spark, sf_dir))


@_query
def compliance_distribution(spark, sf_dir):
    return portfolio.compliance_distribution(portfolio_features(spark, sf_dir))


@_query
def preventable_exposure(spark, sf_dir):
    return portfolio.preventable_exposure(portfolio_features(spark, sf_dir))


def _top(measure, spark, sf_dir):
    return _plain(portfolio.top_vendors(portfolio_features(spark, sf_dir), measure))


_REGISTRY["top_sla"] = partial(_top, "sla_breach_count")
_REGISTRY["top_pending"] = partial(_top, "pending_invoice_amount")
_REGISTRY["top_duplicates"] = partial(_top, "duplicate_invoice_count")


@_query
def renewal_timeline(spark, sf_dir):
    timeline = portfolio.renewal_timeline(portfolio_features(spark, sf_dir))
    return _plain(ranks.with_positions(timeline, portfolio.RENEWAL_ORDER)).orderBy("position")


@_query
def roi_grid(spark, sf_dir):
    return portfolio.roi_grid(portfolio_features(spark, sf_dir))


@_query
def vendor_list(spark, sf_dir):
    return portfolio.vendor_list(portfolio_features(spark, sf_dir))


@_query
def vendor_lookup(spark, sf_dir):
    requested = roles.tickets(spark, sf_dir).select("vendor_id")
    names = portfolio_features(spark, sf_dir).select("vendor_id", "vendor_name")
    found = scoring.look_up_vendors(names, requested)
    return found.select(
        "vendor_id",
        F.col("exists").cast("int").alias("is_known"),
        F.coalesce("vendor_name", F.lit("")).alias("vendor_name"),
        F.when(F.col("exists"), "")
        .otherwise(F.concat(F.lit("Unknown vendor_id: "), F.col("vendor_id")))
        .alias("error"),
    )


# --- contracts ------------------------------------------------------------------------------------


@_query
def clause_sections(spark, sf_dir):
    return contract_ops.clause_sections(roles.contracts(spark, sf_dir))


@_query
def clause_chunks(spark, sf_dir):
    chunks = contract_ops.clause_chunks(roles.contracts(spark, sf_dir))
    return chunks.select("contract_file", "chunk_no", "text", "vendor_name", "clause_type", "source")


@_query
def chunk_numbers(spark, sf_dir):
    chunks = contract_ops.clause_chunks(roles.contracts(spark, sf_dir)).select("contract_file", "chunk_no")
    return contract_ops.number_chunks(cut_lineage(chunks))


@_query
def clause_types(spark, sf_dir):
    chunks = contract_ops.clause_chunks(roles.contracts(spark, sf_dir))
    return chunks.groupBy("clause_type").agg(
        F.count("*").alias("chunks"), F.sum(F.length("text")).alias("characters")
    )


@_query
def clause_types_by_words(spark, sf_dir):
    """The same texts with a keyword list of frequent words, so that the list path decides."""
    words = {"payment": ("tion",), "sla": ("ung", "sch"), "compliance": ("ció",), "renewal": ("eau",)}
    chunks = contract_ops.clause_chunks(roles.contracts(spark, sf_dir), words)
    return chunks.groupBy("clause_type").agg(F.count("*").alias("chunks"))


@_query
def chunk_metadata(spark, sf_dir):
    return sinks.chunk_metadata(contract_ops.clause_chunks(roles.contracts(spark, sf_dir)), None)


@_query
def contract_match(spark, sf_dir):
    vendors = roles.vendors(spark, sf_dir).select("vendor_id", "vendor_name")
    matches = contract_ops.match_contract_files(vendors, roles.contracts(spark, sf_dir))
    return matches.withColumn("contract_file", F.coalesce("contract_file", F.lit("")))


@_query
def vendor_name_pairs(spark, sf_dir):
    return retrieval.vendor_name_pairs(roles.vector_queries(spark, sf_dir), roles.clause_vectors(spark, sf_dir))


# --- retrieval ------------------------------------------------------------------------------------


@_query
def keyword_topk(spark, sf_dir):
    requests = _requests(spark, sf_dir).select("vendor_id", "vendor_name", "top_risk_factors")
    found = jobs.retrieve_evidence(requests, roles.contracts(spark, sf_dir))
    # the outer form: an inner one works the evidence out once more, in a filter
    ranked = found.select("vendor_id", F.posexplode_outer("evidence").alias("rank", "e")).where(F.col("rank").isNotNull())
    return ranked.select(
        "vendor_id",
        (F.col("rank") + 1).alias("rank"),
        "e.text",
        "e.vendor_name",
        "e.clause_type",
        "e.source",
        "e.score",
    )


@_query
def vector_topk(spark, sf_dir):
    queries = roles.vector_queries(spark, sf_dir).select(F.col("vendor_id").alias("query_id"), "vector")
    items = roles.clause_vectors(spark, sf_dir).select(F.col("chunk_id").alias("item_id"), "vector")
    return retrieval.inner_product_top_k(queries, items).withColumn("score", F.round("score", 4))


@_query
def vendor_preferred_topk(spark, sf_dir):
    hits = retrieval.vendor_preferred_top_k(
        roles.vector_queries(spark, sf_dir), roles.clause_vectors(spark, sf_dir)
    )
    return retrieval.attach_clauses(hits, roles.clause_vectors(spark, sf_dir)).select(
        "vendor_id", "rank", "chunk_id", "vendor_name", "source", "scope", "score"
    )


@_query
def evidence_filter(spark, sf_dir):
    clauses = roles.clause_vectors(spark, sf_dir).withColumns(
        {"text": F.concat(F.lit("clause "), F.col("chunk_id").cast("string")), "clause_type": F.lit("general")}
    )
    queries = roles.vector_queries(spark, sf_dir)
    hits = retrieval.vendor_preferred_top_k(queries, clauses, DEFAULT.evidence_top_k)
    lists = retrieval.evidence_lists(retrieval.attach_clauses(hits, clauses))
    wanted = F.concat(F.lit("file_"), (F.col("vendor_id").cast("int") % 4).cast("string"))
    kept = lists.select("vendor_id", retrieval.keep_contract_file(F.col("evidence"), wanted).alias("kept"))
    return kept.select("vendor_id", F.explode("kept").alias("e")).select("vendor_id", "e.source", "e.text", "e.score")


@_query
def text_vectors(spark, sf_dir):
    """The vectors as text: place and weight in millionths of every word place that is not empty."""
    chunks = contract_ops.clause_chunks(roles.contracts(spark, sf_dir)).select("contract_file", "chunk_no", "text")
    chunks = cut_lineage(retrieval.with_word_counts(chunks).drop("text"))
    vectors = retrieval.text_vectors(retrieval.fit_text_vectors(chunks), chunks, kind="float64")
    places = F.transform("vector", lambda x, i: F.struct(i.alias("i"), F.floor(x * 1e6 + 0.5).alias("x")))
    shown = F.transform(
        F.filter(places, lambda p: p["x"] > 0), lambda p: F.concat_ws(":", p["i"].cast("string"), p["x"].cast("string"))
    )
    return vectors.select("contract_file", "chunk_no", F.array_join(shown, " ").alias("weights"))


@_query
def text_topk(spark, sf_dir):
    """Clauses by text vectors: name and factors of every vendor against the chunks of all contract texts."""
    chunks = cut_lineage(retrieval.with_word_counts(jobs.numbered_chunks(roles.contracts(spark, sf_dir))).drop("text"))
    model = retrieval.fit_text_vectors(chunks)
    stored = cut_lineage(retrieval.text_vectors(model, chunks, kind="float64"))
    # every 25th vendor asks under a name that no contract has: it searches everything
    number = F.col("vendor_id").cast("bigint")
    name = F.when(number % 25 == 0, F.concat(F.lit("Unlisted "), "vendor_id")).otherwise(F.col("vendor_name"))
    requests = _scored(spark, sf_dir).select("vendor_id", name.alias("vendor_name"), "top_risk_factors")
    text = F.concat_ws(" ", "vendor_name", F.array_join("top_risk_factors", " "))
    asked = cut_lineage(requests.select("vendor_id", "vendor_name", text.alias("text")))
    queries = retrieval.text_vectors(model, asked, kind="float64").drop("text")
    hits = retrieval.vendor_preferred_top_k(queries, stored)
    return retrieval.attach_clauses(hits, stored).select(
        "vendor_id", "rank", "chunk_id", "source", "clause_type", "scope", "score"
    )


# --- analysis -------------------------------------------------------------------------------------


@_query
def evidence_groups(spark, sf_dir):
    requests = _requests(spark, sf_dir).select("vendor_id", "vendor_name", "top_risk_factors")
    # twelve clauses, so that several share a type
    found = jobs.retrieve_evidence(requests, roles.contracts(spark, sf_dir), k=12)
    groups = found.select(
        "vendor_id", F.posexplode_outer(evidence.evidence_groups(F.col("evidence"))).alias("group_no", "g")
    )
    return groups.where(F.col("group_no").isNotNull()).select(
        "vendor_id",
        "group_no",
        "g.clause_type",
        "g.text",
        F.array_join("g.sources", ", ").alias("sources"),
    )


@_query
def explanations(spark, sf_dir):
    return _analysis(spark, sf_dir).where(F.size("errors") == 0).select("vendor_id", "explanation")


@_query
def payloads(spark, sf_dir):
    rows = _analysis(spark, sf_dir).where(F.size("errors") == 0).select("automation_payload.*")
    return _plain(rows).withColumn("human_review_required", F.col("human_review_required").cast("int"))


@_query
def analysis(spark, sf_dir):
    rows = _analysis(spark, sf_dir)

    def text(c):
        return F.coalesce(c, F.lit(""))

    found = F.col("retrieved_contract_evidence")
    return rows.select(
        "vendor_id",
        text(F.col("vendor_name")).alias("vendor_name"),
        F.coalesce("risk_score", F.lit(-1.0)).alias("risk_score"),
        text(F.col("risk_level")).alias("risk_level"),
        text(F.array_join("top_risk_factors", "; ")).alias("top_risk_factors"),
        text(F.array_join(F.transform(found, lambda e: e["text"]), " | ")).alias("evidence_texts"),
        text(F.col("recommended_action")).alias("recommended_action"),
        F.coalesce("estimated_financial_exposure", F.lit(-1.0)).alias("estimated_financial_exposure"),
        F.coalesce(F.col("human_review_required").cast("int"), F.lit(-1)).alias("human_review_required"),
        text(F.col("response_payload.event_type")).alias("event_type"),
        text(F.col("response_payload.owner")).alias("owner"),
        F.array_join("errors", "; ").alias("errors"),
    )


@_query
def routed_reviews(spark, sf_dir):
    return jobs.route_reviews(_analysis(spark, sf_dir))


# --- models and drift -----------------------------------------------------------------------------


@_query
def training_baseline(spark, sf_dir):
    return training.training_baseline(portfolio_features(spark, sf_dir))


@_query
def drift_report(spark, sf_dir):
    """The recent portfolio against a baseline over all invoices."""
    baseline = features.vendor_features(
        roles.vendors(spark, sf_dir),
        roles.invoices_by_quantity(spark, sf_dir),
        roles.tickets(spark, sf_dir),
        roles.REFERENCE_DATE,
    )
    report = drift.drift_report(portfolio_features(spark, sf_dir), drift.metric_means(baseline))
    return report.withColumn("drift_detected", F.col("drift_detected").cast("int"))


@_query
def drift_overall(spark, sf_dir):
    # one metric falls out of the baseline: it counts as 0 there
    current = cut_lineage(portfolio_features(spark, sf_dir).select(*DRIFT_THRESHOLDS))
    baseline = drift.metric_means(current, {m: t for m, t in DRIFT_THRESHOLDS.items() if m != "sla_breach_rate"})
    overall = drift.overall_drift(drift.drift_report(current, baseline))
    return overall.withColumn("drift_detected", F.col("drift_detected").cast("int"))


@_query
def split_counts(spark, sf_dir):
    rows = training.with_split(cut_lineage(training.model_input(portfolio_features(spark, sf_dir))))
    return rows.groupBy(F.col("is_test").cast("int").alias("is_test"), MODEL_TARGET).agg(F.count("*").alias("n"))


@_query
def split_rows(spark, sf_dir):
    rows = training.with_split(cut_lineage(training.model_input(portfolio_features(spark, sf_dir))))
    return rows.select("vendor_id", F.col("is_test").cast("int").alias("is_test"))


@_query
def model_inputs(spark, sf_dir):
    return training.model_input(portfolio_features(spark, sf_dir))


@_query
def class_weights(spark, sf_dir):
    return training.class_weights(training.model_input(portfolio_features(spark, sf_dir)))


def _rule_predictions(spark, sf_dir):
    """The rule score as a classifier of the label."""
    rows = portfolio_features(spark, sf_dir)
    return rows.select(
        "vendor_id",
        F.col(MODEL_TARGET).alias("label"),
        (F.col("risk_score_rule") / 100.0).alias("score"),
        (F.col("risk_score_rule") >= DEFAULT.points_bands.medium).cast("int").alias("prediction"),
    )


@_query
def confusion_matrix(spark, sf_dir):
    return training.confusion_matrix(_rule_predictions(spark, sf_dir), "label")


@_query
def classifier_metrics(spark, sf_dir):
    return training.classifier_metrics(_rule_predictions(spark, sf_dir), "label")


@_query
def class_report(spark, sf_dir):
    return training.class_report(_rule_predictions(spark, sf_dir), "label")


@_query
def auc_histogram(spark, sf_dir):
    histogram = training.score_histogram(_rule_predictions(spark, sf_dir), "label", "score")
    return training.roc_auc(histogram)


#: the models of a session and data folder, fitted once: stored tables and small fitted objects
_TRAINED: dict[tuple[str, str], tuple[DataFrame, training.Trained]] = {}


def _trained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, training.Trained]:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TRAINED:
        table = cut_lineage(portfolio_features(spark, sf_dir))
        _TRAINED[key] = table, training.train_and_compare(spark, table)
    return _TRAINED[key]


@_query
def model_compare(spark, sf_dir):
    return _trained(spark, sf_dir)[1].results.drop("parameters")


@_query
def model_checks(spark, sf_dir):
    """What must hold for any fitted models: counts of rows and of rows that break a rule."""
    table, trained = _trained(spark, sf_dir)
    scored = jobs.score_portfolio_model(table, trained.models[trained.champion], trained.champion)
    logistic = training.predict(trained.models["LogisticRegression"], table)
    apart = F.abs(training.logistic_probability(trained.models["LogisticRegression"]) - F.col("probability_1"))
    other_level = F.when(F.col("risk_score") >= 0.75, "High").when(F.col("risk_score") >= 0.45, "Medium").otherwise("Low")
    rules = scored.agg(
        F.count("*").alias("scored"),
        F.count_if(~F.col("risk_score").between(0.0, 1.0)).alias("out_of_range"),
        F.count_if(F.col("risk_level") != other_level).alias("wrong_level"),
        F.count_if(F.size("top_risk_factors") == 0).alias("without_factor"),
    )
    apart_rows = logistic.agg(F.count_if(~(apart < 1e-9)).alias("logistic_apart"))
    best = F.max(F.struct("f1", "accuracy", -F.col("position"))) == F.max(
        F.when(F.col("model_name") == trained.champion, F.struct("f1", "accuracy", -F.col("position")))
    )
    lines = trained.results.agg(
        F.min(F.col("train_size") + F.col("test_size")).alias("split_rows"),
        F.count("*").alias("models"),
        best.cast("int").alias("champion_is_best"),
        F.count_if(~F.least("accuracy", "precision", "recall", "f1", "roc_auc").between(0.0, 1.0)).alias("odd_metrics"),
    )
    inputs = training.with_split(training.model_input(table)).where(~F.col("is_test"))
    weighted = inputs.join(F.broadcast(training.class_weights(inputs).select(MODEL_TARGET, "weight")), MODEL_TARGET)  # two rows
    slopes = training.logistic_gradient(trained.models["LogisticRegression"], weighted)
    steep = slopes.agg(F.count_if(~(F.abs("gradient") <= 1e-5 * F.col("scale"))).alias("not_optimal"))
    # four tables of one row
    one = rules.join(apart_rows, F.lit(True)).join(lines, F.lit(True))
    return one.join(steep, F.lit(True))


@_query
def logistic_scores(spark, sf_dir):
    """The probabilities of the fitted logistic model, for every vendor."""
    table, trained = _trained(spark, sf_dir)
    scored = training.predict(trained.models["LogisticRegression"], table)
    return scored.select("vendor_id", F.round("probability_1", 4).alias("score"))


@_query
def forest_scores(spark, sf_dir):
    """The probabilities of the forest by descent joins through its table of nodes, for every vendor."""
    table, trained = _trained(spark, sf_dir)
    scored = trained.models["RandomForestClassifier"].probabilities(table, "vendor_id")
    return scored.select("vendor_id", F.round("probability_1", 4).alias("score"))


@_query
def forest_nodes(spark, sf_dir):
    """The forest itself."""
    nodes = _trained(spark, sf_dir)[1].models["RandomForestClassifier"].nodes
    threshold = F.coalesce(F.round("threshold", 4), F.lit(-1.0)).alias("threshold")
    weights = [F.round(c, 4).alias(c) for c in ("weight_0", "weight_1")]
    return nodes.select("tree", "node", F.coalesce("feature", F.lit("")).alias("feature"), threshold, *weights)


@_query
def model_scores(spark, sf_dir):
    table, trained = _trained(spark, sf_dir)
    scored = jobs.score_portfolio_model(table, trained.models[trained.champion], trained.champion)
    return _plain(
        scored.select(
            "vendor_id",
            "model_name",
            "risk_score",
            "risk_level",
            "top_risk_factors",
            "recommended_action",
            "estimated_financial_exposure",
        )
    )
