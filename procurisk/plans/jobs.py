"""Whole jobs over a portfolio, composed from the operators."""

from __future__ import annotations

import datetime
from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurisk.config import DEFAULT, MODEL_FEATURES, MODEL_TARGET, RiskConfig
from procurisk.functions import risk
from procurisk.operators import contracts as contract_ops
from procurisk.operators import drift, evidence, features, portfolio, quality, retrieval, scoring, training
from procurisk.session import cut_lineage
from procurisk.sources import readers, sinks
from procurisk.sources.schemas import INVOICES, TICKETS, VENDORS, typed


def validate(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The data-quality report of the raw tables, one row."""
    return quality.report(tables)


def build_features(
    tables: Mapping[str, DataFrame], reference_date: datetime.date, config: RiskConfig = DEFAULT
) -> DataFrame:
    """Gate the raw tables, then build the vendor features."""
    quality.gate(tables)
    return features.vendor_features(
        typed(tables[VENDORS]), typed(tables[INVOICES]), typed(tables[TICKETS]), reference_date, config
    )


def load_features(
    spark: SparkSession, path: str, raw_folder: str, reference_date: datetime.date
) -> DataFrame:
    """The stored feature table; built from the raw folder and stored when there is none."""
    return readers.load_or_build(
        spark, path, lambda: build_features(readers.read_raw_tables(spark, raw_folder), reference_date)
    )


def score_portfolio_rules(vendor_features: DataFrame, config: RiskConfig = DEFAULT) -> DataFrame:
    return scoring.score_by_rules(vendor_features, config)


def score_portfolio_model(
    vendor_features: DataFrame,
    model: PipelineModel | None = None,
    model_name: str = "unknown",
    config: RiskConfig = DEFAULT,
) -> DataFrame:
    """Score by the classifier; by the rule score when there is no model."""
    if model is None:
        return scoring.score_by_rule_points(vendor_features, config)
    predictions = training.predict(model, vendor_features)
    return scoring.score_by_probability(predictions, model_name, config=config)


def ingest_contracts(contracts: DataFrame, path: str) -> PipelineModel:
    """Chunk and number the contracts, add text vectors, store the chunk table, return the fitted model.

    The texts are split once: the chunks are stored before they are counted, fitted on and given vectors.
    """
    chunks = numbered_chunks(contracts)
    model = retrieval.fit_text_vectors(chunks)
    sinks.write_chunks(retrieval.text_vectors(model, chunks), path)
    return model


def numbered_chunks(contracts: DataFrame) -> DataFrame:
    """The chunk table of the contracts with numbers, split once and stored."""
    return contract_ops.number_chunks(cut_lineage(contract_ops.clause_chunks(contracts)))


def retrieve_evidence(
    requests: DataFrame,
    contracts: DataFrame,
    mode: str = "keyword",
    k: int = DEFAULT.top_k,
    model: PipelineModel | None = None,
    names: DataFrame | None = None,
) -> DataFrame:
    """Add an ``evidence`` list to every request row (vendor_id, vendor_name, top_risk_factors, ...).

    ``keyword`` takes contract texts. ``vector`` takes the stored chunk table and its fitted model.
    """
    if mode == "keyword":
        return retrieval.keyword_evidence(requests, contracts, k, names=names)
    if mode == "vector":
        if model is None:
            raise ValueError("vector retrieval needs the fitted text-vector model")
        return retrieval.vector_evidence(cut_lineage(requests), contracts, model, k)
    raise ValueError(f"unknown retrieval mode: {mode}")


_NO_TEXTS = T.ArrayType(T.StringType())


def analyze_portfolio(
    scored: DataFrame,
    contracts: DataFrame,
    requested: DataFrame | None = None,
    mode: str = "keyword",
    k: int = DEFAULT.top_k,
    model: PipelineModel | None = None,
    config: RiskConfig = DEFAULT,
) -> DataFrame:
    """One analysis row per vendor: score, factors, evidence, explanation, action, exposure, payloads.

    With ``requested`` (vendor_id) the result has those ids only, and ids without a feature row come
    back with an error entry and no result.
    """
    rows = scoring.first_row_per_vendor(
        scored.select(
            "vendor_id",
            "vendor_name",
            "business_owner",
            "owner",
            "account_manager",
            "contract_file",
            "risk_score",
            "risk_level",
            "top_risk_factors",
            "estimated_financial_exposure",
        )
    )
    rows = rows.withColumn("_known", F.lit(True))
    if requested is not None:
        rows = requested.select("vendor_id").distinct().join(rows, "vendor_id", "left")
    found = retrieve_evidence(rows, contracts, mode, k, model, scored.select("vendor_name"))
    level = F.col("risk_level")
    # the action of the workflow replaces the one of the scorer
    decided = found.withColumns(
        {
            "explanation": evidence.explanation(
                F.coalesce("vendor_name", "vendor_id"), F.col("top_risk_factors"), F.col("evidence"), config
            ),
            "recommended_action": risk.workflow_action(level),
            "human_review_required": risk.review_required(level),
        }
    )
    known = F.coalesce(F.col("_known"), F.lit(False))
    unknown_text = F.concat(F.lit("Unknown vendor_id: "), F.coalesce("vendor_id", F.lit("None")))
    return decided.select(
        "vendor_id",
        "vendor_name",
        "risk_score",
        "risk_level",
        "top_risk_factors",
        F.when(known, F.col("evidence")).alias("retrieved_contract_evidence"),
        F.when(known, F.col("explanation")).alias("explanation"),
        F.when(known, F.col("recommended_action")).alias("recommended_action"),
        "estimated_financial_exposure",
        F.when(known, F.col("human_review_required")).alias("human_review_required"),
        F.when(known, evidence.wide_payload()).alias("automation_payload"),
        F.when(known, evidence.narrow_payload()).alias("response_payload"),
        F.when(known, F.array().cast(_NO_TEXTS)).otherwise(F.array(unknown_text)).alias("errors"),
    )


def portfolio_summary(
    vendor_features: DataFrame, scoring_mode: str = "points", config: RiskConfig = DEFAULT
) -> DataFrame:
    return portfolio.portfolio_summary(vendor_features, scoring_mode, config)


def train(spark: SparkSession, vendor_features: DataFrame, folder: str) -> training.Trained:
    """Train, compare, and store the champion, the comparison and the baseline."""
    trained = training.train_and_compare(spark, vendor_features)
    sinks.save_model(trained.models[trained.champion], f"{folder}/model")
    sinks.write_report(trained.results, f"{folder}/model_results")
    champion = trained.results.where(F.col("model_name") == trained.champion).select(
        "model_name",
        F.array(*[F.lit(c) for c in MODEL_FEATURES]).alias("feature_columns"),
        F.lit(MODEL_TARGET).alias("target_column"),
        F.current_timestamp().alias("trained_at"),
    )
    sinks.write_report(champion, f"{folder}/champion")
    baseline = training.training_baseline(vendor_features)
    sinks.write_report(baseline, f"{folder}/training_baseline")
    return trained


def score_with_stored_model(
    spark: SparkSession, vendor_features: DataFrame, folder: str, config: RiskConfig = DEFAULT
) -> DataFrame:
    """Score by the stored champion; by the rule score when none is stored."""
    if not readers.path_exists(spark, f"{folder}/champion"):
        return score_portfolio_model(vendor_features, config=config)
    name = spark.read.json(f"{folder}/champion").first()["model_name"]
    return score_portfolio_model(vendor_features, sinks.load_model(spark, f"{folder}/model"), name, config)


def read_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """The stored baseline as (metric, value)."""
    stored = spark.read.json(f"{folder}/training_baseline").drop("row_count")
    return stored.unpivot([], [F.col(c) for c in stored.columns], "metric", "value")


def monitor_drift(spark: SparkSession, vendor_features: DataFrame, folder: str) -> DataFrame:
    """Compare with the stored baseline (training first when there is none) and store the report."""
    if not readers.path_exists(spark, f"{folder}/training_baseline"):
        train(spark, vendor_features, folder)
    report = drift.drift_report(vendor_features, read_baseline(spark, folder))
    sinks.write_report(report, f"{folder}/drift_report")
    return spark.read.schema(report.schema).json(f"{folder}/drift_report")


def route_reviews(analysis: DataFrame, path: str | None = None, run_id: str | None = None) -> DataFrame:
    """High vendors with alert texts; with a path their review rows are added to that table, once per ``run_id``."""
    routed = evidence.route_reviews(analysis)
    if path is not None:
        sinks.append_reviews(routed.select(*evidence.REVIEW_COLUMNS), path, run_id)
    return routed
