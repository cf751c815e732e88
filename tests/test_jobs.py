import json
import os

import pytest
from fixtures import CONTRACT, REFERENCE_DATE, invoice, raw_tables
from pyspark.sql import functions as F

from procurisk.config import EVENT_APPROVED, EVENT_REVIEW
from procurisk.operators import drift, quality, training
from procurisk.plans import jobs
from procurisk.session import ensure_checkpoint_dir
from procurisk.sources import readers, sinks
from procurisk.sources.schemas import INVOICES, TICKETS, VENDORS


@pytest.fixture(scope="module")
def table(spark):
    return jobs.build_features(raw_tables(spark), REFERENCE_DATE).persist()


@pytest.fixture(scope="module")
def contracts(spark):
    return spark.createDataFrame(
        [("databridge_solutions_contract.txt", CONTRACT), ("supportly_india_contract.txt", "Supportly India Agreement\n\nRenewal Terms\nyearly")],
        "contract_file string, text string",
    )


def write_folder(spark, folder, **changes):
    """The raw tables as single CSV files, missing values as empty cells."""
    for name, df in raw_tables(spark, **changes).items():
        df.toPandas().to_csv(os.path.join(folder, name), index=False)


# --- analysis -------------------------------------------------------------------------------------


def test_analysis_of_requested_vendors(spark, table, contracts):
    requested = spark.createDataFrame([("V001",), ("V001",), ("V002",), ("V999",), (None,)], "vendor_id string")
    rows = jobs.analyze_portfolio(jobs.score_portfolio_rules(table), contracts, requested).collect()
    got = {r["vendor_id"]: r.asDict(True) for r in rows}
    assert len(rows) == 4
    first = got["V001"]
    assert (first["risk_level"], first["human_review_required"], first["errors"]) == ("High", True, [])
    evidence = first["retrieved_contract_evidence"]
    assert {e["source"] for e in evidence} == {"databridge_solutions_contract.txt"}
    assert [e["score"] for e in evidence] == sorted((e["score"] for e in evidence), reverse=True)
    assert set(evidence[0]) == {"text", "vendor_name", "clause_type", "source", "score"}
    payload = first["automation_payload"]
    assert payload["event_type"] == EVENT_REVIEW and payload["business_owner"] == "Data Engineering"
    assert payload["evidence_sources"] == ["databridge_solutions_contract.txt"] and len(payload) == 12
    assert first["response_payload"]["owner"] == "Data Engineering" and len(first["response_payload"]) == 8
    assert first["explanation"].startswith("For DataBridge Solutions, retrieved contract evidence was compared against: 2 ")
    second = got["V002"]
    assert second["retrieved_contract_evidence"] == [] and second["automation_payload"]["event_type"] == EVENT_APPROVED
    assert second["explanation"].startswith("No contract clauses were retrieved for CloudNova Systems. Review ")
    unknown = got["V999"]
    assert unknown["errors"] == ["Unknown vendor_id: V999"]
    assert all(unknown[k] is None for k in unknown if k not in ("vendor_id", "errors"))
    assert got[None]["errors"] == ["Unknown vendor_id: None"]


def test_analysis_of_the_whole_portfolio_by_vectors(spark, table, contracts, tmp_path):
    model = jobs.ingest_contracts(contracts, str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    rows = jobs.analyze_portfolio(jobs.score_portfolio_model(table), chunks, mode="vector", model=model).collect()
    got = {r["vendor_id"]: r for r in rows}
    assert {e["vendor_name"] for e in got["V001"]["retrieved_contract_evidence"]} == {"DataBridge Solutions"}
    assert len(got["V001"]["retrieved_contract_evidence"]) == 5
    assert {e["vendor_name"] for e in got["V003"]["retrieved_contract_evidence"]} == {"Supportly India"}
    # no contract of its own: the best clauses of all
    assert len(got["V002"]["retrieved_contract_evidence"]) == 5
    requested = spark.createDataFrame([("V003",), ("V998",)], "vendor_id string")
    some = jobs.analyze_portfolio(
        jobs.score_portfolio_model(table), chunks, requested, mode="vector", model=model
    ).collect()
    assert {r["vendor_id"]: len(r["errors"]) for r in some} == {"V003": 0, "V998": 1}
    assert {r["vendor_id"]: r["retrieved_contract_evidence"] is None for r in some} == {"V003": False, "V998": True}


def test_owner_falls_back_and_payload_is_json(spark, table, contracts):
    blank = table.withColumn("business_owner", F.lit("")).withColumn("owner", F.lit(None).cast("string"))
    row = jobs.analyze_portfolio(jobs.score_portfolio_rules(blank), contracts).where("vendor_id = 'V001'")
    text, owner = row.select(F.to_json("automation_payload"), "response_payload.owner").first()
    assert owner == "" and json.loads(text)["risk_score"] == 1.0


def test_routing_appends_high_vendors(spark, table, contracts, tmp_path):
    analysis = jobs.analyze_portfolio(jobs.score_portfolio_rules(table), contracts)
    path = str(tmp_path / "reviews")
    routed = jobs.route_reviews(analysis, path).collect()
    jobs.route_reviews(analysis, path)
    assert [r["vendor_id"] for r in routed] == ["V001"]
    assert routed[0]["alert_text"] == (
        "🚨 High-Risk Vendor Alert\n\nVendor: DataBridge Solutions\nRisk Level: High\nRisk Score: 1\n"
        "Estimated Exposure: $534400\n\nRecommended Action:\n"
        "Escalate to procurement manager and block approval until review"
    )
    stored = spark.read.parquet(path)
    assert stored.count() == 2 and len(stored.columns) == 8
    assert stored.where("updated_at is null").count() == 0


def test_a_repeated_run_replaces_its_own_review_rows(spark, table, contracts, tmp_path):
    analysis = jobs.analyze_portfolio(jobs.score_portfolio_rules(table), contracts)
    path = str(tmp_path / "reviews")
    for run in ("monday", "tuesday", "monday", "monday"):
        jobs.route_reviews(analysis, path, run)
    rows = spark.read.parquet(path).groupBy("run_id").count().collect()
    assert {r["run_id"]: r["count"] for r in rows} == {"monday": 1, "tuesday": 1}
    before = {r["updated_at"] for r in spark.read.parquet(path).where("run_id = 'tuesday'").collect()}
    jobs.route_reviews(analysis.where("false"), path, "monday")  # no vendor is high any more
    assert spark.read.parquet(path).count() == 1
    jobs.route_reviews(analysis, path, "a/b: c%")
    assert {r["run_id"] for r in spark.read.parquet(path).collect()} == {"tuesday", "a/b: c%"}
    assert {r["updated_at"] for r in spark.read.parquet(path).where("run_id = 'tuesday'").collect()} == before


# --- sources and sinks ----------------------------------------------------------------------------


def test_csv_folder_to_features(spark, tmp_path):
    write_folder(spark, tmp_path)
    store = str(tmp_path / "features")
    first = jobs.load_features(spark, store, str(tmp_path), REFERENCE_DATE)
    assert first.count() == 3 and len(first.columns) == 45
    # stored now: the raw folder is not read again
    again = jobs.load_features(spark, store, str(tmp_path / "gone"), REFERENCE_DATE)
    assert sorted(map(str, again.collect())) == sorted(map(str, first.collect()))


def test_missing_texts_become_null(spark, tmp_path):
    write_folder(spark, tmp_path, invoices=[invoice(po_match="N/A"), invoice(po_match="NaN", amount="2"), invoice(amount="3")])
    raw = readers.read_raw_csv(spark, str(tmp_path / INVOICES))
    assert raw.where("po_match is null").count() == 2
    assert raw.where("paid_date is null").count() == 3


def test_quoted_cells(spark, tmp_path):
    write_folder(spark, tmp_path, invoices=[invoice(cost_center='A "quoted", name')])
    raw = readers.read_raw_csv(spark, str(tmp_path / INVOICES))
    assert raw.first()["cost_center"] == 'A "quoted", name'


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="Missing required raw dataset"):
        readers.read_raw_csv(spark, str(tmp_path / VENDORS))


def test_gate_stops_the_build(spark, tmp_path):
    write_folder(spark, tmp_path, invoices=[invoice(vendor_id="V777")])
    with pytest.raises(quality.DataQualityError, match="Invoices reference unknown vendors"):
        jobs.load_features(spark, str(tmp_path / "features"), str(tmp_path), REFERENCE_DATE)
    assert not readers.path_exists(spark, str(tmp_path / "features"))


def test_contract_folder(spark, tmp_path):
    (tmp_path / "b_contract.txt").write_text("B Agreement\n\nHead\nbody ü\n", encoding="utf-8")
    (tmp_path / "a_contract.txt").write_text("A Agreement", encoding="utf-8")
    (tmp_path / "notes.md").write_text("no")
    rows = readers.read_contracts(spark, str(tmp_path)).orderBy("contract_file").collect()
    assert [tuple(r) for r in rows] == [
        ("a_contract.txt", "A Agreement"),
        ("b_contract.txt", "B Agreement\n\nHead\nbody ü\n"),
    ]


def test_feature_sink_formats(spark, table, tmp_path):
    for fmt in ("parquet", "csv"):
        sinks.write_features(table, str(tmp_path / fmt), fmt)
        sinks.write_features(table, str(tmp_path / fmt), fmt)
    assert readers.read_table(spark, str(tmp_path / "parquet")).count() == 3
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3


def test_checkpoint_folder_is_taken_from_the_session(spark):
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)


# --- training and drift ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    """200 vendors whose label follows from compliance and duplicates."""
    n = F.col("id")
    base = spark.range(200).select(
        F.concat(F.lit("V"), n.cast("string")).alias("vendor_id"),
        *[(F.pmod(F.hash(n, F.lit(c)), F.lit(50)) / 10.0).alias(c) for c in training.MODEL_FEATURES],
    )
    return base.withColumn("compliance_missing_flag", (n_mod("vendor_id") < 3).cast("double")).withColumn(
        training.MODEL_TARGET, F.col("compliance_missing_flag").cast("int")
    )


def n_mod(column):
    return F.pmod(F.hash(column), F.lit(10))


def test_split_is_stratified_and_repeatable(spark, labelled):
    once = training.with_split(labelled)
    sizes = {(r[0], r[1]): r["count"] for r in once.groupBy(training.MODEL_TARGET, "is_test").count().collect()}
    classes = {c: sizes[c, True] + sizes[c, False] for c in (0, 1)}
    assert sizes[0, True] + sizes[1, True] == 60
    for c in (0, 1):
        assert abs(sizes[c, True] - 0.3 * classes[c]) < 1
    again = training.with_split(labelled.repartition(7))
    key = ("vendor_id", "is_test")
    assert sorted(map(tuple, once.select(*key).collect())) == sorted(map(tuple, again.select(*key).collect()))


@pytest.mark.parametrize("positives, sizes", [(8, (5, 3)), (1, None)])
def test_split_of_25_rows(spark, positives, sizes):
    rows = spark.range(25).select(
        F.format_string("V%03d", F.col("id") + 1).alias("vendor_id"), (F.col("id") < positives).cast("int").alias("y")
    )
    test = training.with_split(rows, "y").where("is_test")
    assert test.count() == 8
    if sizes:
        assert (test.where("y = 0").count(), test.where("y = 1").count()) == sizes


def test_copies_stay_on_one_side(spark):
    rows = spark.range(300).select(
        F.when(F.col("id") < 100, "HOT").otherwise(F.col("id").cast("string")).alias("vendor_id"),
        (F.col("id") % 2).alias("y"),
    )
    sides = training.with_split(rows, "y").where("vendor_id = 'HOT' and y = 0").select("is_test").distinct()
    assert sides.count() == 1


def test_training(spark, labelled, tmp_path):
    folder = str(tmp_path / "run")
    trained = jobs.train(spark, labelled, folder)
    rows = {r["model_name"]: r for r in trained.results.collect()}
    assert list(rows) == list(training.MODEL_NAMES)
    for r in rows.values():
        assert all(0 <= r[m] <= 1 for m in ("accuracy", "precision", "recall", "f1", "roc_auc"))
        assert (r["train_size"], r["test_size"], r["feature_count"]) == (140, 60, 16)
    # both separate the classes: the first one wins the tie
    assert rows["LogisticRegression"]["f1"] == 1.0 and trained.champion == "LogisticRegression"
    model = sinks.load_model(spark, f"{folder}/model")
    before = training.predict(trained.models[trained.champion], labelled).select("vendor_id", "probability_1")
    after = training.predict(model, labelled).select("vendor_id", "probability_1")
    assert sorted(map(tuple, before.collect())) == sorted(map(tuple, after.collect()))
    assert spark.read.json(f"{folder}/model_results").count() == 2
    champion = spark.read.json(f"{folder}/champion").first()
    assert champion["model_name"] == "LogisticRegression" and champion["feature_columns"] == list(training.MODEL_FEATURES)
    report = jobs.monitor_drift(spark, labelled, folder)
    assert report.count() == 4 and report.where("drift_detected or percent_change <> 0").count() == 0


def test_scoring_with_a_stored_model(spark, table, labelled, tmp_path):
    folder = str(tmp_path / "none")
    assert {r["model_name"] for r in jobs.score_with_stored_model(spark, table, folder).collect()} == {"rule_based"}
    jobs.train(spark, labelled, folder)
    rows = jobs.score_with_stored_model(spark, table, folder).collect()
    assert {r["model_name"] for r in rows} == {"LogisticRegression"}
    assert all(0 <= r["risk_score"] <= 1 and r["risk_score"] == round(r["risk_score"], 4) for r in rows)


def test_drift_trains_first_without_a_baseline(spark, labelled, tmp_path):
    folder = str(tmp_path / "fresh")
    assert not drift.overall_drift(jobs.monitor_drift(spark, labelled, folder)).first()[0]
    assert readers.path_exists(spark, f"{folder}/model")


def test_one_class_is_refused(spark, labelled):
    with pytest.raises(ValueError, match="both high-risk and non-high-risk"):
        training.train_and_compare(spark, labelled.where(f"{training.MODEL_TARGET} = 0"))


def test_missing_model_column(spark, labelled):
    with pytest.raises(ValueError, match="ticket_count"):
        training.model_input(labelled.drop("ticket_count"))


def test_champion_rule(spark):
    rows = [(0, "a", 0.5, 0.9), (1, "b", 0.8, 0.7), (2, "c", 0.8, 0.9), (3, "d", 0.8, 0.9)]
    df = spark.createDataFrame(rows, "position int, model_name string, f1 double, accuracy double")
    assert df.agg(training._best_result(df)).first()[0] == "c"


def test_metrics(spark):
    rows = [(1, 1)] * 3 + [(0, 1)] + [(1, 0)] * 2 + [(0, 0)] * 4
    df = spark.createDataFrame(rows, "y int, prediction int")
    got = training.classifier_metrics(df, "y").first()
    assert tuple(got) == (0.7, 0.75, 0.6, 0.6667)
    matrix = {r["label"]: (r["predicted_0"], r["predicted_1"]) for r in training.confusion_matrix(df, "y").collect()}
    assert matrix == {0: (4, 1), 1: (2, 3)}
    report = {r["class"]: r for r in training.class_report(df, "y").collect()}
    assert (report[0]["precision"], report[0]["recall"], report[0]["support"]) == (0.6667, 0.8, 5)
    nothing = spark.createDataFrame([(0, 0)], "y int, prediction int")
    assert tuple(training.classifier_metrics(nothing, "y").first()) == (1.0, 0.0, 0.0, 0.0)


def test_auc_counts_ties_half(spark):
    rows = [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (0, 0.9)]
    df = spark.createDataFrame(rows, "y int, s double")
    pairs = [(p > n) + 0.5 * (p == n) for yp, p in rows if yp for yn, n in rows if not yn]
    assert training.roc_auc(training.score_histogram(df, "y", "s")).first()[0] == round(sum(pairs) / len(pairs), 4)
    single = df.where("y = 1")
    assert training.roc_auc(training.score_histogram(single, "y", "s")).first()[0] is None


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "high_risk_vendor int")
    got = {r[0]: r["weight"] for r in training.class_weights(df).collect()}
    assert got == {0: 4 / 6, 1: 2.0}


def test_drift_flags(spark):
    metrics = list(drift.DRIFT_THRESHOLDS)
    now = spark.createDataFrame([(140.0, 0.3, 0.0, 2.0)], ", ".join(f"{m} double" for m in metrics))
    baseline = spark.createDataFrame([(metrics[0], 100.0), (metrics[1], 0.25), (metrics[2], 0.0)], "metric string, value double")
    report = {r["metric"]: r for r in drift.drift_report(now, baseline).collect()}
    assert (report[metrics[0]]["percent_change"], report[metrics[0]]["drift_detected"]) == (40.0, True)
    assert (report[metrics[1]]["percent_change"], report[metrics[1]]["drift_detected"]) == (20.0, False)
    assert report[metrics[2]]["percent_change"] == 0.0
    # not in the baseline: compared with 0, so the change is the value itself
    assert (report[metrics[3]]["baseline_value"], report[metrics[3]]["percent_change"]) == (0.0, 200.0)
    assert drift.overall_drift(drift.drift_report(now, baseline)).first()[0] is True
    with pytest.raises(ValueError):
        drift.metric_means(now.drop(metrics[0]))


def test_raw_table_names():
    assert (VENDORS, INVOICES, TICKETS) == ("vendor_master.csv", "invoices.csv", "support_tickets.csv")
