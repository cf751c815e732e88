"""Role views: the star-schema tables of a data folder seen as vendors, invoices, tickets and contracts."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procurisk.config import SECTION_HEADINGS
from procurisk.functions.text import contract_file_name, slug

REFERENCE_DATE = datetime.date(2002, 1, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a table that comes in fewer splits than there are cores one partition per core.

    A single small file is read by one task; tables of a size that matters are not touched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    supplier = table(spark, sf_dir, "supplier")
    key, balance = F.col("s_suppkey"), F.col("s_acctbal")
    start = F.lit("2000-01-01").cast("date")
    end = F.date_add(F.lit(REFERENCE_DATE), (F.pmod(key * 37, F.lit(400)) - 30).cast("int"))
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            key.cast("string").alias("vendor_id"),
            F.col("s_name").alias("vendor_name"),
            F.col("r_name").alias("category"),
            F.col("n_name").alias("country"),
            F.when(balance < 2500, "Low").when(balance < 6500, "Medium").otherwise("High").alias("criticality"),
            start.alias("contract_start"),
            end.alias("contract_end"),
            F.when(key % 5 == 1, "Missing SOC2")
            .when(key % 5 == 3, "Expired Insurance")
            .otherwise("Complete")
            .alias("compliance_status"),
            F.concat(F.lit("Manager "), (key % 7).cast("string")).alias("account_manager"),
            F.concat(F.lit("Owner "), (key % 13).cast("string")).alias("business_owner"),
            (F.lit(100000) + F.greatest(balance.cast("decimal(18,2)"), F.lit(0)) * 100)
            .cast("decimal(18,2)")
            .alias("annual_contract_value"),
        )
    )


def _invoice_columns(amount, unpaid=None, mismatch=None) -> list:
    line = F.col("l_linenumber")
    date = F.col("l_shipdate").cast("date")
    paid = (F.col("l_returnflag") == "A") | (line <= 4) if unpaid is None else ~unpaid
    status = F.when(paid, "Paid").when(F.col("l_returnflag") == "N", "Pending").otherwise("Overdue")
    if mismatch is None:
        mismatch = (F.col("l_linestatus") == "F") & (line >= 5)
    return [
        F.concat_ws("-", F.col("l_orderkey").cast("string"), line.cast("string")).alias("invoice_id"),
        F.col("l_suppkey").cast("string").alias("vendor_id"),
        date.alias("invoice_date"),
        amount.cast("decimal(18,2)").alias("amount"),
        F.date_add(date, 30).alias("due_date"),
        F.when(status == "Paid", F.date_add(date, line * 5)).alias("paid_date"),
        status.alias("invoice_status"),
        F.when(mismatch, "No").otherwise("Yes").alias("po_match"),
        F.lit("USD").alias("currency"),
        F.concat(F.lit("CC-"), (F.col("l_partkey") % 10).cast("string")).alias("cost_center"),
    ]


def _invoices(lineitem: DataFrame, amount) -> DataFrame:
    return lineitem.select(*_invoice_columns(amount))


def invoices_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as an invoice."""
    return _invoices(table(spark, sf_dir, "lineitem"), F.col("l_extendedprice"))


def invoices_by_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item, its quantity as the amount: this view has real duplicates over all dates."""
    return _invoices(table(spark, sf_dir, "lineitem"), F.col("l_quantity"))


def invoices_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item, with rates per supplier: a supplier has some 600 line items at every scale.

    0 to 6 in a thousand are unpaid and 0 to 4 lack a matching order, by the supplier's key; every third supplier bills in whole
    thousands, which gives some of them repeated amounts on one day. So labels and levels spread without leaving rows out.
    """
    order, line, supplier = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")
    price = F.col("l_extendedprice")
    amount = F.when(supplier % 3 == 0, F.ceil(price / 1000) * 1000).otherwise(price)
    unpaid = (order * 31 + line * 7 + F.col("l_partkey")) % 1000 < supplier % 7
    mismatch = (order * 13 + line) % 1000 < (supplier * 3) % 5
    return table(spark, sf_dir, "lineitem").select(*_invoice_columns(amount, unpaid, mismatch))


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("ticket_id"),
        F.col("user_id").cast("string").alias("vendor_id"),
        F.col("ts").cast("date").alias("created_date"),
        F.when(event == "error", "Critical")
        .when(event == "purchase", "High")
        .when(event == "signup", "Medium")
        .otherwise("Low")
        .alias("severity"),
        F.col("value").alias("resolution_hours"),
        F.when(event == "error", 120.0)
        .when(event == "purchase", 360.0)
        .when(event == "signup", 720.0)
        .otherwise(1440.0)
        .alias("sla_hours"),
        F.when(k < 70, "Resolved").when(k < 90, "Open").otherwise("Escalated").alias("status"),
        event.alias("issue_type"),
    )


def _as_text(df: DataFrame, names: list[str], changed: dict) -> DataFrame:
    """The way a CSV file delivers a table: every column as text."""
    return df.select(*[changed.get(c, F.col(c).cast("string")).alias(c) for c in names])


def _defect(marker, rest: int, value: str | None, name: str):
    return F.when(marker == rest, F.lit(value)).otherwise(F.col(name).cast("string"))


def raw_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vendors as text, with defects spread over every checked column."""
    marker = F.col("vendor_id").cast("bigint") % 23
    changed = {
        "vendor_name": _defect(marker, 1, "   ", "vendor_name"),
        "criticality": _defect(marker, 2, None, "criticality"),
        "compliance_status": _defect(marker, 3, "Unknown", "compliance_status"),
        "contract_end": _defect(marker, 4, "2000-01-01", "contract_end"),
        "contract_start": _defect(marker, 5, "soon", "contract_start"),
    }
    df = vendors(spark, sf_dir)
    return _as_text(df, df.columns, changed)


def raw_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All invoices as text, quantity as the amount, with defects spread over every checked column."""
    marker = F.col("marker")
    lineitem = table(spark, sf_dir, "lineitem")
    columns = _invoice_columns(F.col("l_quantity"))
    rows = lineitem.select(((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 97).alias("marker"), *columns)
    changed = {
        "invoice_id": _defect(marker, 1, "", "invoice_id"),
        "vendor_id": _defect(marker, 2, None, "vendor_id"),
        "amount": F.when(marker == 3, "abc")
        .when(marker == 4, "0")
        .when(marker == 5, "-1")
        .otherwise(F.col("amount").cast("string")),
        "invoice_status": _defect(marker, 6, None, "invoice_status"),
        "po_match": _defect(marker, 7, "Maybe", "po_match"),
        "paid_date": F.when(marker == 8, "later")
        .when(marker == 9, "1990-01-01")
        .when(marker == 10, " ")
        .otherwise(F.col("paid_date").cast("string")),
    }
    return _as_text(rows, rows.columns[1:], changed)


def raw_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tickets as text, with defects spread over every checked column."""
    marker = F.col("ticket_id").cast("bigint") % 101
    changed = {
        "severity": _defect(marker, 1, "Urgent", "severity"),
        "status": _defect(marker, 2, None, "status"),
        "resolution_hours": _defect(marker, 3, "-4", "resolution_hours"),
        "sla_hours": _defect(marker, 4, "0", "sla_hours"),
    }
    df = tickets(spark, sf_dir)
    return _as_text(df, df.columns, changed)


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one contract text.

    The document key picks the vendor (key modulo the number of vendors) and the version (the quotient).
    Version 0 carries the vendor's plain file name, but for every seventh vendor it is an archived copy,
    found by containment only. The lines of the document come in blocks of three under the standard
    headings, then a heading without a body, then a block without a heading.
    """
    suppliers = table(spark, sf_dir, "supplier")
    vendor_count = suppliers.agg(F.count("*")).scalar()
    names = suppliers.select(F.col("s_suppkey").alias("vendor_key"), F.col("s_name").alias("vendor_name"))
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(
        F.pmod(F.col("doc_id"), vendor_count).alias("vendor_key"),
        F.floor(F.col("doc_id") / vendor_count).alias("version"),
        "text",
    )
    headings = F.array(*[F.lit(h) for h in SECTION_HEADINGS])

    def with_prefix(line, i):
        cycle = (F.floor(i / 3) % 9).cast("int")
        start = (
            F.when(cycle < 7, F.concat(F.lit("\n\n"), F.get(headings, cycle), F.lit("\n")))
            .when(cycle == 7, "\n\nSupplementary Terms\n\n")
            .otherwise("\n\n")
        )
        return F.concat(F.when(i % 3 == 0, start).otherwise("\n"), line)

    body = F.array_join(F.transform(F.split("text", "\n"), with_prefix), "")
    stem = slug(F.col("vendor_name"))
    file_name = (
        F.when(
            F.col("version") > 0,
            F.concat(stem, F.lit("_v"), F.col("version").cast("string"), F.lit("_contract.txt")),
        )
        .when(F.col("vendor_key") % 7 == 3, F.concat(F.lit("archive_"), contract_file_name(F.col("vendor_name"))))
        .otherwise(contract_file_name(F.col("vendor_name")))
    )
    return documents.join(names, "vendor_key").select(
        file_name.alias("contract_file"),
        F.concat(F.col("vendor_name"), F.lit(" Master Services Agreement"), body).alias("text"),
    )


def contract_requests(scored: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored vendors, one row per contract text, so that every text is asked for.

    Version 0 (and a vendor without texts) keeps the vendor's id and name; later versions carry their number in both, and the
    name leads to the file of that version.
    """
    vendor_count = table(spark, sf_dir, "supplier").agg(F.count("*")).scalar()
    versions = table(spark, sf_dir, "documents").select(
        F.pmod(F.col("doc_id"), vendor_count).cast("string").alias("_key"),
        F.floor(F.col("doc_id") / vendor_count).cast("string").alias("_version"),
    )
    later = F.coalesce(F.col("_version") != "0", F.lit(False))
    named = {
        "vendor_id": F.when(later, F.concat_ws("-v", "vendor_id", "_version")).otherwise(F.col("vendor_id")),
        "vendor_name": F.when(later, F.concat_ws(" v", "vendor_name", "_version")).otherwise(F.col("vendor_name")),
    }
    joined = scored.join(versions, F.col("vendor_id") == F.col("_key"), "left")
    return joined.select(*[named.get(c, F.col(c)).alias(c) for c in scored.columns])


def clause_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored vector as a clause: the label names the vendor, the key spreads the contract files."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"),
        F.concat(F.lit("Cluster "), F.col("label").cast("string")).alias("vendor_name"),
        F.concat(F.lit("file_"), (F.col("vec_id") % 3).cast("string")).alias("source"),
        F.col("embedding").alias("vector"),
    )


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector per label: the mean of its vectors, summed in whole millionths so that it is exact.

    The requested names match a vendor exactly (labels 0-3), by containment (4-6) or not at all (7-9).
    """
    embeddings = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("string")
    name = (
        F.when(F.col("label") <= 3, F.concat(F.lit(" cluster "), label))
        .when(F.col("label") <= 6, F.concat(F.lit("Cluster "), label, F.lit(" Holdings")))
        .otherwise(F.concat(F.lit("Group "), label))
    )
    parts = embeddings.select("label", F.posexplode("embedding").alias("dim", "x"))
    means = parts.groupBy("label", "dim").agg(
        F.sum(F.round(F.col("x").cast("double") * 1000000.0).cast("bigint")).alias("total"),
        F.count("*").alias("n"),
    )
    mean = F.col("total").cast("double") / F.col("n").cast("double") / 1000000.0
    return (
        means.select("label", F.struct("dim", mean.alias("x")).alias("part"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list("part")).alias("parts"))
        .select(
            label.alias("vendor_id"),
            name.alias("vendor_name"),
            F.transform("parts", lambda p: p["x"]).alias("vector"),
        )
    )
