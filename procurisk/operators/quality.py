"""Data-quality checks as aggregations over the raw (text) tables.

Row checks of one table are counted in a single aggregation. Only referential integrity and duplicate
detection need a key, and both are reduced to one row per key before they meet anything else.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procurisk import config as C
from procurisk.functions.text import is_blank
from procurisk.sources.schemas import INVOICES, REQUIRED_COLUMNS, TICKETS, TOO_LARGE, VENDORS, amount_value, number

ISSUE_COLUMNS = ["dataset", "severity", "field", "message", "affected_rows", "position"]

# position of an issue in the report: table * 100 + check, empty tables first
_TABLE_ORDER = {VENDORS: 100, INVOICES: 200, TICKETS: 300}
_SIZE = "size"
_DUPLICATES = "Potential duplicate invoices found"
_EMPTY_ORDER = {VENDORS: 1, INVOICES: 2, TICKETS: 3}


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _not_in(name: str, allowed: tuple[str, ...]) -> Column:
    return ~_true(F.col(name).isin(*allowed))


def _allowed_message(name: str, allowed: tuple[str, ...]) -> str:
    return f"{name} must be one of {sorted(allowed)}"


def _day(name: str) -> Column:
    return F.col(name).cast("string").try_cast("date")


def missing_columns(df: DataFrame, dataset: str) -> list[str]:
    return sorted(set(REQUIRED_COLUMNS[dataset]) - set(df.columns))


# --- fixed values in the three functions below: severity, field and message of each check --------


def vendor_checks() -> list[tuple[str, str, str, Column]]:
    """(severity, field, message, row predicate) of each vendor check, in report order."""
    start, end = _day("contract_start"), _day("contract_end")
    return [
        ("error", "vendor_id", "vendor_id must not be null", is_blank(F.col("vendor_id"))),
        ("error", "vendor_name", "vendor_name must not be null", is_blank(F.col("vendor_name"))),
        ("error", "criticality", _allowed_message("criticality", C.CRITICALITY), _not_in("criticality", C.CRITICALITY)),
        (
            "error",
            "compliance_status",
            _allowed_message("compliance_status", C.COMPLIANCE_STATUS),
            _not_in("compliance_status", C.COMPLIANCE_STATUS),
        ),
        (
            "error",
            "contract_end",
            "contract_end must be after contract_start",
            start.isNull() | end.isNull() | _true(end <= start),
        ),
        (
            "warning",
            "compliance_status",
            "Vendors have missing or incomplete compliance evidence",
            ~F.col("compliance_status").eqNullSafe("Complete"),
        ),
    ]


def invoice_checks() -> list[tuple[str, str, str, Column]]:
    amount = number(F.col("amount"))
    invoiced, paid = _day("invoice_date"), _day("paid_date")
    return [
        ("error", "invoice_id", "invoice_id must not be null", is_blank(F.col("invoice_id"))),
        ("error", "vendor_id", "vendor_id must not be null", is_blank(F.col("vendor_id"))),
        ("error", "amount", "amount must be greater than 0", amount.isNull() | _true(amount <= 0)),
        (
            "error",
            "invoice_status",
            _allowed_message("invoice_status", C.INVOICE_STATUS),
            _not_in("invoice_status", C.INVOICE_STATUS),
        ),
        ("error", "po_match", _allowed_message("po_match", C.PO_MATCH), _not_in("po_match", C.PO_MATCH)),
        (
            "error",
            "paid_date",
            "paid_date cannot be before invoice_date when paid_date exists",
            ~is_blank(F.col("paid_date")) & (paid.isNull() | invoiced.isNull() | _true(paid < invoiced)),
        ),
        _size_check("amount", amount),
    ]


def ticket_checks() -> list[tuple[str, str, str, Column]]:
    resolution, sla = number(F.col("resolution_hours")), number(F.col("sla_hours"))
    return [
        ("error", "ticket_id", "ticket_id must not be null", is_blank(F.col("ticket_id"))),
        ("error", "vendor_id", "vendor_id must not be null", is_blank(F.col("vendor_id"))),
        ("error", "severity", _allowed_message("severity", C.SEVERITY), _not_in("severity", C.SEVERITY)),
        ("error", "status", _allowed_message("status", C.TICKET_STATUS), _not_in("status", C.TICKET_STATUS)),
        (
            "error",
            "resolution_hours",
            "resolution_hours must be greater than or equal to 0",
            resolution.isNull() | _true(resolution < 0),
        ),
        ("error", "sla_hours", "sla_hours must be greater than 0", sla.isNull() | _true(sla <= 0)),
        _size_check("resolution_hours", resolution),
        _size_check("sla_hours", sla),
    ]


def _size_check(name: str, value: Column) -> tuple[str, str, str, Column]:
    """Values that the totals could not hold stop the build; nothing becomes null on the way."""
    return ("error", name, f"{name} must be less than {TOO_LARGE:.0e}", _true(value >= TOO_LARGE))


_CHECKS = {VENDORS: vendor_checks, INVOICES: invoice_checks, TICKETS: ticket_checks}
_UNKNOWN = {INVOICES: "Invoices reference unknown vendors", TICKETS: "Tickets reference unknown vendors"}


def _counters(dataset: str) -> list[Column]:
    return [
        F.count_if(predicate).alias(f"check_{i}") for i, (_, _, _, predicate) in enumerate(_CHECKS[dataset]())
    ]


def _issue(dataset: str, severity: str, field: str | None, message: str, affected: Column, position: int) -> Column:
    return F.struct(
        F.lit(dataset).alias("dataset"),
        F.lit(severity).alias("severity"),
        F.lit(field).cast("string").alias("field"),
        F.lit(message).alias("message"),
        F.coalesce(affected, F.lit(0)).cast("bigint").alias("affected_rows"),
        F.lit(position).alias("position"),
    )


def _findings(counts: DataFrame, dataset: str, issues: list[Column], always: bool = False) -> DataFrame:
    """One row of counters -> the checks that found something, and one row with the size of the table.

    The size comes along as a row of severity ``size``, so that one pass over a table serves both.
    """
    kept = F.array(*issues) if always else F.filter(F.array(*issues), lambda i: i["affected_rows"] > 0)
    empty = _issue(dataset, "error", None, "Dataset is empty", F.lit(0), _EMPTY_ORDER[dataset])
    none = F.filter(F.array(empty), lambda i: F.lit(False))
    size = F.array(_issue(dataset, _SIZE, None, "", F.col("rows"), 0))
    all_rows = F.concat(F.when(F.col("rows") == 0, F.array(empty)).otherwise(none), kept, size)
    return counts.select(F.inline(all_rows))


def _check_issues(dataset: str) -> list[Column]:
    return [
        _issue(dataset, severity, field, message, F.col(f"check_{i}"), _TABLE_ORDER[dataset] + i)
        for i, (severity, field, message, _) in enumerate(_CHECKS[dataset]())
    ]


def _missing_column_findings(df: DataFrame, dataset: str) -> DataFrame:
    """The single issue of a table that lacks columns; its other checks do not run."""
    message = f"Missing columns: {missing_columns(df, dataset)}"
    issue = _issue(dataset, "error", None, message, F.col("rows"), _TABLE_ORDER[dataset])
    return _findings(df.agg(F.count("*").alias("rows")), dataset, [issue], always=True)


def vendor_counts(vendors: DataFrame) -> DataFrame:
    return vendors.agg(F.count("*").alias("rows"), *_counters(VENDORS))


def _counts_with_unknown(df: DataFrame, vendors: DataFrame | None, dataset: str) -> DataFrame:
    """Counters per vendor id first, so that the table meets the vendor ids as one row per id."""
    names = ["rows"] + [f"check_{i}" for i in range(len(_CHECKS[dataset]()))]
    totals = [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in names]
    if vendors is None:
        return df.agg(F.count("*").alias("rows"), *_counters(dataset)).withColumn(
            "unknown_vendor", F.lit(0).cast("bigint")
        )
    per_vendor = df.groupBy("vendor_id").agg(F.count("*").alias("rows"), *_counters(dataset))
    known = known_vendor_ids(vendors).withColumnRenamed("vendor_id", "known_id")
    unknown = F.when(F.col("known_id").isNull(), F.col("rows")).otherwise(F.lit(0))
    return per_vendor.join(known, F.col("vendor_id") == F.col("known_id"), "left").agg(
        *totals, F.coalesce(F.sum(unknown), F.lit(0)).alias("unknown_vendor")
    )


def known_vendor_ids(vendors: DataFrame) -> DataFrame:
    return vendors.where(F.col("vendor_id").isNotNull()).select("vendor_id").distinct()


def unknown_vendor_rows(df: DataFrame, vendors: DataFrame) -> DataFrame:
    """Row count per vendor id that the master does not have; a null id is unknown."""
    per_vendor = df.groupBy("vendor_id").agg(F.count("*").alias("affected_rows"))
    return per_vendor.join(known_vendor_ids(vendors), "vendor_id", "left_anti")


def duplicate_groups(invoices: DataFrame) -> DataFrame:
    """Keys that occur more than once, nulls taken as equal, with the number of their rows.

    Equal numbers are equal whatever their spelling, by the same decimal that the features group by; other texts
    compare as they are.
    """
    value = amount_value(F.col("amount"))
    other = F.when(value.isNull(), F.col("amount").cast("string"))
    keyed = invoices.select("vendor_id", "invoice_date", value.alias("value"), other.alias("other"))
    return (
        keyed.groupBy("vendor_id", "invoice_date", "value", "other")
        .agg(F.count("*").alias("copies"))
        .where(F.col("copies") > 1)
        .select(
            "vendor_id",
            "invoice_date",
            F.coalesce(F.col("value").cast("double").cast("string"), "other").alias("amount"),
            "copies",
        )
    )


def duplicate_row_count(invoices: DataFrame) -> DataFrame:
    return duplicate_groups(invoices).agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("duplicate_rows"))


def _vendor_findings(vendors: DataFrame) -> DataFrame:
    if missing_columns(vendors, VENDORS):
        return _missing_column_findings(vendors, VENDORS)
    return _findings(vendor_counts(vendors), VENDORS, _check_issues(VENDORS))


def _child_findings(df: DataFrame, vendors: DataFrame | None, dataset: str) -> DataFrame:
    issues = _check_issues(dataset)
    unknown = _issue(
        dataset, "error", "vendor_id", _UNKNOWN[dataset], F.col("unknown_vendor"), _TABLE_ORDER[dataset] + len(issues)
    )
    return _findings(_counts_with_unknown(df, vendors, dataset), dataset, [*issues, unknown])


def _invoice_findings(invoices: DataFrame, vendors: DataFrame | None) -> DataFrame:
    if missing_columns(invoices, INVOICES):
        return _missing_column_findings(invoices, INVOICES)
    duplicates = duplicate_row_count(invoices).where(F.col("duplicate_rows") > 0)
    warning = _issue(
        INVOICES, "warning", None, _DUPLICATES, F.col("duplicate_rows"), _TABLE_ORDER[INVOICES] + 50
    )
    return _child_findings(invoices, vendors, INVOICES).unionByName(duplicates.select(F.inline(F.array(warning))))


def _ticket_findings(tickets: DataFrame, vendors: DataFrame | None) -> DataFrame:
    if missing_columns(tickets, TICKETS):
        return _missing_column_findings(tickets, TICKETS)
    return _child_findings(tickets, vendors, TICKETS)


def _all_findings(tables: Mapping[str, DataFrame]) -> DataFrame:
    vendors = tables[VENDORS]
    ids = vendors if "vendor_id" in vendors.columns else None
    parts = [
        _vendor_findings(vendors),
        _invoice_findings(tables[INVOICES], ids),
        _ticket_findings(tables[TICKETS], ids),
    ]
    return reduce(DataFrame.unionByName, parts)


def _only_issues(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("severity") != _SIZE).select(*ISSUE_COLUMNS)


def vendor_issues(vendors: DataFrame) -> DataFrame:
    return _only_issues(_vendor_findings(vendors))


def invoice_issues(invoices: DataFrame, vendors: DataFrame | None = None) -> DataFrame:
    return _only_issues(_invoice_findings(invoices, vendors))


def ticket_issues(tickets: DataFrame, vendors: DataFrame | None = None) -> DataFrame:
    return _only_issues(_ticket_findings(tickets, vendors))


def issues(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All findings of the three raw tables, one row each."""
    return _only_issues(_all_findings(tables))


def dataset_shapes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns of each table."""
    parts = [
        df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("dataset"), "rows", F.lit(len(df.columns)).alias("columns")
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The whole report in one row: passed, errors, warnings, shapes and counts."""
    found = _all_findings(tables).select("severity", "position", F.struct(*ISSUE_COLUMNS[:5]).alias("issue"))

    def listed(severity: str) -> Column:
        # at most one row per check, so the lists have a fixed bound
        chosen = F.when(F.col("severity") == severity, F.struct("position", "issue"))
        return F.transform(F.array_sort(F.collect_list(chosen)), lambda x: x["issue"])

    widths = F.create_map(*[F.lit(x) for name, df in tables.items() for x in (name, len(df.columns))])
    dataset = F.col("issue.dataset")
    shape = F.struct(
        dataset.alias("dataset"),
        F.struct(F.col("issue.affected_rows").alias("rows"), widths[dataset].alias("columns")).alias("shape"),
    )
    duplicates = F.when(F.col("issue.message") == _DUPLICATES, F.col("issue.affected_rows"))
    return found.agg(
        listed("error").alias("errors"),
        listed("warning").alias("warnings"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("severity") == _SIZE, shape)))).alias("datasets"),
        F.coalesce(F.sum(duplicates), F.lit(0)).alias("duplicate_invoice_rows"),
    ).select(
        (F.size("errors") == 0).alias("passed"),
        "errors",
        "warnings",
        "datasets",
        F.size("errors").alias("error_count"),
        F.size("warnings").alias("warning_count"),
        "duplicate_invoice_rows",
    )


class DataQualityError(ValueError):
    """Raised by the gate when a table has errors."""


def gate(tables: Mapping[str, DataFrame]) -> None:
    """Stop on errors; warnings pass. Collects one row per failed check."""
    failed = issues(tables).where(F.col("severity") == "error").orderBy("position").select("message").collect()
    if failed:
        raise DataQualityError(
            f"Cannot build features due to data quality errors: {[row['message'] for row in failed]}"
        )
