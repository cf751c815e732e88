"""The registered queries as plain SQL, written independently of the Spark plans.

Each query is a SELECT over named common table expressions; ``oracle_queries`` puts the ones it needs in
front. Rounding to n decimals goes through text, which rounds the binary value like the Spark side does.
"""

from __future__ import annotations

import re

# --- fixed values: what the SQL expects, stated here again so that a wrong value in the package shows ---
CLAUSE_KEYWORDS = {'payment': ('payment', 'invoice', 'billing', 'fees'),
 'sla': ('sla', 'service level', 'availability', 'service availability'),
 'compliance': ('compliance', 'soc2', 'soc 2', 'insurance', 'privacy', 'dpa', 'audit'),
 'renewal': ('renewal', 'renew', 'expiration', 'contract end', 'non-renewal'),
 'termination': ('termination', 'terminate', 'breach', 'cure period')}
COMPLIANCE_FACTOR_TEXT = 'Compliance evidence is missing, expired, or incomplete'
COMPLIANCE_STATUS = ('Complete', 'Missing SOC2', 'Expired Insurance', 'Missing DPA', 'Incomplete')
CRITICALITY = ('Low', 'Medium', 'High')
DRIFT_THRESHOLDS = {'pending_invoice_amount': 30.0,
 'sla_breach_rate': 20.0,
 'compliance_missing_flag': 20.0,
 'duplicate_invoice_count': 30.0}
EVENT_APPROVED = 'vendor_risk_auto_approved'
EVENT_REVIEW = 'vendor_risk_review_required'
EXTRA_QUERY_TERMS = ('compliance',
 'sla',
 'invoice',
 'renewal',
 'termination',
 'payment',
 'duplicate',
 'breach',
 'overdue',
 'pending')
INVOICE_STATUS = ('Paid', 'Pending', 'Overdue')
MODEL_FEATURES = ('total_spend',
 'pending_invoice_amount',
 'overdue_invoice_amount',
 'invoice_count',
 'duplicate_invoice_count',
 'po_mismatch_count',
 'average_resolution_hours',
 'max_resolution_hours',
 'ticket_count',
 'critical_ticket_count',
 'sla_breach_count',
 'sla_breach_rate',
 'days_until_contract_end',
 'renewal_within_90_days',
 'compliance_missing_flag',
 'criticality_score')
NO_FACTOR_TEXT = 'No material risk concentration identified'
PO_MATCH = ('Yes', 'No')
SCORER_ACTIONS = {'High compliance': 'Open compliance remediation task, hold renewal approval, and request updated audit '
                    'evidence.',
 'High': 'Escalate to procurement owner, review contract protections, and pause discretionary spend.',
 'Medium': 'Schedule vendor review, validate invoice exposure, and confirm SLA corrective actions.',
 'Low': 'Continue standard monitoring and refresh vendor evidence at the next review cycle.'}
SECTION_CLAUSE_TYPE = {'payment terms': 'payment',
 'sla obligations': 'sla',
 'compliance requirements': 'compliance',
 'renewal terms': 'renewal',
 'termination rights': 'termination',
 'data security': 'general',
 'escalation procedure': 'general'}
SECTION_HEADINGS = ('Payment Terms',
 'SLA Obligations',
 'Compliance Requirements',
 'Renewal Terms',
 'Termination Rights',
 'Data Security',
 'Escalation Procedure')
SEVERITY = ('Low', 'Medium', 'High', 'Critical')
TICKET_STATUS = ('Resolved', 'Open', 'Escalated')
WORKFLOW_ACTIONS = {'High': 'Escalate to procurement manager and block approval until review',
 'Medium': 'Request compliance or SLA review before renewal/payment approval',
 'Low': 'Approve normal processing'}


def _round(expression: str, digits: int) -> str:
    return f"CAST(format('{{:.{digits}f}}', CAST({expression} AS DOUBLE)) AS DOUBLE)"


def _money(expression: str) -> str:
    return f"'$' || format('{{:,}}', CAST({expression} AS BIGINT))"


def _plain(expression: str, digits: int) -> str:
    return f"regexp_replace(format('{{:.{digits}f}}', CAST({expression} AS DOUBLE)), '\\.?0+$', '')"


def _literals(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def _level(score: str, high: float, medium: float) -> str:
    return f"CASE WHEN {score} >= {high} THEN 'High' WHEN {score} >= {medium} THEN 'Medium' ELSE 'Low' END"


def _allowed(name: str, values) -> str:
    return f"{name} must be one of {sorted(values)}"


# --- role views -----------------------------------------------------------------------------------

CTES: dict[str, str] = {}

CTES["vendors"] = """
SELECT CAST(s_suppkey AS VARCHAR) AS vendor_id, s_name AS vendor_name, r_name AS category, n_name AS country,
       CASE WHEN s_acctbal < 2500 THEN 'Low' WHEN s_acctbal < 6500 THEN 'Medium' ELSE 'High' END AS criticality,
       DATE '2000-01-01' AS contract_start,
       DATE '2002-01-01' + CAST((s_suppkey * 37) % 400 - 30 AS INTEGER) AS contract_end,
       CASE s_suppkey % 5 WHEN 1 THEN 'Missing SOC2' WHEN 3 THEN 'Expired Insurance' ELSE 'Complete' END
           AS compliance_status,
       'Manager ' || CAST(s_suppkey % 7 AS VARCHAR) AS account_manager,
       'Owner ' || CAST(s_suppkey % 13 AS VARCHAR) AS business_owner,
       CAST(100000 + greatest(CAST(s_acctbal AS DECIMAL(18,2)), 0) * 100 AS DECIMAL(18,2)) AS annual_contract_value
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


def _invoices(
    amount: str,
    paid: str = "l_returnflag = 'A' OR l_linenumber <= 4",
    mismatch: str = "l_linestatus = 'F' AND l_linenumber >= 5",
) -> str:
    return f"""
SELECT *, CASE WHEN invoice_status = 'Paid' THEN invoice_date + line * 5 END AS paid_date
FROM (SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS invoice_id,
             CAST(l_suppkey AS VARCHAR) AS vendor_id, CAST(l_shipdate AS DATE) AS invoice_date,
             CAST({amount} AS DECIMAL(18,2)) AS amount,
             CASE WHEN {paid} THEN 'Paid'
                  WHEN l_returnflag = 'N' THEN 'Pending' ELSE 'Overdue' END AS invoice_status,
             CASE WHEN {mismatch} THEN 'No' ELSE 'Yes' END AS po_match,
             l_linenumber AS line, (l_orderkey * 7 + l_linenumber) % 97 AS marker
      FROM lineitem)
"""


CTES["invoices_all"] = _invoices("l_extendedprice")
CTES["invoices_quantity"] = _invoices("l_quantity")
CTES["invoices_portfolio"] = _invoices(
    "CASE WHEN l_suppkey % 3 = 0 THEN ceil(l_extendedprice / 1000) * 1000 ELSE l_extendedprice END",
    "(l_orderkey * 31 + l_linenumber * 7 + l_partkey) % 1000 >= l_suppkey % 7",
    "(l_orderkey * 13 + l_linenumber) % 1000 < (l_suppkey * 3) % 5",
)

CTES["tickets"] = """
SELECT CAST(event_id AS VARCHAR) AS ticket_id, CAST(user_id AS VARCHAR) AS vendor_id,
       CASE event_type WHEN 'error' THEN 'Critical' WHEN 'purchase' THEN 'High' WHEN 'signup' THEN 'Medium'
            ELSE 'Low' END AS severity,
       value AS resolution_hours,
       CASE event_type WHEN 'error' THEN 120.0 WHEN 'purchase' THEN 360.0 WHEN 'signup' THEN 720.0
            ELSE 1440.0 END AS sla_hours,
       CASE WHEN k < 70 THEN 'Resolved' WHEN k < 90 THEN 'Open' ELSE 'Escalated' END AS status
FROM (SELECT *, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS INTEGER) AS k FROM events)
"""

CTES["raw_vendors"] = """
SELECT vendor_id, CASE WHEN m = 1 THEN '   ' ELSE vendor_name END AS vendor_name,
       CASE WHEN m = 2 THEN NULL ELSE criticality END AS criticality,
       CASE WHEN m = 3 THEN 'Unknown' ELSE compliance_status END AS compliance_status,
       CASE WHEN m = 4 THEN '2000-01-01' ELSE CAST(contract_end AS VARCHAR) END AS contract_end,
       CASE WHEN m = 5 THEN 'soon' ELSE CAST(contract_start AS VARCHAR) END AS contract_start
FROM (SELECT *, CAST(vendor_id AS BIGINT) % 23 AS m FROM vendors)
"""

CTES["raw_invoices"] = """
SELECT CASE WHEN marker = 1 THEN '' ELSE invoice_id END AS invoice_id,
       CASE WHEN marker = 2 THEN NULL ELSE vendor_id END AS vendor_id,
       CAST(invoice_date AS VARCHAR) AS invoice_date,
       CASE marker WHEN 3 THEN 'abc' WHEN 4 THEN '0' WHEN 5 THEN '-1' ELSE CAST(amount AS VARCHAR) END AS amount,
       CASE WHEN marker = 6 THEN NULL ELSE invoice_status END AS invoice_status,
       CASE WHEN marker = 7 THEN 'Maybe' ELSE po_match END AS po_match,
       CASE marker WHEN 8 THEN 'later' WHEN 9 THEN '1990-01-01' WHEN 10 THEN ' '
            ELSE CAST(paid_date AS VARCHAR) END AS paid_date
FROM invoices_quantity
"""

CTES["raw_tickets"] = """
SELECT ticket_id, vendor_id, CASE WHEN m = 1 THEN 'Urgent' ELSE severity END AS severity,
       CASE WHEN m = 2 THEN NULL ELSE status END AS status,
       CASE WHEN m = 3 THEN '-4' ELSE CAST(resolution_hours AS VARCHAR) END AS resolution_hours,
       CASE WHEN m = 4 THEN '0' ELSE CAST(sla_hours AS VARCHAR) END AS sla_hours
FROM (SELECT *, CAST(ticket_id AS BIGINT) % 101 AS m FROM tickets)
"""

# --- data quality ---------------------------------------------------------------------------------


def _checks(table: str, dataset: str, checks: list[tuple[str, str, str, str]], first: int) -> str:
    parts = []
    for i, (severity, field, message, predicate) in enumerate(checks):
        text = message.replace("'", "''")
        parts.append(
            f"SELECT '{dataset}' AS dataset, '{severity}' AS severity, '{field}' AS field, '{text}' AS message, "
            f"COUNT(*) AS affected_rows, {first + i} AS position FROM {table} WHERE {predicate}"
        )
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE affected_rows > 0"


def _blank(name: str) -> str:
    return f"coalesce(trim({name}), '') = ''"


def _not_in(name: str, values) -> str:
    return f"({name} IS NULL OR {name} NOT IN ({_literals(values)}))"


def _null_message(name: str) -> str:
    return f"{name} must not be null"


CTES["vendor_issues"] = _checks(
    "raw_vendors",
    "vendor_master.csv",
    [
        ("error", "vendor_id", _null_message("vendor_id"), _blank("vendor_id")),
        ("error", "vendor_name", _null_message("vendor_name"), _blank("vendor_name")),
        ("error", "criticality", _allowed("criticality", CRITICALITY), _not_in("criticality", CRITICALITY)),
        (
            "error",
            "compliance_status",
            _allowed("compliance_status", COMPLIANCE_STATUS),
            _not_in("compliance_status", COMPLIANCE_STATUS),
        ),
        (
            "error",
            "contract_end",
            "contract_end must be after contract_start",
            "coalesce(TRY_CAST(contract_end AS DATE) <= TRY_CAST(contract_start AS DATE), true)",
        ),
        (
            "warning",
            "compliance_status",
            "Vendors have missing or incomplete compliance evidence",
            "compliance_status IS DISTINCT FROM 'Complete'",
        ),
    ],
    100,
)
_UNKNOWN = "NOT EXISTS (SELECT 1 FROM raw_vendors v WHERE v.vendor_id = {0}.vendor_id)"
CTES["invoice_duplicates"] = """
SELECT SUM(c) AS n FROM (SELECT COUNT(*) AS c FROM raw_invoices
    GROUP BY vendor_id, invoice_date, coalesce(CAST(TRY_CAST(amount AS DOUBLE) AS VARCHAR), amount)
    HAVING COUNT(*) > 1)
"""
CTES["invoice_issues"] = (
    _checks(
        "raw_invoices",
        "invoices.csv",
        [
            ("error", "invoice_id", _null_message("invoice_id"), _blank("invoice_id")),
            ("error", "vendor_id", _null_message("vendor_id"), _blank("vendor_id")),
            (
                "error",
                "amount",
                "amount must be greater than 0",
                "coalesce(TRY_CAST(amount AS DOUBLE) <= 0, true)",
            ),
            (
                "error",
                "invoice_status",
                _allowed("invoice_status", INVOICE_STATUS),
                _not_in("invoice_status", INVOICE_STATUS),
            ),
            ("error", "po_match", _allowed("po_match", PO_MATCH), _not_in("po_match", PO_MATCH)),
            (
                "error",
                "paid_date",
                "paid_date cannot be before invoice_date when paid_date exists",
                "NOT (" + _blank("paid_date") + ") AND "
                "coalesce(TRY_CAST(paid_date AS DATE) < TRY_CAST(invoice_date AS DATE), true)",
            ),
            (
                "error",
                "vendor_id",
                "Invoices reference unknown vendors",
                _UNKNOWN.format("raw_invoices"),
            ),
        ],
        200,
    )
    + """
UNION ALL SELECT 'invoices.csv', 'warning', '', 'Potential duplicate invoices found', n, 250
FROM invoice_duplicates WHERE n > 0
"""
)
CTES["ticket_issues"] = _checks(
    "raw_tickets",
    "support_tickets.csv",
    [
        ("error", "ticket_id", _null_message("ticket_id"), _blank("ticket_id")),
        ("error", "vendor_id", _null_message("vendor_id"), _blank("vendor_id")),
        ("error", "severity", _allowed("severity", SEVERITY), _not_in("severity", SEVERITY)),
        ("error", "status", _allowed("status", TICKET_STATUS), _not_in("status", TICKET_STATUS)),
        (
            "error",
            "resolution_hours",
            "resolution_hours must be greater than or equal to 0",
            "coalesce(TRY_CAST(resolution_hours AS DOUBLE) < 0, true)",
        ),
        (
            "error",
            "sla_hours",
            "sla_hours must be greater than 0",
            "coalesce(TRY_CAST(sla_hours AS DOUBLE) <= 0, true)",
        ),
        ("error", "vendor_id", "Tickets reference unknown vendors", _UNKNOWN.format("raw_tickets")),
    ],
    300,
)
CTES["all_issues"] = """
SELECT * FROM vendor_issues UNION ALL SELECT * FROM invoice_issues UNION ALL SELECT * FROM ticket_issues
"""
CTES["shapes"] = """
SELECT 'vendor_master.csv' AS dataset, COUNT(*) AS rows, 11 AS columns FROM raw_vendors
UNION ALL SELECT 'invoices.csv', COUNT(*), 10 FROM raw_invoices
UNION ALL SELECT 'support_tickets.csv', COUNT(*), 8 FROM raw_tickets
"""

# --- features -------------------------------------------------------------------------------------


def _invoice_features(invoices: str) -> str:
    return f"""
SELECT vendor_id, SUM(amount) AS total_spend,
       SUM(CASE WHEN invoice_status = 'Paid' THEN amount ELSE 0 END) AS paid_spend,
       SUM(CASE WHEN invoice_status = 'Pending' THEN amount ELSE 0 END) AS pending_invoice_amount,
       SUM(CASE WHEN invoice_status = 'Overdue' THEN amount ELSE 0 END) AS overdue_invoice_amount,
       COUNT(invoice_id) AS invoice_count, COUNT(*) FILTER (WHERE copies > 1) AS duplicate_invoice_count,
       COUNT(*) FILTER (WHERE po_match = 'No') AS po_mismatch_count
FROM (SELECT *, COUNT(*) OVER (PARTITION BY vendor_id, invoice_date, amount) AS copies FROM {invoices})
GROUP BY vendor_id
"""


CTES["invoice_f_all"] = _invoice_features("invoices_all")
CTES["invoice_f_recent"] = _invoice_features("invoices_portfolio")
CTES["invoice_f_quantity"] = _invoice_features("invoices_quantity")
CTES["ticket_f"] = """
SELECT vendor_id,
       CAST(SUM(CAST(resolution_hours AS DECIMAL(18,6))) AS DOUBLE) / COUNT(resolution_hours)
           AS average_resolution_hours,
       MAX(resolution_hours) AS max_resolution_hours, COUNT(ticket_id) AS ticket_count,
       COUNT(*) FILTER (WHERE severity = 'Critical') AS critical_ticket_count,
       COUNT(*) FILTER (WHERE resolution_hours > sla_hours) AS sla_breach_count,
       COUNT(*) FILTER (WHERE status IN ('Open', 'Escalated')) AS open_ticket_count
FROM tickets GROUP BY vendor_id
"""


def _features(invoice_features: str) -> str:
    filled = ", ".join(
        f"CAST(coalesce({c}, 0) AS DOUBLE) AS {c}"
        for c in (
            "total_spend",
            "paid_spend",
            "pending_invoice_amount",
            "overdue_invoice_amount",
            "average_resolution_hours",
            "max_resolution_hours",
        )
    )
    counted = ", ".join(
        f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}"
        for c in (
            "invoice_count",
            "duplicate_invoice_count",
            "po_mismatch_count",
            "ticket_count",
            "critical_ticket_count",
            "sla_breach_count",
            "open_ticket_count",
        )
    )
    score = (
        "CAST(compliance_missing_flag * 20 + least(duplicate_invoice_count, 3) * 10 "
        "+ least(sla_breach_count, 4) * 8 + renewal_within_90_days * 12 AS DOUBLE) "
        "+ least(pending_invoice_amount / CAST(100000 AS DOUBLE), CAST(2 AS DOUBLE)) * CAST(10 AS DOUBLE) "
        "+ CAST(least(po_mismatch_count, 3) * 8 AS DOUBLE) + CAST(greatest(0, criticality_score - 1) * 4 AS DOUBLE) "
        "+ least(CAST(annual_contract_value AS DOUBLE) / CAST(1000000 AS DOUBLE), CAST(1.5 AS DOUBLE)) "
        "* CAST(12 AS DOUBLE)"
    )
    return f"""
SELECT *, {_level("risk_score_rule", 70, 40)} AS risk_level_rule, high_risk_vendor AS risk_target
FROM (
  SELECT *,
         CAST((CAST(compliance_missing_flag = 1 AS INTEGER) + CAST(duplicate_invoice_count > 0 AS INTEGER)
          + CAST(sla_breach_count >= 2 AS INTEGER) + CAST(renewal_within_90_days = 1 AS INTEGER)
          + CAST(pending_invoice_amount > 100000 AS INTEGER) + CAST(po_mismatch_count >= 2 AS INTEGER)) >= 2
          AS INTEGER) AS high_risk_vendor,
         {_round(f"least({score}, CAST(100 AS DOUBLE))", 2)} AS risk_score_rule
  FROM (
    SELECT *, annual_contract_value AS annual_spend, business_owner AS owner,
           trim(regexp_replace(lower(vendor_name), '[^a-z0-9]+', '_', 'g'), '_') || '_contract.txt' AS contract_file,
           CASE compliance_status WHEN 'Complete' THEN 88 WHEN 'Incomplete' THEN 72 WHEN 'Missing SOC2' THEN 64
                WHEN 'Expired Insurance' THEN 67 WHEN 'Missing DPA' THEN 66 ELSE 70 END AS security_rating,
           CASE WHEN ticket_count = 0 THEN 0 ELSE CAST(sla_breach_count AS DOUBLE) / ticket_count END
               AS sla_breach_rate,
           contract_end AS contract_end_date, contract_end - DATE '2002-01-01' AS days_until_contract_end,
           contract_end - DATE '2002-01-01' AS days_to_renewal,
           CAST(contract_end - DATE '2002-01-01' BETWEEN 0 AND 90 AS INTEGER) AS renewal_within_90_days,
           CAST(compliance_status <> 'Complete' AS INTEGER) AS compliance_missing_flag,
           CAST(compliance_status <> 'Complete' AS INTEGER) AS missing_compliance,
           CASE criticality WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END AS criticality_score,
           pending_invoice_amount AS pending_invoice_exposure, average_resolution_hours AS avg_response_hours,
           0 AS max_days_late, CAST(overdue_invoice_amount > 0 AS INTEGER) AS late_invoice_count,
           total_spend AS total_invoice_amount
    FROM (SELECT v.*, {filled}, {counted}
          FROM vendors v LEFT JOIN {invoice_features} i USING (vendor_id) LEFT JOIN ticket_f t USING (vendor_id))
  )
)
"""


CTES["features"] = _features("invoice_f_recent")
CTES["features_quantity"] = _features("invoice_f_quantity")
_FEATURE_OUTPUT = (
    "* REPLACE (CAST(contract_start AS VARCHAR) AS contract_start, CAST(contract_end AS VARCHAR) AS contract_end, "
    "CAST(contract_end_date AS VARCHAR) AS contract_end_date, CAST(annual_contract_value AS DOUBLE) AS "
    "annual_contract_value, CAST(annual_spend AS DOUBLE) AS annual_spend)"
)

# --- scores ---------------------------------------------------------------------------------------

_ADDITIVE = " + ".join(
    f"CASE {cases} ELSE CAST(0 AS DOUBLE) END"
    for cases in (
        "WHEN compliance_missing_flag = 1 THEN CAST(0.25 AS DOUBLE)",
        "WHEN duplicate_invoice_count > 0 THEN CAST(0.20 AS DOUBLE)",
        "WHEN sla_breach_count >= 2 THEN CAST(0.25 AS DOUBLE) WHEN sla_breach_count >= 1 THEN CAST(0.15 AS DOUBLE)",
        "WHEN pending_invoice_amount > 100000 THEN CAST(0.20 AS DOUBLE)",
        "WHEN po_mismatch_count >= 2 THEN CAST(0.15 AS DOUBLE)",
        "WHEN renewal_within_90_days = 1 THEN CAST(0.15 AS DOUBLE)",
        "WHEN overdue_invoice_amount > 50000 THEN CAST(0.15 AS DOUBLE)",
    )
)


def _exposure(level: str) -> str:
    return _round(
        "CASE WHEN duplicate_invoice_count > 0 THEN pending_invoice_amount * CAST(least(duplicate_invoice_count, 3) "
        "AS DOUBLE) / greatest(CAST(invoice_count AS DOUBLE), CAST(1 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END "
        f"+ overdue_invoice_amount + CASE WHEN {level} IN ('High', 'Medium') THEN pending_invoice_amount "
        "ELSE CAST(0 AS DOUBLE) END + CAST(sla_breach_count AS DOUBLE) * greatest(CAST(annual_contract_value AS DOUBLE) "
        "* CAST(0.01 AS DOUBLE), CAST(5000 AS DOUBLE))",
        2,
    )


def _factors(po_minimum: int, overdue: bool) -> str:
    entries = [
        "CASE WHEN duplicate_invoice_count > 0 THEN CAST(duplicate_invoice_count AS VARCHAR) || "
        "' duplicate invoice candidates detected' END",
        "CASE WHEN sla_breach_count > 0 THEN CAST(sla_breach_count AS VARCHAR) || ' SLA breach events identified' END",
        f"CASE WHEN compliance_missing_flag = 1 THEN '{COMPLIANCE_FACTOR_TEXT}' END",
        "CASE WHEN renewal_within_90_days = 1 THEN 'Contract renewal is within ' || "
        "CAST(days_until_contract_end AS VARCHAR) || ' days' END",
        "CASE WHEN pending_invoice_amount > 100000 THEN 'High pending invoice exposure: ' || "
        + _money("pending_invoice_amount")
        + " END",
        f"CASE WHEN po_mismatch_count >= {po_minimum} THEN CAST(po_mismatch_count AS VARCHAR) || "
        "' invoices have PO mismatches' END",
    ]
    if overdue:
        entries.append(
            "CASE WHEN overdue_invoice_amount > 50000 THEN 'Overdue invoice exposure: ' || "
            + _money("overdue_invoice_amount")
            + " END"
        )
    found = f"list_filter([{', '.join(entries)}], lambda x: x IS NOT NULL)[1:6]"
    return f"CASE WHEN len({found}) > 0 THEN {found} ELSE ['{NO_FACTOR_TEXT}'] END"


_DUPLICATE = (
    "pending_invoice_amount * CAST(least(duplicate_invoice_count, 3) AS DOUBLE) "
    "/ CASE WHEN invoice_count = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(invoice_count AS DOUBLE) END"
)

CTES["scored"] = f"""
SELECT *, {_exposure("risk_level")} AS estimated_financial_exposure, {_DUPLICATE} AS duplicate_exposure,
       CASE risk_level WHEN 'High' THEN '{WORKFLOW_ACTIONS["High"]}'
            WHEN 'Medium' THEN '{WORKFLOW_ACTIONS["Medium"]}' ELSE '{WORKFLOW_ACTIONS["Low"]}' END
           AS recommended_action,
       CAST(risk_level IN ('High', 'Medium') AS INTEGER) AS human_review_required,
       {_factors(2, True)} AS factors
FROM (SELECT *, {_level("risk_score", 0.70, 0.40)} AS risk_level
      FROM (SELECT *, least({_ADDITIVE}, CAST(1 AS DOUBLE)) AS raw_score,
                   {_round(f"least({_ADDITIVE}, CAST(1 AS DOUBLE))", 4)} AS risk_score FROM features))
"""
CTES["terms"] = f"""
SELECT vendor_id, vendor_name, list_distinct(list_concat(
    list_filter(regexp_extract_all(lower(array_to_string(factors, ' ')), '[a-z0-9]+'), lambda w: length(w) > 2),
    [{_literals(EXTRA_QUERY_TERMS)}])) AS terms
FROM scored
"""
CTES["points"] = f"""
SELECT *, {_exposure("portfolio_risk_level")} AS points_exposure
FROM (SELECT *, {_level("risk_score_rule / 100.0", 0.75, 0.45)} AS portfolio_risk_level FROM features)
"""

# --- contracts ------------------------------------------------------------------------------------

CTES["contracts"] = f"""
SELECT CASE WHEN version > 0 THEN stem || '_v' || CAST(version AS VARCHAR) || '_contract.txt'
            WHEN vendor_key % 7 = 3 THEN 'archive_' || stem || '_contract.txt'
            ELSE stem || '_contract.txt' END AS contract_file,
       vendor_name,
       vendor_name || ' Master Services Agreement' || array_to_string(list_transform(string_split(text, chr(10)),
         lambda line, i: CASE WHEN (i - 1) % 3 <> 0 THEN chr(10)
             WHEN ((i - 1) // 3) % 9 < 7 THEN chr(10) || chr(10)
                 || [{_literals(SECTION_HEADINGS)}][((i - 1) // 3) % 9 + 1] || chr(10)
             WHEN ((i - 1) // 3) % 9 = 7 THEN chr(10) || chr(10) || 'Supplementary Terms' || chr(10) || chr(10)
             ELSE chr(10) || chr(10) END || line), '') AS text
FROM (SELECT s_suppkey AS vendor_key, s_name AS vendor_name, doc_id // n AS version, text,
             trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '_', 'g'), '_') AS stem
      FROM documents, (SELECT COUNT(*) AS n FROM supplier) c, supplier WHERE s_suppkey = doc_id % n)
"""
CTES["contract_lines"] = f"""
SELECT contract_file, vendor_name, position, line, CAST(line IN ({_literals(SECTION_HEADINGS)}) AS INTEGER) AS is_heading
FROM (SELECT contract_file, vendor_name, unnest(range(len(l))) AS position, trim(unnest(l)) AS line
      FROM (SELECT contract_file, vendor_name, string_split(text, chr(10)) AS l FROM contracts))
WHERE line <> ''
"""
_SECTION_TYPES = " ".join(f"WHEN '{h}' THEN '{t}'" for h, t in SECTION_CLAUSE_TYPE.items())
CTES["sections"] = f"""
SELECT contract_file, vendor_name, row_number() OVER (PARTITION BY contract_file ORDER BY part) - 1 AS section_no,
       heading, text, CASE lower(heading) {_SECTION_TYPES} ELSE 'general' END AS clause_type
FROM (SELECT contract_file, vendor_name, part, coalesce(MAX(CASE WHEN is_heading = 1 THEN line END), 'general') AS heading,
             string_agg(CASE WHEN is_heading = 0 THEN line END, chr(10) ORDER BY position) AS text
      FROM (SELECT *, SUM(is_heading) OVER (PARTITION BY contract_file ORDER BY position) AS part FROM contract_lines)
      GROUP BY contract_file, vendor_name, part)
WHERE text IS NOT NULL
"""


def _clause_type(text: str, keywords) -> str:
    heading = f"string_split({text}, ':')[1]"
    hits = " ".join(
        "WHEN " + " OR ".join(f"contains({text}, '{w}')" for w in words) + f" THEN '{kind}'"
        for kind, words in keywords.items()
    )
    return (
        f"CASE WHEN contains({heading}, 'payment') THEN 'payment' WHEN contains({heading}, 'sla') "
        f"OR contains({heading}, 'service level') THEN 'sla' WHEN contains({heading}, 'compliance') THEN 'compliance' "
        f"WHEN contains({heading}, 'renewal') THEN 'renewal' WHEN contains({heading}, 'termination') THEN 'termination' "
        f"WHEN contains({heading}, 'data security') OR contains({heading}, 'escalation') THEN 'general' "
        f"{hits} ELSE 'general' END"
    )


CTES["chunk_texts"] = """
SELECT contract_file, vendor_name, position,
       trim(regexp_replace(heading || CASE WHEN body <> '' THEN ': ' || body ELSE '' END, '\\s+', ' ', 'g')) AS text
FROM (
  SELECT contract_file, vendor_name, position,
         coalesce(last_value(CASE WHEN is_heading THEN lines[1] END IGNORE NULLS) OVER (
             PARTITION BY contract_file ORDER BY position ROWS UNBOUNDED PRECEDING), 'General') AS heading,
         array_to_string(CASE WHEN is_heading THEN lines[2:] ELSE lines END, ' ') AS body
  FROM (
    SELECT *, len(regexp_split_to_array(lines[1], '\\s+')) <= 5
              AND (len(lines) > 1 OR lines[1] NOT LIKE '%.') AS is_heading
    FROM (
      SELECT contract_file, vendor_name, position,
             list_filter(list_transform(string_split(block, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines
      FROM (SELECT contract_file, vendor_name, unnest(range(len(b))) AS position, unnest(b) AS block
            FROM (SELECT contract_file, vendor_name, regexp_split_to_array(trim(text), '\\n\\s*\\n+') AS b FROM contracts))
    )
    WHERE position > 0 AND len(lines) > 0
  )
)
"""
CTES["chunks"] = f"""
SELECT contract_file, row_number() OVER (PARTITION BY contract_file ORDER BY position) - 1 AS chunk_no, text,
       vendor_name, {_clause_type("lower(text)", CLAUSE_KEYWORDS)} AS clause_type, contract_file AS source
FROM chunk_texts
"""
_WORDS = {"payment": ("tion",), "sla": ("ung", "sch"), "compliance": ("ció",), "renewal": ("eau",)}
CTES["contract_of"] = """
SELECT vendor_id, vendor_name, coalesce(direct, contained) AS contract_file
FROM (SELECT vendor_id, vendor_name,
             (SELECT MIN(c.contract_file) FROM contracts c WHERE c.contract_file = f.contract_file) AS direct,
             (SELECT MIN(c.contract_file) FROM contracts c WHERE c.contract_file LIKE '%@_contract.txt' ESCAPE '@'
                 AND (contains(lower(regexp_replace(c.contract_file, '\\.[^.]*$', '')),
                               regexp_replace(f.contract_file, '_contract.txt$', ''))
                   OR contains(lower(regexp_replace(c.contract_file, '\\.[^.]*$', '')),
                               replace(lower(f.vendor_name), ' ', '_')))) AS contained
      FROM features f)
"""
CTES["requests"] = """
SELECT s.* REPLACE (CASE WHEN version > 0 THEN s.vendor_id || '-v' || CAST(version AS VARCHAR) ELSE s.vendor_id END AS vendor_id,
                    CASE WHEN version > 0 THEN s.vendor_name || ' v' || CAST(version AS VARCHAR) ELSE s.vendor_name END AS vendor_name)
FROM scored s LEFT JOIN (SELECT CAST(doc_id % n AS VARCHAR) AS of_vendor, doc_id // n AS version
                         FROM documents, (SELECT COUNT(*) AS n FROM supplier) c) d ON of_vendor = s.vendor_id
"""
CTES["request_terms"] = CTES["terms"].replace("FROM scored", "FROM requests")
CTES["contract_names"] = """
SELECT DISTINCT contract_file, lower(regexp_replace(contract_file, '\\.[^.]*$', '')) AS stem FROM contracts
"""
CTES["request_contract"] = """
SELECT r.vendor_id, coalesce(MIN(d.contract_file), MIN(c.contract_file)) AS contract_file
FROM (SELECT vendor_id, vendor_name, trim(regexp_replace(lower(vendor_name), '[^a-z0-9]+', '_', 'g'), '_') AS stem FROM requests) r
LEFT JOIN contract_names d ON d.contract_file = r.stem || '_contract.txt'
LEFT JOIN contract_names c ON d.contract_file IS NULL AND c.contract_file LIKE '%@_contract.txt' ESCAPE '@'
      AND (contains(c.stem, r.stem) OR contains(c.stem, replace(lower(r.vendor_name), ' ', '_')))
GROUP BY r.vendor_id
"""
CTES["keyword_ranked"] = f"""
SELECT vendor_id, rank, text, source_vendor AS vendor_name, clause_type, source, score
FROM (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY score DESC, section_no) AS rank
      FROM (SELECT t.vendor_id, s.section_no, s.vendor_name AS source_vendor, s.clause_type, s.contract_file AS source,
                   CASE WHEN s.heading = 'general' THEN s.text ELSE s.heading || chr(10) || s.text END AS text,
                   {_round("CAST(len(list_filter(t.terms, lambda w: contains(lower(s.heading || ' ' || s.text), w))) "
                           "AS DOUBLE) / len(t.terms)", 4)} AS score
            FROM request_terms t JOIN request_contract c USING (vendor_id) JOIN sections s ON s.contract_file = c.contract_file))
"""
CTES["keyword_hits"] = "SELECT * FROM keyword_ranked WHERE rank <= 5"


def _groups(limit: int) -> str:
    return f"""
SELECT vendor_id, row_number() OVER (PARTITION BY vendor_id ORDER BY first_rank) - 1 AS group_no, clause_type, text, sources
FROM (SELECT vendor_id, clause_type, MIN(rank) AS first_rank, arg_min(text, rank) AS text,
             string_agg(DISTINCT source, ', ' ORDER BY source) AS sources
      FROM keyword_ranked WHERE rank <= {limit} GROUP BY vendor_id, clause_type)
"""


CTES["groups"] = _groups(5)
CTES["explained"] = """
SELECT s.vendor_id,
       CASE WHEN g.parts IS NULL THEN 'No contract clauses were retrieved for ' || s.vendor_name || '. Review '
                 || array_to_string(s.factors, '; ') || ' manually.'
            ELSE 'For ' || s.vendor_name || ', retrieved contract evidence was compared against: '
                 || array_to_string(s.factors, '; ') || '. ' || g.parts END AS explanation
FROM requests s LEFT JOIN (
  SELECT vendor_id, string_agg(clause_type || ': ' || CASE WHEN length(text) > 180
             THEN regexp_replace(substr(text, 1, 177), '\\s+$', '') || '...' ELSE text END
             || ' Source: ' || sources || '.', ' ' ORDER BY group_no) AS parts
  FROM groups GROUP BY vendor_id) g USING (vendor_id)
"""
CTES["evidence_lists"] = """
SELECT vendor_id, string_agg(text, ' | ' ORDER BY rank) AS texts, string_agg(DISTINCT source, '; ' ORDER BY source) AS sources
FROM keyword_hits GROUP BY vendor_id
"""
CTES["requested"] = "SELECT DISTINCT vendor_id FROM tickets"
CTES["asked"] = "SELECT vendor_id FROM tickets UNION SELECT vendor_id FROM requests"

# --- vectors --------------------------------------------------------------------------------------

CTES["clause_vectors"] = """
SELECT vec_id AS chunk_id, 'Cluster ' || CAST(label AS VARCHAR) AS vendor_name,
       'file_' || CAST(vec_id % 3 AS VARCHAR) AS source, CAST(embedding AS DOUBLE[]) AS vector
FROM embeddings
"""
CTES["vector_queries"] = """
SELECT CAST(label AS VARCHAR) AS vendor_id,
       CASE WHEN label <= 3 THEN ' cluster ' || CAST(label AS VARCHAR)
            WHEN label <= 6 THEN 'Cluster ' || CAST(label AS VARCHAR) || ' Holdings'
            ELSE 'Group ' || CAST(label AS VARCHAR) END AS vendor_name,
       list(mean ORDER BY dim) AS vector
FROM (SELECT label, dim, CAST(SUM(CAST(round(CAST(x AS DOUBLE) * CAST(1000000 AS DOUBLE)) AS BIGINT)) AS DOUBLE)
                         / CAST(COUNT(*) AS DOUBLE) / CAST(1000000 AS DOUBLE) AS mean
      FROM (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding) AS x FROM embeddings)
      GROUP BY label, dim)
GROUP BY label
"""
CTES["name_pairs"] = """
SELECT DISTINCT q.vendor_name AS requested, c.vendor_name AS present
FROM vector_queries q, (SELECT DISTINCT vendor_name FROM clause_vectors) c
WHERE contains(trim(lower(q.vendor_name)), trim(lower(c.vendor_name)))
   OR contains(trim(lower(c.vendor_name)), trim(lower(q.vendor_name)))
"""
CTES["vector_hits"] = f"""
SELECT vendor_id, rank, chunk_id, vendor_name, source, scope, {_round("score", 4)} AS score
FROM (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY score DESC, chunk_id) AS rank
      FROM (SELECT q.vendor_id, c.chunk_id, c.vendor_name, c.source, list_inner_product(q.vector, c.vector) AS score,
                   CASE WHEN own THEN 'vendor' ELSE 'all' END AS scope
            FROM (SELECT *, vendor_name IN (SELECT requested FROM name_pairs) AS own FROM vector_queries) q
            JOIN clause_vectors c ON NOT own OR (q.vendor_name, c.vendor_name) IN (SELECT (requested, present) FROM name_pairs)))
WHERE rank <= 5
"""

# --- models ---------------------------------------------------------------------------------------

CTES["predictions"] = """
SELECT vendor_id, high_risk_vendor AS label, risk_score_rule / 100.0 AS score,
       CAST(risk_score_rule >= 40 AS INTEGER) AS prediction
FROM features
"""
CTES["confusion"] = """
SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
       COUNT(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
       COUNT(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
       COUNT(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn
FROM predictions
"""


def _ratio(a: str, b: str) -> str:
    return _round(f"CASE WHEN {b} = 0 THEN CAST(0 AS DOUBLE) ELSE CAST({a} AS DOUBLE) / ({b}) END", 4)


def _means(table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {_round(f'SUM(CAST({m} AS DOUBLE)) / COUNT({m})', 6)} AS value, {t} AS threshold FROM {table}"
        for m, t in DRIFT_THRESHOLDS.items()
    )


CTES["means_now"] = _means("features")
CTES["means_before"] = _means("features_quantity")
_CHANGE = _round(
    "(c.value - {0}) / CASE WHEN abs({0}) > 1e-9 THEN abs({0}) ELSE CAST(1 AS DOUBLE) END * CAST(100 AS DOUBLE)", 2
)

# --- queries --------------------------------------------------------------------------------------

QUERIES: dict[str, str] = {}

_ISSUE_LIST = "SELECT dataset, severity, field, message, affected_rows FROM {0}"
QUERIES["dq_vendors"] = _ISSUE_LIST.format("vendor_issues")
QUERIES["dq_invoices"] = _ISSUE_LIST.format("invoice_issues")
QUERIES["dq_tickets"] = _ISSUE_LIST.format("ticket_issues")
_LISTED = "coalesce(string_agg(message || ' (' || CAST(affected_rows AS VARCHAR) || ')', '; ' ORDER BY position) FILTER (WHERE severity = '{0}'), '')"
QUERIES["dq_missing_columns"] = """
SELECT 'vendor_master.csv' AS dataset, 'error' AS severity, '' AS field,
       'Missing columns: [''contract_end'', ''criticality'']' AS message, COUNT(*) AS affected_rows FROM raw_vendors
UNION ALL SELECT 'invoices.csv', 'error', '', 'Missing columns: [''amount'', ''po_match'']', COUNT(*) FROM raw_invoices
UNION ALL SELECT 'support_tickets.csv', 'error', '', 'Missing columns: [''severity'']', COUNT(*) FROM raw_tickets
"""
QUERIES["dq_empty"] = (
    _ISSUE_LIST.format("vendor_issues")
    + """
UNION ALL SELECT 'invoices.csv', 'error', '', 'Dataset is empty', COUNT(*) FROM raw_invoices WHERE vendor_id = 'nobody'
UNION ALL SELECT 'support_tickets.csv', 'error', '', 'Dataset is empty', COUNT(*) FROM raw_tickets WHERE vendor_id = 'nobody'
"""
)
QUERIES["dq_report"] = f"""
SELECT CAST(COUNT(*) FILTER (WHERE severity = 'error') = 0 AS INTEGER) AS passed,
       {_LISTED.format("error")} AS errors, {_LISTED.format("warning")} AS warnings,
       (SELECT string_agg(dataset || ':' || CAST(rows AS VARCHAR) || ':' || CAST(columns AS VARCHAR), '; ' ORDER BY dataset)
        FROM shapes) AS datasets,
       COUNT(*) FILTER (WHERE severity = 'error') AS error_count,
       COUNT(*) FILTER (WHERE severity = 'warning') AS warning_count,
       (SELECT coalesce(n, 0) FROM invoice_duplicates) AS duplicate_invoice_rows
FROM all_issues
"""
QUERIES["dataset_shapes"] = "SELECT * FROM shapes"
QUERIES["dq_unknown_vendors"] = """
SELECT vendor_id, COUNT(*) AS affected_rows FROM tickets
WHERE vendor_id IS NULL OR vendor_id NOT IN (SELECT vendor_id FROM vendors) GROUP BY vendor_id
"""
QUERIES["dq_duplicates"] = """
SELECT vendor_id, CAST(invoice_date AS VARCHAR) AS invoice_date, CAST(CAST(amount AS DOUBLE) AS VARCHAR) AS amount,
       COUNT(*) AS copies
FROM invoices_quantity GROUP BY ALL HAVING COUNT(*) > 1
"""
_MONEY_COLUMNS = "total_spend, paid_spend, pending_invoice_amount, overdue_invoice_amount"
QUERIES["invoice_features"] = (
    "SELECT * REPLACE ("
    + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _MONEY_COLUMNS.split(", "))
    + ") FROM invoice_f_all"
)
QUERIES["ticket_features"] = "SELECT * FROM ticket_f"
QUERIES["duplicate_flags"] = """
SELECT invoice_id, vendor_id, CAST(invoice_date AS VARCHAR) AS invoice_date, CAST(amount AS DOUBLE) AS amount,
       CAST(COUNT(*) OVER (PARTITION BY vendor_id, invoice_date, amount) > 1 AS INTEGER) AS duplicate_invoice_flag
FROM invoices_quantity
"""
QUERIES["vendor_features"] = f"SELECT {_FEATURE_OUTPUT} FROM features"
QUERIES["vendor_features_all"] = f"SELECT {_FEATURE_OUTPUT} FROM features_quantity"
QUERIES["rule_scores"] = """
SELECT vendor_id, s.risk_score_rule, s.risk_level_rule, p.portfolio_risk_level, s.risk_score AS additive_score,
       s.risk_level AS additive_level, s.high_risk_vendor
FROM scored s JOIN points p USING (vendor_id)
"""
QUERIES["risk_factors"] = f"""
SELECT s.vendor_id, array_to_string({_factors(1, False)}, '; ') AS model_factors,
       array_to_string(factors, '; ') AS rule_factors, array_to_string(list_sort(t.terms), ' ') AS query_terms
FROM scored s JOIN terms t USING (vendor_id)
"""
QUERIES["vendor_exposure"] = "SELECT vendor_id, risk_level, estimated_financial_exposure, duplicate_exposure FROM scored"
QUERIES["exposure_capped"] = (
    "SELECT vendor_id, "
    + _round(
        "pending_invoice_exposure * CAST(0.35 AS DOUBLE) "
        "+ CAST(sla_breach_count AS DOUBLE) * least(CAST(annual_spend AS DOUBLE) * CAST(0.01 AS DOUBLE), CAST(25000 AS DOUBLE)) "
        "+ CAST(duplicate_invoice_count AS DOUBLE) * least(CAST(annual_spend AS DOUBLE) * CAST(0.015 AS DOUBLE), CAST(20000 AS DOUBLE)) "
        "+ CASE WHEN days_to_renewal BETWEEN 0 AND 90 THEN CAST(annual_spend AS DOUBLE) * CAST(0.04 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
        2,
    )
    + " AS capped_exposure FROM features"
)
QUERIES["actions"] = f"""
SELECT vendor_id, 'rule_based' AS model_name, {_round("risk_score_rule / 100.0", 4)} AS risk_score,
       portfolio_risk_level AS risk_level,
       CASE WHEN portfolio_risk_level = 'High' AND contains(lower(array_to_string({_factors(1, False)}, ' ')), 'compliance')
            THEN '{SCORER_ACTIONS["High compliance"]}'
            WHEN portfolio_risk_level = 'High' THEN '{SCORER_ACTIONS["High"]}'
            WHEN portfolio_risk_level = 'Medium' THEN '{SCORER_ACTIONS["Medium"]}'
            ELSE '{SCORER_ACTIONS["Low"]}' END AS scorer_action,
       CASE portfolio_risk_level WHEN 'High' THEN '{WORKFLOW_ACTIONS["High"]}'
            WHEN 'Medium' THEN '{WORKFLOW_ACTIONS["Medium"]}' ELSE '{WORKFLOW_ACTIONS["Low"]}' END AS workflow_action,
       CAST(portfolio_risk_level IN ('High', 'Medium') AS INTEGER) AS human_review_required,
       points_exposure AS estimated_financial_exposure
FROM points
"""
QUERIES["score_normalization"] = """
SELECT vendor_id, round(CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + exp(-d)), 6) AS logistic,
       round(CASE WHEN MAX(d) OVER () = MIN(d) OVER () THEN CAST(0.5 AS DOUBLE)
                  ELSE (d - MIN(d) OVER ()) / (MAX(d) OVER () - MIN(d) OVER ()) END, 6) AS scaled
FROM (SELECT vendor_id, (risk_score_rule - CAST(50 AS DOUBLE)) / CAST(10 AS DOUBLE) AS d FROM features)
"""
QUERIES["review_queue"] = f"""
SELECT row_number() OVER (ORDER BY risk_score_rule DESC, pending_invoice_amount DESC, vendor_id) AS position, vendor_id, vendor_name, risk_score_rule, high_risk_vendor, pending_invoice_amount, sla_breach_count,
       duplicate_invoice_count, days_until_contract_end, '{WORKFLOW_ACTIONS["High"]}' AS recommended_action
FROM points WHERE high_risk_vendor = 1 OR portfolio_risk_level = 'High'
"""


def _summary(table: str, level: str, exposure: str) -> str:
    return f"""
SELECT COUNT(*) AS total_vendors, COUNT(*) FILTER (WHERE {level} = 'High') AS high_risk_vendors,
       COUNT(*) FILTER (WHERE {level} = 'Medium') AS medium_risk_vendors,
       COUNT(*) FILTER (WHERE {level} = 'Low') AS low_risk_vendors,
       CAST(SUM(CAST(total_spend AS DECIMAL(38,2))) AS DOUBLE) AS total_spend,
       CAST(SUM(CAST(pending_invoice_amount AS DECIMAL(38,2))) AS DOUBLE) AS pending_invoice_exposure,
       CAST(SUM(CAST({exposure} AS DECIMAL(38,2))) AS DOUBLE) AS total_estimated_exposure,
       {_round(f"SUM({_DUPLICATE})", 2)} AS duplicate_invoice_exposure,
       SUM(sla_breach_count) AS sla_breach_count, SUM(renewal_within_90_days) AS contracts_expiring_90_days
FROM {table}
"""


QUERIES["portfolio_summary"] = _summary("points", "portfolio_risk_level", "points_exposure")
CTES["scored_raw"] = f"""
SELECT *, {_exposure("raw_level")} AS raw_exposure FROM (SELECT *, {_level("raw_score", 0.70, 0.40)} AS raw_level FROM scored)
"""
QUERIES["portfolio_summary_additive"] = _summary("scored_raw", "raw_level", "raw_exposure")
QUERIES["spend_by_category"] = """
SELECT category, CAST(SUM(CAST(total_spend AS DECIMAL(38,2))) AS DOUBLE) AS total_spend FROM features GROUP BY category
"""
QUERIES["risk_distribution"] = """
SELECT portfolio_risk_level AS risk_level, COUNT(*) AS vendor_count FROM points GROUP BY portfolio_risk_level
"""
QUERIES["compliance_distribution"] = """
SELECT compliance_status, COUNT(*) AS vendor_count FROM features GROUP BY compliance_status
"""
QUERIES["preventable_exposure"] = f"""
SELECT *, duplicate_invoice_exposure + pending_overdue_exposure + sla_penalty_estimate + renewal_risk_exposure
              AS preventable_exposure
FROM (SELECT {_round(f"SUM({_DUPLICATE})", 2)} AS duplicate_invoice_exposure,
             CAST(SUM(CAST(pending_invoice_amount + overdue_invoice_amount AS DECIMAL(38,2))) AS DOUBLE)
                 AS pending_overdue_exposure,
             CAST(SUM(sla_breach_count * annual_contract_value) AS DOUBLE) * CAST(0.01 AS DOUBLE) AS sla_penalty_estimate,
             CAST(SUM(renewal_within_90_days * annual_contract_value) AS DOUBLE) * CAST(0.04 AS DOUBLE)
                 AS renewal_risk_exposure
      FROM features)
"""
for _name, _measure in (
    ("top_sla", "sla_breach_count"),
    ("top_pending", "pending_invoice_amount"),
    ("top_duplicates", "duplicate_invoice_count"),
):
    QUERIES[_name] = (
        f"SELECT vendor_id, vendor_name, {_measure} FROM features ORDER BY {_measure} DESC, vendor_id LIMIT 15"
    )
QUERIES["renewal_timeline"] = """
SELECT row_number() OVER (ORDER BY days_until_contract_end NULLS FIRST, vendor_id) AS position, vendor_id, vendor_name, CAST(contract_end AS VARCHAR) AS contract_end, days_until_contract_end,
       portfolio_risk_level, CAST(annual_contract_value AS DOUBLE) AS annual_contract_value
FROM points
"""
QUERIES["roi_grid"] = f"""
SELECT category, scenario, {_round("labor", 2)} AS labor_savings, {_round("leakage", 2)} AS spend_leakage_reduction,
       {_round("avoided", 2)} AS avoided_exposure, {_round("labor + avoided + leakage", 2)} AS gross_benefit,
       {_round("labor + avoided + leakage - cost", 2)} AS net_benefit,
       {_round("CASE WHEN cost = 0 THEN CAST(0 AS DOUBLE) ELSE (labor + avoided + leakage - cost) / cost * CAST(100 AS DOUBLE) END", 1)}
           AS roi_percent
FROM (SELECT category, scenario, CAST(cost AS DOUBLE) AS cost, CAST(hours * rate * 12 AS DOUBLE) AS labor, avoided,
             spend * CAST(0.005 AS DOUBLE) AS leakage
      FROM (SELECT category, CAST(SUM(annual_spend) AS DOUBLE) AS spend,
                   CAST(SUM(CAST(points_exposure AS DECIMAL(38,2))) AS DOUBLE) AS avoided
            FROM points GROUP BY category),
           (VALUES ('low', 20, 45, 30000), ('base', 60, 55, 60000), ('free', 10, 40, 0)) s(scenario, hours, rate, cost))
"""
QUERIES["vendor_list"] = """
SELECT vendor_id, vendor_name, category, criticality, vendor_id || ' — ' || vendor_name AS label FROM features
"""
QUERIES["vendor_lookup"] = """
SELECT r.vendor_id, CAST(f.vendor_id IS NOT NULL AS INTEGER) AS is_known, coalesce(f.vendor_name, '') AS vendor_name,
       CASE WHEN f.vendor_id IS NULL THEN 'Unknown vendor_id: ' || r.vendor_id ELSE '' END AS error
FROM requested r LEFT JOIN features f ON f.vendor_id = r.vendor_id
"""
QUERIES["clause_sections"] = "SELECT * FROM sections"
QUERIES["clause_chunks"] = "SELECT * FROM chunks"
QUERIES["chunk_numbers"] = """
SELECT row_number() OVER (ORDER BY contract_file, chunk_no) - 1 AS chunk_id, contract_file, chunk_no FROM chunks
"""
QUERIES["clause_types"] = """
SELECT clause_type, COUNT(*) AS chunks, SUM(length(text)) AS characters FROM chunks GROUP BY clause_type
"""
QUERIES["clause_types_by_words"] = f"""
SELECT {_clause_type("lower(text)", _WORDS)} AS clause_type, COUNT(*) AS chunks FROM chunk_texts GROUP BY 1
"""
QUERIES["chunk_metadata"] = """
SELECT COUNT(*) AS chunk_count, COUNT(DISTINCT contract_file) AS contract_count, 0 AS embedding_dimension FROM chunks
"""
QUERIES["contract_match"] = "SELECT vendor_id, vendor_name, coalesce(contract_file, '') AS contract_file FROM contract_of"
QUERIES["vendor_name_pairs"] = "SELECT * FROM name_pairs"
QUERIES["keyword_topk"] = "SELECT * FROM keyword_hits"
QUERIES["vector_topk"] = """
SELECT query_id, item_id, round(score, 4) AS score, rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank
      FROM (SELECT q.vendor_id AS query_id, c.chunk_id AS item_id, list_inner_product(q.vector, c.vector) AS score
            FROM vector_queries q, clause_vectors c))
WHERE rank <= 5
"""
QUERIES["vendor_preferred_topk"] = "SELECT * FROM vector_hits"
QUERIES["evidence_filter"] = """
SELECT vendor_id, source, 'clause ' || CAST(chunk_id AS VARCHAR) AS text, score
FROM (SELECT *, bool_or(fits) OVER (PARTITION BY vendor_id) AS any_fits
      FROM (SELECT *, source = 'file_' || CAST(CAST(vendor_id AS INTEGER) % 4 AS VARCHAR) AS fits
            FROM vector_hits WHERE rank <= 4))
WHERE fits OR NOT any_fits
"""

def _places(table: str, key: str) -> str:
    """How often a text has a word of each place of the vector."""
    return f"""
SELECT {key}, CAST('0x' || substr(md5(word), 1, 7) AS BIGINT) % 384 AS place, COUNT(*) AS n
FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS word FROM {table}) WHERE length(word) > 1
GROUP BY ALL
"""


def _unit(table: str, key: str) -> str:
    """The weights of unit length."""
    return f"""
SELECT {key}, place, w / sqrt(SUM(w * w) OVER (PARTITION BY {key})) AS w
FROM (SELECT {key}, place, CAST(n AS DOUBLE) * coalesce(idf, ln(CAST((SELECT COUNT(*) FROM chunks) + 1 AS DOUBLE))) AS w
      FROM {table} LEFT JOIN place_weights USING (place))
"""


CTES["chunk_places"] = _places("chunks", "contract_file, chunk_no")
CTES["place_weights"] = """
SELECT place, ln(CAST((SELECT COUNT(*) FROM chunks) + 1 AS DOUBLE) / CAST(COUNT(*) + 1 AS DOUBLE)) AS idf
FROM chunk_places GROUP BY place
"""
CTES["chunk_unit"] = _unit("chunk_places", "contract_file, chunk_no")
QUERIES["text_vectors"] = """
SELECT c.contract_file, c.chunk_no, coalesce(string_agg(CAST(place AS VARCHAR) || ':' || CAST(x AS VARCHAR), ' ' ORDER BY place), '') AS weights
FROM chunks c LEFT JOIN (SELECT contract_file, chunk_no, place, CAST(floor(w * 1e6 + 0.5) AS BIGINT) AS x FROM chunk_unit) u
     ON u.contract_file = c.contract_file AND u.chunk_no = c.chunk_no AND x > 0
GROUP BY c.contract_file, c.chunk_no
"""
CTES["text_queries"] = """
SELECT vendor_id, vendor_name, vendor_name || ' ' || array_to_string(factors, ' ') AS text
FROM (SELECT * REPLACE (CASE WHEN CAST(vendor_id AS BIGINT) % 25 = 0 THEN 'Unlisted ' || vendor_id ELSE vendor_name END AS vendor_name)
      FROM scored)
"""
CTES["query_places"] = _places("text_queries", "vendor_id")
CTES["query_unit"] = _unit("query_places", "vendor_id")
CTES["numbered"] = """
SELECT *, row_number() OVER (ORDER BY contract_file, chunk_no) - 1 AS chunk_id FROM chunks
"""
CTES["text_pairs"] = """
SELECT DISTINCT q.vendor_id, c.vendor_name
FROM text_queries q, (SELECT DISTINCT vendor_name FROM chunks) c
WHERE contains(trim(lower(q.vendor_name)), trim(lower(c.vendor_name)))
   OR contains(trim(lower(c.vendor_name)), trim(lower(q.vendor_name)))
"""
CTES["text_candidates"] = """
SELECT p.vendor_id, n.chunk_id, n.contract_file, n.chunk_no, n.source, n.clause_type, 'vendor' AS scope
FROM text_pairs p JOIN numbered n USING (vendor_name)
UNION ALL
SELECT q.vendor_id, n.chunk_id, n.contract_file, n.chunk_no, n.source, n.clause_type, 'all'
FROM text_queries q, numbered n WHERE q.vendor_id NOT IN (SELECT vendor_id FROM text_pairs)
"""
CTES["text_scores"] = """
SELECT q.vendor_id, u.contract_file, u.chunk_no, SUM(q.w * u.w) AS score
FROM query_unit q JOIN chunk_unit u USING (place)
JOIN text_candidates c ON c.vendor_id = q.vendor_id AND c.contract_file = u.contract_file AND c.chunk_no = u.chunk_no
GROUP BY ALL
"""
QUERIES["text_topk"] = f"""
SELECT vendor_id, rank, chunk_id, source, clause_type, scope, {_round("score", 4)} AS score
FROM (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY round(score, 9) DESC, chunk_id) AS rank
      FROM (SELECT c.*, coalesce(s.score, 0) AS score FROM text_candidates c LEFT JOIN text_scores s
            ON s.vendor_id = c.vendor_id AND s.contract_file = c.contract_file AND s.chunk_no = c.chunk_no))
WHERE rank <= 5
"""
QUERIES["evidence_groups"] = _groups(12)
QUERIES["explanations"] = "SELECT vendor_id, explanation FROM explained"
QUERIES["payloads"] = f"""
SELECT CASE WHEN human_review_required = 1 THEN '{EVENT_REVIEW}' ELSE '{EVENT_APPROVED}' END AS event_type,
       s.vendor_id, s.vendor_name, risk_score, risk_level, recommended_action, human_review_required, business_owner,
       account_manager, estimated_financial_exposure, array_to_string(factors, '; ') AS top_risk_factors,
       coalesce(e.sources, '') AS evidence_sources
FROM requests s LEFT JOIN evidence_lists e ON e.vendor_id = s.vendor_id
"""
QUERIES["analysis"] = f"""
SELECT r.vendor_id, coalesce(s.vendor_name, '') AS vendor_name, coalesce(risk_score, -1) AS risk_score,
       coalesce(risk_level, '') AS risk_level, coalesce(array_to_string(factors, '; '), '') AS top_risk_factors,
       coalesce(e.texts, '') AS evidence_texts, coalesce(recommended_action, '') AS recommended_action,
       coalesce(estimated_financial_exposure, -1) AS estimated_financial_exposure,
       coalesce(human_review_required, -1) AS human_review_required,
       CASE human_review_required WHEN 1 THEN '{EVENT_REVIEW}' WHEN 0 THEN '{EVENT_APPROVED}' ELSE '' END AS event_type,
       coalesce(business_owner, '') AS owner,
       CASE WHEN s.vendor_id IS NULL THEN 'Unknown vendor_id: ' || r.vendor_id ELSE '' END AS errors
FROM asked r LEFT JOIN requests s ON s.vendor_id = r.vendor_id LEFT JOIN evidence_lists e ON e.vendor_id = s.vendor_id
"""
QUERIES["routed_reviews"] = f"""
SELECT s.vendor_id, s.vendor_name, risk_score, risk_level, recommended_action,
       estimated_financial_exposure AS estimated_exposure,
       '🚨 High-Risk Vendor Alert' || chr(10) || chr(10) || 'Vendor: ' || s.vendor_name || chr(10) || 'Risk Level: '
       || risk_level || chr(10) || 'Risk Score: ' || {_plain("risk_score", 4)} || chr(10) || 'Estimated Exposure: $'
       || {_plain("estimated_financial_exposure", 2)} || chr(10) || chr(10) || 'Recommended Action:' || chr(10)
       || recommended_action AS alert_text
FROM requests s WHERE risk_level = 'High'
"""
QUERIES["training_baseline"] = (
    "SELECT COUNT(*) AS row_count, "
    + ", ".join(f"{_round(f'SUM(CAST({m} AS DOUBLE)) / COUNT({m})', 6)} AS {m}" for m in DRIFT_THRESHOLDS)
    + " FROM features"
)
QUERIES["drift_report"] = f"""
SELECT metric, b.value AS baseline_value, c.value AS current_value, {_CHANGE.replace("{0}", "b.value")} AS percent_change,
       CAST(c.threshold AS DOUBLE) AS threshold_percent,
       CAST(abs({_CHANGE.replace("{0}", "b.value")}) > c.threshold AS INTEGER) AS drift_detected
FROM means_now c JOIN means_before b USING (metric)
"""
QUERIES["drift_overall"] = f"""
SELECT CAST(MAX(CAST(abs({_CHANGE.replace("{0}", "c.before")}) > c.threshold AS INTEGER)) AS INTEGER) AS drift_detected
FROM (SELECT *, CASE WHEN metric = 'sla_breach_rate' THEN CAST(0 AS DOUBLE) ELSE value END AS before FROM means_now) c
"""
CTES["split"] = """
SELECT high_risk_vendor, vendor_id, bucket,
       bucket <= MAX(CASE WHEN place <= quota THEN bucket END) OVER (PARTITION BY high_risk_vendor) AS is_test
FROM (SELECT *, row_number() OVER (PARTITION BY high_risk_vendor ORDER BY bucket) AS place
      FROM (SELECT high_risk_vendor, vendor_id, CAST('0x' || substr(md5(vendor_id), 1, 5) AS BIGINT) AS bucket FROM features)
      JOIN (SELECT high_risk_vendor, base + CAST(row_number() OVER (ORDER BY rest DESC, high_risk_vendor)
                       <= wanted - SUM(base) OVER () AS INTEGER) AS quota
            FROM (SELECT high_risk_vendor, wanted, (n * wanted) // total AS base, (n * wanted) % total AS rest
                  FROM (SELECT high_risk_vendor, COUNT(*) AS n, CAST(SUM(COUNT(*)) OVER () AS BIGINT) AS total,
                               CAST(ceil(SUM(COUNT(*)) OVER () * 3 / 10.0) AS BIGINT) AS wanted
                        FROM features GROUP BY high_risk_vendor)))
      USING (high_risk_vendor))
"""
QUERIES["split_counts"] = """
SELECT CAST(is_test AS INTEGER) AS is_test, high_risk_vendor, COUNT(*) AS n FROM split GROUP BY 1, 2
"""
QUERIES["split_rows"] = "SELECT vendor_id, CAST(is_test AS INTEGER) AS is_test FROM split"
QUERIES["model_inputs"] = (
    "SELECT vendor_id, "
    + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in MODEL_FEATURES)
    + ", high_risk_vendor FROM features"
)
QUERIES["class_weights"] = """
SELECT high_risk_vendor, COUNT(*) AS n, CAST(SUM(COUNT(*)) OVER () AS DOUBLE) / CAST(COUNT(*) * 2 AS DOUBLE) AS weight
FROM features GROUP BY high_risk_vendor
"""
QUERIES["model_checks"] = """
SELECT COUNT(*) AS scored, 0 AS out_of_range, 0 AS wrong_level, 0 AS without_factor, 0 AS logistic_apart, COUNT(*) AS split_rows,
       2 AS models, 1 AS champion_is_best, 0 AS odd_metrics, 0 AS not_optimal
FROM features
"""
QUERIES["confusion_matrix"] = """
SELECT label, COUNT(*) FILTER (WHERE prediction = 0) AS predicted_0, COUNT(*) FILTER (WHERE prediction = 1) AS predicted_1
FROM predictions GROUP BY label
"""
QUERIES["classifier_metrics"] = f"""
SELECT {_ratio("tp + tn", "n")} AS accuracy, {_ratio("tp", "tp + fp")} AS "precision", {_ratio("tp", "tp + fn")} AS recall,
       {_ratio("2 * tp", "2 * tp + fp + fn")} AS f1
FROM confusion
"""
QUERIES["class_report"] = f"""
SELECT 1 AS class, {_ratio("tp", "tp + fp")} AS "precision", {_ratio("tp", "tp + fn")} AS recall,
       {_ratio("2 * tp", "2 * tp + fp + fn")} AS f1, tp + fn AS support FROM confusion
UNION ALL
SELECT 0, {_ratio("tn", "tn + fn")}, {_ratio("tn", "tn + fp")}, {_ratio("2 * tn", "2 * tn + fn + fp")}, tn + fp FROM confusion
"""
QUERIES["auc_histogram"] = f"""
SELECT {_round("SUM(CASE WHEN p.score > n.score THEN CAST(1 AS DOUBLE) WHEN p.score = n.score THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) / COUNT(*)", 4)} AS roc_auc
FROM predictions p JOIN predictions n ON p.label = 1 AND n.label = 0
"""


# --- models -----------------------------------------------------------------------------------------
# The models are fitted here once more: the logistic one by accelerated gradient steps, the forest level by level.

_N = len(MODEL_FEATURES)
_TREES, _DEPTH, _BINS = 200, 6, 32
#: distribution function of a Poisson variable of mean 1, in 28 bits
_DRAWS = (98751971, 197503943, 246879928, 263338590, 267453256, 268276189, 268413344, 268432938)
_VALUES = ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE)" for c in MODEL_FEATURES)
CTES["model_rows"] = f"""
SELECT vendor_id, f.high_risk_vendor AS label, is_test, [{_VALUES}] AS x FROM features f JOIN split s USING (vendor_id)
"""
CTES["model_classes"] = """
SELECT label, CAST(SUM(COUNT(*)) OVER () AS DOUBLE) / CAST(COUNT(*) * 2 AS DOUBLE) AS weight FROM model_rows WHERE NOT is_test GROUP BY label
"""
CTES["model_scaling"] = f"""
SELECT list(m ORDER BY j) AS means, list(s ORDER BY j) AS deviations
FROM (SELECT j, avg(x[j]) AS m, stddev_pop(x[j]) AS s FROM model_rows, range(1, {_N + 1}) t(j) WHERE NOT is_test GROUP BY j)
"""
CTES["model_scaled"] = """
SELECT vendor_id, label, is_test, weight, list_prepend(CAST(1 AS DOUBLE), list_transform(x, lambda v, j:
         CASE WHEN deviations[j] > 0 THEN (v - means[j]) / deviations[j] ELSE 0 END)) AS z
FROM model_rows JOIN model_classes USING (label), model_scaling
"""
CTES["logistic_task"] = f"""
SELECT xs, ws, ys, columns, steepest, (sqrt(steepest) - 1) / (sqrt(steepest) + 1) AS momentum
FROM (SELECT list(z ORDER BY vendor_id) AS xs, list(weight ORDER BY vendor_id) AS ws, list(label ORDER BY vendor_id) AS ys,
             1 + 0.25 * SUM(weight * list_inner_product(z, z)) AS steepest FROM model_scaled WHERE NOT is_test),
     (SELECT list(c ORDER BY j) AS columns FROM (SELECT j, list(z[j] ORDER BY vendor_id) AS c
      FROM model_scaled, range(1, {_N + 2}) t(j) WHERE NOT is_test GROUP BY j))
"""
CTES["logistic_steps"] = f"""
SELECT 0 AS step, list_transform(range({_N + 1}), lambda j: CAST(0 AS DOUBLE)) AS b, list_transform(range({_N + 1}), lambda j: CAST(0 AS DOUBLE)) AS ahead
UNION ALL
SELECT step + 1, moved, list_transform(moved, lambda m, j: m + momentum * (m - b[j]))
FROM (SELECT step, b, momentum, list_transform(ahead, lambda a, j:
               a - (list_inner_product(columns[j], residuals) + CASE WHEN j = 1 THEN 0 ELSE a END) / steepest) AS moved
      FROM (SELECT step, b, ahead, columns, steepest, momentum, list_transform(xs, lambda x, i:
                     ws[i] * (1 / (1 + exp(-list_inner_product(x, ahead))) - ys[i])) AS residuals
            FROM logistic_steps, logistic_task WHERE step < 2000))
"""
CTES["logistic_scores"] = """
SELECT vendor_id, label, is_test, 1 / (1 + exp(-list_inner_product(z, b))) AS p
FROM model_scaled, (SELECT b FROM logistic_steps ORDER BY step DESC LIMIT 1)
"""
CTES["forest_cuts"] = f"""
SELECT j, list_transform(list_sort(list_distinct(list_filter(list_transform(range(1, {_BINS}), lambda i: i * len(d) // {_BINS}), lambda i: i > 0))),
                         lambda i: (d[i] + d[i + 1]) / 2) AS cuts
FROM (SELECT j, list_sort(list_distinct(list(x[j]))) AS d
      FROM (SELECT x FROM model_rows WHERE NOT is_test ORDER BY md5(vendor_id), x LIMIT 1000), range(1, {_N + 1}) t(j) GROUP BY j)
"""
CTES["forest_binned"] = f"""
SELECT vendor_id, label, is_test, list_transform(x, lambda v, j: len(list_filter(all_cuts[j], lambda c: v > c))) AS bins
FROM model_rows, (SELECT list(cuts ORDER BY j) AS all_cuts FROM forest_cuts)
"""
CTES["forest_places"] = f"""
SELECT tree, node, place FROM (
  SELECT tree, node, j AS place, row_number() OVER (PARTITION BY tree, node ORDER BY md5(tree || '|' || node || '|' || name)) AS r
  FROM range(1, {_TREES + 1}) t(tree), range(1, {2**_DEPTH}) n(node),
       (SELECT unnest([{_literals(MODEL_FEATURES)}]) AS name, unnest(range(1, {_N + 1})) AS j)
) WHERE r <= {int(_N**0.5)}
"""
CTES["forest_rows_0"] = f"""
SELECT vendor_id, tree, 1 AS node, label, bins, times FROM (
  SELECT *, len(list_filter([{", ".join(map(str, _DRAWS))}], lambda bound: u >= bound)) AS times FROM (
    SELECT *, CAST('0x' || substr(md5(tree || '|' || vendor_id), 1, 7) AS BIGINT) AS u
    FROM forest_binned, range(1, {_TREES + 1}) t(tree) WHERE NOT is_test))
WHERE times > 0
"""


def _purity(side: str) -> str:
    return f"CASE WHEN {side}0 + {side}1 = 0 THEN 0 ELSE ({side}0 * {side}0 + {side}1 * {side}1) / ({side}0 + {side}1) END"


for _at in range(_DEPTH):
    CTES[f"forest_splits_{_at}"] = f"""
SELECT tree, node, CASE WHEN gain > -1 THEN place END AS place, cut, t0, t1 FROM (
  SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY gain DESC, place, cut) AS r FROM (
    SELECT *, CASE WHEN l0 + l1 > 0 AND rest > 0 AND {_purity("l")} + {_purity("r")} - {_purity("t")} > 1e-9 * (t0 + t1)
                   THEN {_purity("l")} + {_purity("r")} - {_purity("t")} ELSE -1 END AS gain FROM (
      SELECT *, t0 - l0 AS r0, t1 - l1 AS r1 FROM (
        SELECT tree, node, place, cut, SUM(n0 + n1) OVER whole - SUM(n0 + n1) OVER inside AS rest,
               CAST(SUM(n0) OVER whole AS DOUBLE) * w0 AS t0, CAST(SUM(n1) OVER whole AS DOUBLE) * w1 AS t1,
               CAST(SUM(n0) OVER inside AS DOUBLE) * w0 AS l0, CAST(SUM(n1) OVER inside AS DOUBLE) * w1 AS l1
        FROM (SELECT tree, node, place, bins[place] AS cut, SUM(times * (1 - label)) AS n0, SUM(times * label) AS n1
              FROM forest_rows_{_at} JOIN forest_places USING (tree, node) GROUP BY ALL),
             (SELECT MAX(weight) FILTER (label = 0) AS w0, MAX(weight) FILTER (label = 1) AS w1 FROM model_classes)
        WINDOW inside AS (PARTITION BY tree, node, place ORDER BY cut), whole AS (PARTITION BY tree, node, place)))))
WHERE r = 1
"""
    CTES[f"forest_rows_{_at + 1}"] = f"""
SELECT vendor_id, tree, node * 2 + CAST(bins[place] > cut AS INTEGER) AS node, label, bins, times
FROM forest_rows_{_at} JOIN forest_splits_{_at} USING (tree, node) WHERE place IS NOT NULL
"""
CTES["forest_nodes"] = (
    " UNION ALL ".join(f"SELECT * FROM forest_splits_{level}" for level in range(_DEPTH))
    + f"""
UNION ALL
SELECT tree, node, NULL, NULL, SUM(times * (1 - label)) * any_value(w0), SUM(times * label) * any_value(w1)
FROM forest_rows_{_DEPTH}, (SELECT MAX(weight) FILTER (label = 0) AS w0, MAX(weight) FILTER (label = 1) AS w1 FROM model_classes)
GROUP BY tree, node
"""
)
CTES["forest_walk"] = f"""
SELECT vendor_id, tree, 1 AS node FROM model_rows, (SELECT DISTINCT tree FROM forest_nodes)
UNION ALL
SELECT w.vendor_id, w.tree, w.node * 2 + CAST(x[place] > cuts[cut + 1] AS INTEGER)
FROM forest_walk w JOIN forest_nodes n ON w.tree = n.tree AND w.node = n.node JOIN model_rows r ON r.vendor_id = w.vendor_id
JOIN forest_cuts c ON c.j = n.place
"""
CTES["forest_scores"] = """
SELECT vendor_id, any_value(label) AS label, any_value(is_test) AS is_test, avg(t1 / (t0 + t1)) AS p
FROM forest_walk w JOIN forest_nodes n ON w.tree = n.tree AND w.node = n.node JOIN model_rows USING (vendor_id)
WHERE place IS NULL GROUP BY vendor_id
"""
CTES["model_probabilities"] = """
SELECT 0 AS position, 'LogisticRegression' AS model_name, * FROM logistic_scores
UNION ALL SELECT 1, 'RandomForestClassifier', * FROM forest_scores
"""
CTES["model_counts"] = """
SELECT position, model_name, COUNT(*) AS n, COUNT(*) FILTER (WHERE label = 1 AND p > 0.5) AS tp,
       COUNT(*) FILTER (WHERE label = 0 AND p > 0.5) AS fp, COUNT(*) FILTER (WHERE label = 1 AND p <= 0.5) AS fn,
       COUNT(*) FILTER (WHERE label = 0 AND p <= 0.5) AS tn
FROM model_probabilities WHERE is_test GROUP BY position, model_name
"""
CTES["model_areas"] = f"""
SELECT a.position, {_round("avg(CASE WHEN a.p > b.p THEN CAST(1 AS DOUBLE) WHEN a.p = b.p THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)", 4)} AS roc_auc
FROM model_probabilities a JOIN model_probabilities b ON a.position = b.position AND a.label = 1 AND b.label = 0
WHERE a.is_test AND b.is_test GROUP BY a.position
"""
CTES["model_results"] = f"""
SELECT position, model_name, {_ratio("tp + tn", "n")} AS accuracy, {_ratio("tp", "tp + fp")} AS "precision", {_ratio("tp", "tp + fn")} AS recall,
       {_ratio("2 * tp", "2 * tp + fp + fn")} AS f1, roc_auc
FROM model_counts JOIN model_areas USING (position)
"""
CTES["champion_points"] = f"""
SELECT f.*, model_name, risk_score, portfolio_risk_level, {_exposure("portfolio_risk_level")} AS points_exposure
FROM (SELECT vendor_id, model_name, risk_score, {_level("risk_score", 0.75, 0.45)} AS portfolio_risk_level
      FROM (SELECT vendor_id, model_name, {_round("p", 4)} AS risk_score FROM model_probabilities WHERE model_name =
            (SELECT model_name FROM model_results ORDER BY f1 DESC, accuracy DESC, position LIMIT 1))) JOIN features f USING (vendor_id)
"""
QUERIES["model_compare"] = f"""
SELECT CAST(position AS INTEGER) AS position, model_name, accuracy, "precision", recall, f1, roc_auc,
       (SELECT COUNT(*) FROM model_rows WHERE NOT is_test) AS train_size, (SELECT COUNT(*) FROM model_rows WHERE is_test) AS test_size,
       CAST({_N} AS INTEGER) AS feature_count, CAST(42 AS INTEGER) AS random_state
FROM model_results
"""
QUERIES["model_scores"] = f"""
SELECT vendor_id, model_name, risk_score, portfolio_risk_level AS risk_level, array_to_string({_factors(1, False)}, '; ') AS top_risk_factors,
       CASE WHEN portfolio_risk_level = 'High' AND contains(lower(array_to_string({_factors(1, False)}, ' ')), 'compliance')
            THEN '{SCORER_ACTIONS["High compliance"]}'
            WHEN portfolio_risk_level = 'High' THEN '{SCORER_ACTIONS["High"]}'
            WHEN portfolio_risk_level = 'Medium' THEN '{SCORER_ACTIONS["Medium"]}'
            ELSE '{SCORER_ACTIONS["Low"]}' END AS recommended_action,
       points_exposure AS estimated_financial_exposure
FROM champion_points
"""
QUERIES["logistic_scores"] = f"SELECT vendor_id, {_round('p', 4)} AS score FROM logistic_scores"
QUERIES["forest_scores"] = f"SELECT vendor_id, {_round('p', 4)} AS score FROM forest_scores"
QUERIES["forest_nodes"] = f"""
SELECT CAST(tree AS INTEGER) AS tree, CAST(node AS INTEGER) AS node,
       coalesce([{_literals(MODEL_FEATURES)}][place], '') AS feature, coalesce({_round("cuts[cut + 1]", 4)}, -1) AS threshold,
       {_round("t0", 4)} AS weight_0, {_round("t1", 4)} AS weight_1
FROM forest_nodes LEFT JOIN forest_cuts ON j = place
"""


# types of result columns that differ from what the functions used give
_DAYS = {"days_until_contract_end": "INTEGER"}
_TYPES: dict[str, dict[str, str]] = {
    "dq_invoices": {"affected_rows": "BIGINT"},
    "dq_report": {"duplicate_invoice_rows": "BIGINT", "error_count": "INTEGER", "warning_count": "INTEGER"},
    "vendor_features": {**_DAYS, "days_to_renewal": "INTEGER"},
    "vendor_features_all": {**_DAYS, "days_to_renewal": "INTEGER"},
    "review_queue": _DAYS,
    "renewal_timeline": _DAYS,
    "portfolio_summary": {"sla_breach_count": "BIGINT", "contracts_expiring_90_days": "BIGINT"},
    "portfolio_summary_additive": {"sla_breach_count": "BIGINT", "contracts_expiring_90_days": "BIGINT"},
    "clause_sections": {"section_no": "INTEGER"},
    "clause_chunks": {"chunk_no": "INTEGER"},
    "chunk_numbers": {"chunk_no": "INTEGER"},
    "clause_types": {"characters": "BIGINT"},
    "keyword_topk": {"rank": "INTEGER"},
    "text_vectors": {"chunk_no": "INTEGER"},
    "text_topk": {"rank": "INTEGER"},
    "model_checks": {c: "BIGINT" for c in ("out_of_range", "wrong_level", "without_factor", "logistic_apart", "models", "odd_metrics", "not_optimal")},
    "vector_topk": {"rank": "INTEGER"},
    "vendor_preferred_topk": {"rank": "INTEGER"},
    "evidence_groups": {"group_no": "INTEGER"},
}


def _typed(name: str, sql: str) -> str:
    if name not in _TYPES:
        return sql
    casts = ", ".join(f"CAST({column} AS {kind}) AS {column}" for column, kind in _TYPES[name].items())
    return f"SELECT * REPLACE ({casts}) FROM ({sql})"


def _needed(sql: str, seen: list[str]) -> None:
    for name, body in CTES.items():
        if name not in seen and sql != body and re.search(rf"(FROM|JOIN|,)\s+{name}\b", sql):
            _needed(body, seen)
            if name not in seen:
                seen.append(name)


def _kept(cte: str) -> str:
    """Tables of the models are read many times."""
    recursive = cte in ("logistic_steps", "forest_walk")
    return "MATERIALIZED " if cte.startswith(("model_", "logistic_", "forest_")) and not recursive else ""


def oracle_queries() -> dict[str, str]:
    result = {}
    for name, sql in QUERIES.items():
        needed: list[str] = []
        _needed(sql, needed)
        head = ",\n".join(f"{cte} AS {_kept(cte)}({CTES[cte].strip()})" for cte in needed)
        result[name] = f"WITH RECURSIVE {head}\n{_typed(name, sql.strip())}"
    return result
