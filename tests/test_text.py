import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from procurisk.config import CLAUSE_KEYWORDS, SECTION_CLAUSE_TYPE
from procurisk.functions import text


def evaluate(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[1] for r in rows.select("i", expression(F.col("c")).alias("r")).orderBy("i").collect()]


def test_white_space_set_is_the_one_of_python():
    assert set(text.WS_CHARS) == {chr(i) for i in range(0x110000) if chr(i).isspace()}
    assert set(text.LINE_END_CHARS) == {
        chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and len(f"a{chr(i)}b".splitlines()) > 1
    }


def test_strip_and_collapse(spark):
    values = ["\t\n a b \x1f ", "", " ", "a  b", "x \n", "a  b\tc d"]
    assert evaluate(spark, values, text.strip_ws) == [v.strip() for v in values]
    assert evaluate(spark, values, text.rstrip_ws) == [v.rstrip() for v in values]
    assert evaluate(spark, values, text.collapse_ws) == [" ".join(v.split()) for v in values]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=" \t\n\r\x0b\x1c\x85 aB.-é_1", max_size=30), min_size=20, max_size=40))
def test_text_expressions_agree_with_python(spark, values):
    assert evaluate(spark, values, text.strip_ws) == [v.strip() for v in values]
    assert evaluate(spark, values, text.collapse_ws) == [" ".join(v.split()) for v in values]
    lines = evaluate(spark, values, lambda c: F.filter(text.lines_of(c), lambda x: x != ""))
    assert lines == [[x for x in v.splitlines() if x] for v in values]
    slugs = [re.sub("[^a-z0-9]+", "_", v.lower()).strip("_") for v in values]
    assert evaluate(spark, values, text.slug) == slugs


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.floats(min_value=-1e9, max_value=1e9, allow_nan=False), min_size=30, max_size=60),
    st.integers(min_value=0, max_value=4),
)
def test_rounding_agrees_with_python(spark, values, digits):
    values = values + [2.675, 0.125, 1.005, -2.5, 0.5, 1e8 + 0.125, -0.001]
    got = evaluate(spark, values, lambda c: text.round_half_even(c, digits), "double")
    assert got == [round(v, digits) for v in values]


def test_slug_and_file_name(spark):
    names = ["DataBridge Solutions", "  A&B -- Ltd. ", "Ünïcode GmbH", "___"]
    assert evaluate(spark, names, text.contract_file_name) == [
        "databridge_solutions_contract.txt",
        "a_b_ltd_contract.txt",
        "n_code_gmbh_contract.txt",
        "_contract.txt",
    ]


def test_vendor_name_from_contract(spark):
    def name(content, file_name="some_vendor_contract.txt"):
        return evaluate(spark, [content], lambda c: text.contract_vendor_name(c, F.lit(file_name)))[0]

    assert name("\n\n  Acme Corp master services AGREEMENT \nPayment") == "Acme Corp"
    assert name("Acme Services Agreement") == "Acme"
    assert name("Acme Agreement\r\nText") == "Acme"
    assert name("Acme Agreement for Services") == "Acme Agreement for Services"
    assert name("Agreement") == "Agreement"
    assert name(" \n ") == "some_vendor_contract"


def test_clause_types(spark):
    cases = {
        "Payment and SLA: x": "payment",
        "Service Level terms: payment": "sla",
        "Data Security: invoice": "general",
        "Escalation: audit": "general",
        "Misc: please send the invoice": "payment",
        "Misc: SOC 2 report": "compliance",
        "Misc: may terminate": "termination",
        "Misc: nothing here": "general",
        "renewal": "renewal",
    }
    got = evaluate(spark, list(cases), lambda c: text.detected_clause_type(c, CLAUSE_KEYWORDS))
    assert got == list(cases.values())
    headings = ["Payment Terms", "data security", "SLA OBLIGATIONS", "other"]
    got = evaluate(spark, headings, lambda c: text.section_clause_type(c, SECTION_CLAUSE_TYPE))
    assert got == ["payment", "general", "sla", "general"]


def test_preview(spark):
    texts = ["a" * 180, "a" * 181, "a" * 170 + " " * 20 + "b"]
    assert evaluate(spark, texts, lambda c: text.preview(c, 180)) == [
        "a" * 180,
        "a" * 177 + "...",
        "a" * 170 + "...",
    ]


def test_numbers_as_text(spark):
    values = [1234567.5, 0.5, 534400.0, 12345678901.25]
    assert evaluate(spark, values, text.money, "double") == [f"${v:,.0f}" for v in values]
    assert evaluate(spark, values, lambda c: text.plain_number(c, 2), "double") == [
        "1234567.5",
        "0.5",
        "534400",
        "12345678901.25",
    ]


def test_query_terms(spark):
    factors = F.array(F.lit("2 SLA breach events"), F.lit("$370,000 at risk"))
    terms = evaluate(spark, ["x"], lambda c: text.query_terms(factors, ("sla", "invoice")))[0]
    assert terms == ["sla", "breach", "events", "370", "000", "risk", "invoice"]
