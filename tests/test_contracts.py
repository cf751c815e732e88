import pytest
from fixtures import CONTRACT
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from procurisk.operators import contracts as ops


def contracts(spark, *rows):
    return spark.createDataFrame(list(rows), "contract_file string, text string")


def chunks_of(spark, text):
    df = ops.clause_chunks(contracts(spark, ("a_contract.txt", text)))
    return [(r["text"], r["clause_type"]) for r in df.orderBy("chunk_no").collect()]


def test_chunks(spark):
    assert chunks_of(spark, CONTRACT) == [
        (
            "Payment Terms: Invoices are billed monthly. Undisputed invoices are paid by the due date.",
            "payment",
        ),
        ("SLA Obligations: Vendor keeps 95% service availability.", "sla"),
        (
            "SLA Obligations: An extra paragraph that belongs to the heading above it and has a second line.",
            "sla",
        ),
        ("Closing Remarks", "general"),
        ("Closing Remarks: Vendor keeps evidence of compliance after the closing heading.", "compliance"),
        ("Closing Remarks: Short but a sentence.", "general"),
    ]


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("Title only", []),
        ("", []),
        ("  \n \n ", []),
        ("Title\n\nsix words are in this line", ["General: six words are in this line"]),
        ("Title\n\nfive words in this line", ["five words in this line"]),
        ("Title\n\nA sentence.", ["General: A sentence."]),
        ("Title\n\nHead\nbody\n\n  \n\t\nmore text that follows on after it", ["Head: body", "Head: more text that follows on after it"]),
        ("Title\n\nHead  one\n  body\t x \n", ["Head one: body x"]),
        ("Title\r\n\r\nHead\r\nbody one\r\nbody two\r\n", ["Head: body one body two"]),
        ("Title\n\nEnds with period.\nbody", ["Ends with period.: body"]),
        ("Title\n\nFirst\nx\n\nSecond\n\nThird\ny", ["First: x", "Second", "Third: y"]),
        ("Title\n\none two three four five six\nsecond", ["General: one two three four five six second"]),
    ],
)
def test_heading_rules(spark, text, wanted):
    assert [t for t, _ in chunks_of(spark, text)] == wanted


def simple_chunks(text):
    """The chunk rules, one paragraph at a time."""
    import re

    heading, result = "General", []
    for paragraph in re.split(r"\n\s*\n+", text.strip())[1:]:
        lines = [" ".join(x.split()) for x in paragraph.splitlines() if x.strip()]
        few = bool(lines) and lines[0].count(" ") < 5
        if few and (len(lines) > 1 or not lines[0].endswith(".")):
            heading, lines = lines[0], lines[1:]
            result.append(f"{heading}: {' '.join(lines)}" if lines else heading)
        elif lines:
            result.append(f"{heading}: {' '.join(lines)}")
    return result


_LINE = st.lists(st.sampled_from(["a", "bb", "c.", "Payment", "x:"]), min_size=1, max_size=7).map(" ".join)
_TEXT = st.lists(st.tuples(_LINE, st.sampled_from(["\n", "\n\n", "\n \n", "\n\n\n", "\r\n", " \n\t\n"])), min_size=1, max_size=14)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(_TEXT, min_size=40, max_size=60))
def test_chunks_agree_with_brute_force(spark, texts):
    rows = [(f"{i:03d}.txt", "".join(a + b for a, b in parts)) for i, parts in enumerate(texts)]
    got = {}
    for r in ops.clause_chunks(contracts(spark, *rows)).collect():
        got.setdefault(r["contract_file"], {})[r["chunk_no"]] = r["text"]
    for name, text in rows:
        wanted = simple_chunks(text)
        assert [got.get(name, {}).get(i) for i in range(len(wanted))] == wanted
        assert len(got.get(name, {})) == len(wanted)


def test_sections(spark):
    text = "Acme Agreement\n\nPayment Terms\n pay \n\n now\nData Security\nRenewal Terms\nrenew\nPayment Terms\r\nagain\nPayment Terms and more"
    df = ops.clause_sections(contracts(spark, ("a.txt", text)))
    got = [(r["section_no"], r["heading"], r["text"], r["clause_type"]) for r in df.orderBy("section_no").collect()]
    assert got == [
        (0, "general", "Acme Agreement", "general"),
        (1, "Payment Terms", "pay\nnow", "payment"),
        (2, "Renewal Terms", "renew", "renewal"),
        (3, "Payment Terms", "again\nPayment Terms and more", "payment"),
    ]
    assert df.first()["vendor_name"] == "Acme"


def test_sections_with_other_headings(spark):
    df = ops.clause_sections(contracts(spark, ("a.txt", "x\nA (1)\ny")), ["A (1)"], {"a (1)": "kind"})
    assert [(r["heading"], r["clause_type"]) for r in df.orderBy("section_no").collect()] == [
        ("general", "general"),
        ("A (1)", "kind"),
    ]


@pytest.mark.parametrize("ranges", [1, 5])
def test_chunk_numbers_follow_the_file_names(spark, ranges):
    names = [f"{c}{i}" for c in "zab" for i in range(7)]
    text = "T\n\n" + "\n\n".join(f"six words make up paragraph {i}" for i in range(3))
    chunks = ops.clause_chunks(contracts(spark, *[(n, text) for n in names], ("empty", "T")))
    numbered = ops.number_chunks(chunks, ranges).collect()
    order = sorted((r["contract_file"], r["chunk_no"]) for r in numbered)
    assert {(r["contract_file"], r["chunk_no"]): r["chunk_id"] for r in numbered} == {k: i for i, k in enumerate(order)}
    assert len(numbered) == 63


def test_contract_match(spark):
    vendors = spark.createDataFrame(
        [("1", "Acme Corp"), ("2", "Beta"), ("3", "Gamma-Ray Ltd."), ("4", "Nobody"), ("5", "ärger AG"), ("6", None)],
        "vendor_id string, vendor_name string",
    )
    files = contracts(
        spark,
        ("acme_corp_contract.txt", ""),
        ("a_acme_corp_contract.txt", ""),
        ("the_beta_group_contract.txt", ""),
        ("old_beta_contract.txt", ""),
        ("beta_notes.txt", ""),
        ("x_Gamma_Ray_ltd_contract.txt", ""),
        ("ärger_ag_contract.txt", ""),
    )
    got = {r["vendor_id"]: r["contract_file"] for r in ops.match_contract_files(vendors, files).collect()}
    assert got == {
        "1": "acme_corp_contract.txt",
        "2": "old_beta_contract.txt",
        "3": "x_Gamma_Ray_ltd_contract.txt",
        "4": None,
        "5": "ärger_ag_contract.txt",
        "6": None,
    }


def test_white_space_ranges_are_those_of_the_lists():
    import re

    from procurisk.functions.text import LINE_END_CHARS, WS_CHARS

    every = "".join(map(chr, range(0x10000)))
    assert set(re.findall(f"[{ops.OTHER_ENDS}]", every)) == set(LINE_END_CHARS) - {"\n"}
    assert set(re.findall(f"[{ops.ODD_BLANKS}]", every)) == set(WS_CHARS) - set(LINE_END_CHARS) - {" "}


@settings(max_examples=1, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text("ab.é \t\n\r\x0b\x85  　", max_size=40), min_size=300, max_size=300))
def test_tidied_texts_are_their_tidied_lines(spark, texts):
    import re

    from procurisk.functions.text import LINE_END_CHARS, WS_CHARS

    def tidied(text):
        blocks = []
        for part in re.split(f"\n[{WS_CHARS}]*\n+", text.strip(WS_CHARS)):
            lines = [re.sub(f"[{WS_CHARS}]+", " ", line).strip(" ") for line in re.split(f"[{LINE_END_CHARS}]+", part)]
            blocks.append("\n".join(line for line in lines if line))
        return "\n\n".join(block for block in blocks if block)

    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select("text", ops._tidied(df["text"]).alias("tidied")).collect()
    assert [r["tidied"] for r in got] == [tidied(r["text"]) for r in got]
