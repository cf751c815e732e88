"""Contracts cut over many splits give what the row form gives."""

import random

import pytest

from procurisk.operators import contract_lines, contracts
from procurisk.sources import readers

LINES = [
    "Payment Terms", "Data Security", "a b c d e", "a b c d e f", "one.", "Invoices are due.", "x", " padded  line\t", "", " ", "\t", "",
    "", "SLA Obligations", "carriage\r", "\r", "next after", "\x0cform feed", "é 😀",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("contracts")
    choose = random.Random(12)
    for i in range(6):
        lines = [choose.choice(LINES) for _ in range(choose.randint(1, 400))]
        (path / f"c{i}_contract.txt").write_bytes("\n".join(lines).encode())
    (path / "blank_contract.txt").write_bytes(b" \n\n\t\n")
    (path / "empty_contract.txt").write_bytes(b"")
    (path / "title_contract.txt").write_bytes(b"\n\nAcme Corp  Master Services Agreement\n")
    (path / "other.dat").write_bytes(b"not a contract")
    return str(path)


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.files.openCostInBytes": "0"}
    for key, value in keys.items():
        spark.conf.set(key, value)
    yield
    for key in keys:
        spark.conf.unset(key)


def test_files_over_many_splits(spark, folder, small_splits):
    lines = readers.read_contract_lines(spark, folder)
    splits = lines.select("contract_file", "split_start").distinct().count()
    assert splits > 12 and lines.where("split_start > 0").count() > 0
    whole = readers.read_contracts(spark, folder)
    wanted = contracts.number_chunks(contracts.clause_chunks(whole), 3)
    got = contract_lines.clause_chunks(lines)
    assert got.columns == wanted.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect())) and got.count() > 50
    wanted = contracts.clause_sections(whole)
    got = contract_lines.clause_sections(lines)
    assert got.columns == wanted.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect())) and got.count() > 20


def test_no_lines(spark, folder):
    lines = readers.read_contract_lines(spark, folder).limit(0)
    assert contract_lines.clause_chunks(lines).count() == 0 and contract_lines.clause_sections(lines).count() == 0
