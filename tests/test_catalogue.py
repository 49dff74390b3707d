"""Every registered query at the smallest scale, against its SQL where it has one."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
from compare import compare, duck
from nearfield.plans import catalogue

SF = "/root/testdata/sf0.001"
HERE = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def tables():
    if not Path(SF).exists():
        pytest.skip("no test tables on this machine")
    return duck(SF)


def test_entry_and_registration(spark):
    assert entry.entry(spark).columns == ["query_id", "rank", "id", "_score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, tables, name):
    text, _, _, fine = compare(spark, tables, SF, name, catalogue.QUERIES[name], catalogue.ORACLES.get(name))
    assert fine, text


def test_library_keeps_to_its_rules():
    for source in (HERE / "nearfield").rglob("*.py"):
        text = source.read_text()
        assert not re.search(r"localCheckpoint|crossJoin|\.rdd\.map", text), source
