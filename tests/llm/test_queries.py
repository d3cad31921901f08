"""Registered queries against their SQL, and the columns that each returns."""

import pytest

import __spark_entry__ as entry
from check import compare
from inciflow.llm import queries
from tests.conftest import SF


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_matches_sql(spark, con, name):
    ok, message = compare(spark, con, SF, name)
    assert ok, message


def test_all_operators_and_the_pipeline_are_registered():
    found = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 14)) and "pipeline" in entry.queries()
