from __future__ import annotations

import pytest

import __spark_entry__ as entry
from surveyloom.queries import operators, tables
from tests.check_queries import compare, connect

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


OWN = {**operators.QUERIES, **tables.QUERIES}


def test_every_query_has_sql():
    assert set(OWN) <= set(entry.queries()) and set(OWN) <= set(SQL)


@pytest.mark.parametrize("name", list(OWN))
def test_query_matches_sql(spark, name):
    assert [d for d in compare(entry.queries()[name](spark, SF), connect(SF), SQL[name]) if d != "no rows"] == []


def test_entry(spark):
    assert len(entry.entry(spark).collect()) > 0
