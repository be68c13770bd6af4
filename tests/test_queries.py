"""Each query that SQL can express against DuckDB on the same tables, and the driver's contract."""

import sys

import __spark_entry__ as entry
import pytest

from fluxtrace.plans import QUERIES, SQL
from tests.compare import assert_same, connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, name):
    assert_same(QUERIES[name](spark, data).toPandas(), connection(data).execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("missing", ["fluxtrace.llm.oracles", "fluxtrace.llm.queries"])
def test_entry_without_the_text_operators(monkeypatch, missing):
    monkeypatch.setitem(sys.modules, missing, None)  # importing it fails
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(SQL)


def test_entry_without_the_pipeline(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert "pipeline" not in entry.queries() and set(QUERIES) <= set(entry.queries())
