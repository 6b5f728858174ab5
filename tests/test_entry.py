"""The driver's entry: every query has a name of its own, SQL only for known ones, and a missing subpackage costs only its own queries."""

import sys

import __spark_entry__ as entry
from contactdq.plans import queries as base


def test_sql_is_for_known_queries():
    found, sql = entry.queries(), entry.oracle_sql()
    assert set(base.QUERIES) <= set(found) and set(sql) <= set(found) and all(callable(f) for f in found.values())


def test_base_queries_without_the_training_text_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "contactdq.llm.queries", None)
    assert set(entry.queries()) == set(base.QUERIES) and set(entry.oracle_sql()) == set(base.ORACLE_SQL)
