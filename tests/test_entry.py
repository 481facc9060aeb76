"""The driver's contract."""

import __spark_entry__ as entry


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_are_callable():
    assert all(map(callable, entry.queries().values()))
