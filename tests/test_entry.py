"""The driver's contract."""

import __spark_entry__ as contract


def test_names():
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 70


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert rows and {"risk_level", "n", "n_scam", "state"} == set(rows[0].asDict())
