"""The driver's contract: names, SQL and plans."""

from __future__ import annotations

import __spark_entry__ as e


def test_oracles_belong_to_queries():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 55


def test_flagship(spark):
    assert e.entry(spark).count() == 40


def test_scans_read_only_what_they_need(spark):
    plan = e.queries()["k1_bm25_corpus"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "lang" not in plan and "CartesianProduct" not in plan and "Python" not in plan
