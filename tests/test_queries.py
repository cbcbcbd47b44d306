"""Every registered query against its SQL, on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.run import connect, differences

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, con, sf_dir, name):
    assert differences(spark, con, sf_dir, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    rows = {r["section"]: r["score"] for r in entry(spark).collect()}
    assert set(rows) == {"Chat", "Chat Hard", "Safety", "Reasoning", "Score"}


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


LAZY = [n for n in sorted(QUERIES) if n[0] in "ftpc" and not n.startswith(("c1_", "c12", "p16"))] + ["a7_spearman", "m1_fit_ridge_probe"]


@pytest.mark.parametrize("name", LAZY)
def test_plan_has_no_cross_join_and_no_row_by_row_python(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert word not in plan
