"""Every registered query of the engine against its SQL, on the smallest tables."""

import pytest
from conftest import same_rows

from tilequarry.plans.oracle import ORACLE_SQL
from tilequarry.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, small, duck, name):
    same_rows(QUERIES[name](spark, small), duck.execute(ORACLE_SQL[name]))


def test_all_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1


def test_prefetch_outcomes(spark, small):
    rows = QUERIES["prefetch_outcomes"](spark, small).limit(500).collect()
    assert rows
    for r in rows:
        if r["evicted_before_use"]:
            assert r["used_by_future_query"] is False and r["eviction_query_index"] is not None


def test_plans_use_no_cartesian_product(spark, small):
    df = QUERIES["hierarchical_search"](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" in plan
