"""Every registered audit query against its SQL on the smallest data."""

import pytest
from conftest import same_rows

from plumbline.plans.registry import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, sf, duck, name):
    same_rows(queries()[name](spark, sf), duck, oracle_sql()[name])


def test_every_query_has_sql():
    assert set(oracle_sql()) == set(queries())


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_latest_prunes_groups_before_the_shuffle(spark, sf):
    plan = queries()["latest_per_group"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_filters_reach_the_scan(spark, sf):
    plan = queries()["backfill_missing"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(p_size,10)" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan
