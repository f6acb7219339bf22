"""Every registered engine query with SQL gives the SQL's rows."""

import pytest

from quivra import catalog
from tests.conftest import same_rows

NAMES = sorted(catalog.ORACLES)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, small, name):
    same_rows(catalog.QUERIES[name](spark, small), catalog.ORACLES[name], small)


def test_entry_imports(spark):
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark, small):
    from quivra.operators import kv
    from quivra.plans.kv_queries import log

    plan = kv.visible(log(spark, small), 500)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "props" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_top_k_is_cut_before_the_exchange(spark, small):
    plan = catalog.QUERIES["exact_knn"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
