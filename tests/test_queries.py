import pytest

import __spark_entry__ as entry
from tests.conftest import data
from probelake.plans import queries
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, data()), queries.ORACLE_SQL[name], data())


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_lpm_is_an_equi_join(spark):
    plan = queries.prefix_lpm_lookup(spark, data())._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
