"""Every query of the library runs; those with SQL give DuckDB's rows."""

import pytest

from compare import tables
import compare
from memquarry.plans import logs, registry, retrieval, sequences  # noqa: F401


@pytest.fixture(scope="module")
def con(data):
    return tables(data)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(name, spark, data, con):
    compare.same(registry.QUERIES[name](spark, data), con, registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(name, spark, data):
    assert registry.QUERIES[name](spark, data).count() > 0


def test_entry_runs_without_llm(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(registry.ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
