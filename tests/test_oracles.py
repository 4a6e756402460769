"""Every registered query against its SQL twin in DuckDB; those without a twin must run and give rows."""

from __future__ import annotations

import pytest

from ledgerloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(name, spark, sf_dir, duck, same):
    same(registry.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
