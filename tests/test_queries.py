"""Every registered query against its SQL equivalent on the smallest tables."""

import duckdb
import pytest
from compare import connect, difference
from workload.registered import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir) -> duckdb.DuckDBPyConnection:
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, duck, name):
    mine = QUERIES[name](spark, sf_dir).toPandas()
    assert difference(mine, duck.execute(ORACLE[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    frame = contract.entry(spark)
    assert frame.columns == ["feature", "psi", "status", "baseline_rows", "current_rows", "psi_raw"]
    assert frame.count() == 5
