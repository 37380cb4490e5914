import pytest

from readloom.plans.catalog import QUERIES, SQL

from .oracle import DATA, rows, run_sql

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), run_sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"small_rna_trim", "single_trim"}))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(SQL) <= set(e.oracle_sql()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
