import pytest

pytest.importorskip("readloom.llm")
from readloom.llm.queries import QUERIES, SQL  # noqa: E402

from ..oracle import DATA, rows, run_sql  # noqa: E402

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), run_sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_registered(spark):
    import __spark_entry__ as e

    assert set(QUERIES) | {"pipeline"} <= set(e.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
