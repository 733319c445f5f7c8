import pytest

from kinfold.plans import catalog, data_quality, writes
from tests.compare import assert_same, database

QUERIES = {**data_quality.QUERIES, **catalog.QUERIES, **writes.QUERIES}
ORACLE = {**data_quality.ORACLE, **catalog.ORACLE, **writes.ORACLE}


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, con, name):
    assert_same(spark, sf, con, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_entry_lists_every_query(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
