import pytest

from kinfold.llm import queries
from tests.compare import assert_same, database


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf, con, name):
    assert_same(spark, sf, con, queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_runs(spark, sf, name):
    queries.QUERIES[name](spark, sf).collect()
