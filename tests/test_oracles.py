"""Every registered query of the engine's own operators runs, and agrees with its SQL where it has any."""

import pytest

from quarry import registry
from tests.compare import connect, rows_of_spark, rows_of_sql

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    cols, rows = rows_of_spark(QUERIES[name](spark, sf))
    assert cols
    if name in SQL:
        want_cols, want = rows_of_sql(duck, SQL[name])
        assert cols == want_cols
        assert rows == want


def test_each_query_is_known_once():
    assert len(QUERIES) >= 290
    assert set(SQL) <= set(QUERIES)
