import pytest

from keyrill.plans.catalog import QUERIES, SQL
from tests.oracle import SF, rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    df = QUERIES[name](spark, SF)
    assert rows_of(df) == rows_of_sql(SQL[name])
