import pytest

from keyrill.llm.queries import QUERIES, SQL
from tests.oracle import SF, rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert rows_of(QUERIES[name](spark, SF)) == rows_of_sql(SQL[name])
