import pytest

from tests.oracle import SF_DIR, rows_of, rows_of_sql
from tidemark.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(spark, name):
    assert rows_of(QUERIES[name](spark, SF_DIR)) == rows_of_sql(SQL[name])
