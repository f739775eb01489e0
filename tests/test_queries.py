import pytest

from tests.oracle import SF_DIR, rows_of, rows_of_sql
from tidemark.queries import QUERIES, SQL, flagship

@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(spark, name):
    assert rows_of(QUERIES[name](spark, SF_DIR)) == rows_of_sql(SQL[name])


@pytest.mark.parametrize("name", ["fit_predict_l1", "experiment_grid"])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_flagship_finds_the_rule(spark):
    rows = flagship(spark, SF_DIR)
    assert rows.filter("prediction = label").count() > 0.9 * rows.count()
