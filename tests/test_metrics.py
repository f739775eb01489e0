import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics
from tidemark.operators.running import running


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, y int, s double, p int")


def test_youden(spark):
    rows = [(1, 0.0, 1), (1, 0.0, 0), (0, 0.0, 0), (0, 0.0, 0), (0, 0.0, 1)]
    assert metrics.youden_j(frame(spark, rows), "y", "p") == pytest.approx(0.5 + 2 / 3 - 1)
    assert metrics.youden_j(frame(spark, rows[:2]), "y", "p") == pytest.approx(-0.5)
    assert metrics.youden_j(frame(spark, []), "y", "p") == -1.0
    assert metrics.youden_table(frame(spark, []), "y", "p").first()["j"] == -1.0


def test_auc(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 500), rng.integers(0, 40, 500).astype(float)
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    assert metrics.roc_auc(frame(spark, [(int(a), float(b), 0) for a, b in zip(y, s, strict=True)]), "y", "s") == pytest.approx(want)
    assert metrics.roc_auc(frame(spark, [(1, 0.5, 0), (0, 0.5, 0)]), "y", "s") == 0.5
    for bad in ([(1, 0.1, 0)], [], [(1, 0.1, 0), (0, 0.2, 0), (2, 0.3, 0)]):
        with pytest.raises(ValueError):
            metrics.roc_auc(frame(spark, bad), "y", "s")


def test_pr_curve(spark):
    rows = [(1, 0.9, 0), (0, 0.9, 0), (1, 0.2, 0), (0, 0.5, 0)]
    got = [tuple(r) for r in metrics.pr_curve(frame(spark, rows), "y", "s", "id").orderBy("pos").collect()]
    assert got == [(0, 1.0, 0.0, 1.0), (1, 1.0, 0.5, 0.9), (2, 0.5, 0.5, 0.9), (3, pytest.approx(1 / 3), 0.5, 0.5), (4, 0.5, 1.0, 0.2)]
    assert metrics.pr_curve(frame(spark, []), "y", "s", "id").count() == 1
    assert {r.recall for r in metrics.pr_curve(frame(spark, [(0, 0.1, 0)]), "y", "s", "id").collect()} == {0.0}


@pytest.mark.parametrize("kind", ["many", "some", "constant", "mostly"])
def test_pr_curve_over_many_ranges(spark, kind):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 3000)
    s = {"many": rng.random(3000).round(2), "some": rng.integers(0, 3, 3000) / 2, "constant": np.full(3000, 0.5), "mostly": np.where(rng.random(3000) < 0.7, 0.3, rng.random(3000))}[kind]
    order = np.lexsort((np.arange(3000), -s))
    tp = np.cumsum(y[order])
    got = metrics.pr_curve(frame(spark, [(int(a), float(b), 0) for a, b in zip(y, s, strict=True)]), "y", "s", "id").orderBy("pos").toPandas()
    assert got["precision"].to_numpy()[1:] == pytest.approx(tp / np.arange(1, 3001))
    assert got["recall"].to_numpy()[1:] == pytest.approx(tp / y.sum())


def test_accuracy(spark):
    assert metrics.accuracy(frame(spark, [(1, 0.0, 1), (0, 0.0, 1)]), "y", "p") == 0.5


def test_ties_are_cut_into_ranges(spark):
    """Rows of one value don't meet in one window."""
    df = spark.range(20_000).selectExpr("id", "0.5D AS s")
    for descending in (False, True):
        out = running(df, "s", {"n": F.lit(1).cast("long")}, ["id"], descending)
        assert out.filter("n <> id + 1").count() == 0
    parts = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1
