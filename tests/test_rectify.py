import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import quantiles, rectify
from tidemark.operators.rectify import Rectifier

NAN = float("nan")


def fit(spark, rows, schema="x double, y int", features=("x",), **params):
    return Rectifier(labelCol="y", featureCols=list(features), **params).fit(spark.createDataFrame(rows, schema))


def limit(model, i=0):
    return model.limits[i].lo, model.limits[i].hi


def test_toy_tables(spark):
    toy = [(0.1, 10, 0), (0.3, 13, 0), (0.7, 8, 1), (0.9, 5, 1)]
    more = [*toy, (0.2, 11, 0), (0.8, 4, 1)]
    schema = "feat_a double, feat_b int, y int"
    for rows in (toy, more):
        model = fit(spark, rows, schema, ("feat_a", "feat_b"))
        assert [limit(model, i) for i in (0, 1)] == [(0.7, None), (None, 8.0)]
    out = model.transform(spark.createDataFrame(toy, schema)).collect()
    assert [(r.feat_a, r.feat_b) for r in out] == [(-1, -1), (-1, -1), (1, 1), (1, 1)]
    assert dict(model.transform(spark.createDataFrame(toy, schema)).dtypes)["feat_a"] == "tinyint"


def test_edges_count_as_inside(spark):
    model = rectify.RectifierModel([rectify.Limit("x", "x", 0, 1.0, 2.0)], "n")
    out = model.transform(spark.createDataFrame([(1, NAN), (2, None), (3, 1.0), (4, 2.0), (5, 0.9), (6, 2.1), (7, float("inf"))], "id int, x double"))
    assert [(r.x, r.nx) for r in out.orderBy("id").collect()] == [(1, -1)] * 4 + [(-1, 1)] * 3
    assert out.columns == ["id", "x", "nx"]


def test_open_and_empty(spark):
    assert limit(fit(spark, [(1.0, 0), (2.0, 0)])) == (None, None)
    assert limit(fit(spark, [(1.0, 1), (1.0, 1), (5.0, 0)])) == (None, None)
    assert limit(fit(spark, [(1.0, 1), (1.0, 1)], sdfilter=None)) == (None, None)
    assert limit(fit(spark, [(1.0, 1), (float("inf"), 1), (0.0, 0)])) == (None, None)
    assert limit(fit(spark, [(NAN, 1), (None, 1), (2.0, 1), (4.0, 1), (1.0, 0), (9.0, 0)])) == (2.0, 4.0)
    assert limit(fit(spark, [(None, 1)])) == (None, None)
    assert limit(fit(spark, [])) == (None, None)


def test_snap_counts_all_rows(spark):
    rows = [(float(v), int(4 <= v <= 6)) for v in range(11)]
    assert limit(fit(spark, rows)) == (4.0, 6.0)
    assert limit(fit(spark, [*rows, (4.5, 0)] * 1, snap=0.4)) == (4.0, 6.0)
    assert limit(fit(spark, [*rows[2:], (20.0, 0)], snap=0.3)) == (None, 6.0)
    assert limit(fit(spark, [r for r in rows if r[0] > 3], snap=None)) == (4.0, 6.0)


def test_labels_other_than_zero_are_positive(spark):
    assert limit(fit(spark, [(1.0, -1), (3.0, 1)], sdfilter=None, snap=None)) == (1.0, 3.0)


def test_quantiles(spark):
    rows = [(float(v), 1) for v in range(101)]
    assert limit(fit(spark, rows, quantile_bounds=(0.1, 0.905), snap=None)) == (10.0, 90.5)
    with pytest.raises(ValueError):
        fit(spark, rows, quantile_bounds=(0.5, 0.5))


@pytest.mark.parametrize("params", [{}, {"quantile_bounds": (0.2, 0.7)}, {"sdfilter": None, "snap": 0.2}])
def test_long_form_agrees(spark, params):
    df = spark.range(300).select(*((F.rand(i) * 10).alias(f"f{i}") for i in range(7)), F.lit(None).cast("double").alias("g"), (F.rand(99) > 0.6).cast("int").alias("y"))
    names = df.columns[:-1]
    wide = Rectifier(labelCol="y", featureCols=names, **params).fit(df).limits
    long = Rectifier(labelCol="y", featureCols=names, wide=2, **params).fit(df).limits
    assert [(v.feature, v.group) for v in wide] == [(v.feature, v.group) for v in long]
    for a, b in zip(wide, long, strict=True):
        assert (a.lo, a.hi) == (pytest.approx(b.lo), pytest.approx(b.hi))


def test_columns_and_names(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1, "k")], "`a.b` double, b2 double, y int, key string")
    model = Rectifier(labelCol="y", exclude_features=["b2"]).fit(df)
    assert model.features == ["a.b"]
    with pytest.raises(ValueError):
        model.transform(df.drop("`a.b`").select("b2"))
    with pytest.raises(ValueError):
        Rectifier(labelCol="y", featureCols=["p", "P"]).fit(spark.createDataFrame([(1.0, 1)], "p double, y int"))


@pytest.mark.parametrize("wide", [500, 1])
@pytest.mark.parametrize("small", [3, 40, 10**6])
def test_quantiles_like_numpy(spark, monkeypatch, wide, small):
    """Narrowed down in rounds or read off at once; with ties, gaps and few values."""
    monkeypatch.setattr(quantiles, "SMALL", small)
    rng = np.random.default_rng(small)
    n = 700
    columns = [rng.normal(size=n), rng.integers(0, 4, n), np.exp(rng.normal(size=n) * 40), np.full(n, 7.0), np.where(rng.random(n) < 0.6, 0.0, rng.normal(size=n)), np.arange(n) * 1.0]
    columns[5][3:] = np.nan
    frame = pd.DataFrame({f"f{i}": c for i, c in enumerate(columns)} | {"g": np.full(n, np.nan), "y": 1})
    df = spark.createDataFrame(frame)
    for a, b in ((0.0, 1.0), (0.1, 0.85), (0.499, 0.5)):
        model = Rectifier(labelCol="y", featureCols=list(frame.columns[:-1]), wide=wide, sdfilter=None, snap=None, quantile_bounds=(a, b)).fit(df)
        for i, c in enumerate(columns):
            assert limit(model, i) == pytest.approx((np.nanquantile(c, a), np.nanquantile(c, b)))
        assert limit(model, 6) == (None, None)
