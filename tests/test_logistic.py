import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import folds
from tidemark.operators.logistic_cv import L1LogisticCV, choose, grid
from tidemark.operators.solvers import Rows


def table(spark, n=400, q=4):
    df = spark.range(n).select("id", *(F.when(F.rand(i) > 0.5, 1).otherwise(-1).cast("double").alias(f"f{i}") for i in range(q)))
    return df.withColumn("y", (F.col("f0") * 1.5 - F.col("f1") + F.randn(9) > 0).cast("int"))


def arrays(df, names):
    rows = df.select(*names, "y").toPandas()
    return rows[names].to_numpy(float), rows["y"].to_numpy()


@pytest.mark.parametrize("solver", ["cd", "saga", "liblinear", "fista", "hybrid"])
def test_optimal(spark, solver):
    df, names = table(spark).persist(), [f"f{i}" for i in range(4)]
    model = L1LogisticCV(labelCol="y", featureCols=names, rowIdCol="id", Cs=[0.01, 0.1, 1.0], solver=solver, tol=1e-8).fit(df)
    x, y = arrays(df, names)
    rows = Rows.of(x, y, np.ones(len(y)))
    w = np.array([model.coef[n] for n in names])
    assert rows.violation(w, model.intercept, 1 / (model.C * len(y))) < 1e-5
    assert model.C in model.Cs and len(model.losses) == 9


def test_mllib_agrees(spark):
    df, names = table(spark).persist(), [f"f{i}" for i in range(4)]
    params = {"labelCol": "y", "featureCols": names, "rowIdCol": "id", "Cs": [0.05, 0.5], "tol": 1e-9}
    small, large = L1LogisticCV(**params).fit(df), L1LogisticCV(**params, pattern_limit=3).fit(df)
    assert small.C == large.C
    assert [small.coef[n] for n in names] == pytest.approx([large.coef[n] for n in names], abs=1e-4)
    assert sorted(r["loss"] for r in small.losses) == pytest.approx(sorted(r["loss"] for r in large.losses), abs=1e-5)


def test_mllib_agrees_without_ids(spark):
    """Folds that are dealt by pattern are the same on both paths."""
    df, names = table(spark, 200, 3).persist(), ["f0", "f1", "f2"]
    params = {"labelCol": "y", "featureCols": names, "Cs": [0.05, 0.5], "cv": 2, "tol": 1e-9}
    small, large = L1LogisticCV(**params).fit(df), L1LogisticCV(**params, pattern_limit=3).fit(df)
    assert [(r["fold"], r["path_pos"]) for r in large.losses] == [(r["fold"], r["path_pos"]) for r in sorted(small.losses, key=lambda r: (r["fold"], r["path_pos"]))]
    assert [r["loss"] for r in sorted(small.losses, key=lambda r: (r["fold"], r["path_pos"]))] == pytest.approx([r["loss"] for r in large.losses], abs=1e-5)
    assert [small.coef[n] for n in names] == pytest.approx([large.coef[n] for n in names], abs=1e-4)


def test_dealt_patterns_cover_all_rows(spark):
    df = table(spark, 101, 2)
    patterns = L1LogisticCV(labelCol="y", featureCols=["f0", "f1"], cv=4)._patterns(df, ["f0", "f1"]).collect()
    assert sum(sum(p.counts) for p in patterns) == 101
    assert all(max(p.counts) - min(p.counts) <= 1 for p in patterns)


def test_choice():
    losses = [{"fold": f, "path_pos": p, "loss": v} for f, row in enumerate([[3, 2, 1.9], [3, 2, 2.4], [3, 2.2, 1.5]]) for p, v in enumerate(row)]
    assert choose(losses, "min") == 2
    assert choose(losses, "1se") == 1
    tied = [{"fold": 0, "path_pos": p, "loss": 1.0} for p in range(3)]
    assert choose(tied, "min") == 0
    with pytest.raises(ValueError):
        choose([{"fold": 0, "path_pos": 0, "loss": float("nan")}], "min")


def test_grid():
    assert grid(3) == pytest.approx([1e-4, 1, 1e4])
    assert grid([5, 1]) == [1, 5]
    with pytest.raises(ValueError):
        grid([0.0])


def test_errors(spark):
    df = spark.createDataFrame([(1.0, 1), (0.0, 0), (1.0, 2)], "x double, y int")
    for bad in ({"solver": "newton"}, {"penalty": "l2"}, {"scoring": "auc"}, {"cv": 1}, {"cv_rule": "2se"}):
        with pytest.raises(ValueError):
            L1LogisticCV(labelCol="y", featureCols=["x"], **bad).fit(df)
    with pytest.raises(ValueError):
        L1LogisticCV(labelCol="y", featureCols=["x"]).fit(df)
    with pytest.raises(ValueError):
        L1LogisticCV(labelCol="y", featureCols=["x"]).fit(df.limit(0))
    with pytest.raises(TypeError):
        L1LogisticCV(label="y")


def test_zero_clamp_and_one_class(spark):
    df = spark.createDataFrame([(float(i % 2), 1) for i in range(9)], "x double, y int")
    model = L1LogisticCV(labelCol="y", featureCols=["x"], Cs=[1.0], cv=3).fit(df)
    assert model.coef == {"x": 0.0} and np.isfinite(model.intercept)
    df = table(spark)
    assert L1LogisticCV(labelCol="y", featureCols=["f0"], Cs=[1.0], zero_clamp=99.0).fit(df).coef == {"f0": 0.0}


@pytest.mark.parametrize("n,k", [(10, 3), (7, 7), (100, 8), (5, 2)])
def test_fold_sizes(spark, n, k):
    df = spark.range(n)
    want = sorted(len(p) for p in np.array_split(np.arange(n), k))
    for split in (folds.hash_folds(df, ["id"], k, 1), folds.exact_folds(df, "id", k, 42), folds.key_folds(df, "id", k)):
        assert sorted(r["count"] for r in split.groupBy("fold").count().collect()) == want
    order = np.arange(n)
    np.random.default_rng(42).shuffle(order)
    exact = {r.id: r.fold for r in folds.exact_folds(df, "id", k, 42).collect()}
    assert [sorted(i for i in exact if exact[i] == f) for f in range(k)] == [sorted(p.tolist()) for p in np.array_split(order, k)]


def test_exact_folds_of_many_rows(spark):
    """6,000,000 rows, as events have at 60 times sf0.1: the folds NumPy gives, without a broadcast of them."""
    n, k = 6_000_000, 7
    order, want = np.arange(n), np.empty(n, np.int64)
    np.random.default_rng(42).shuffle(order)
    for i, part in enumerate(np.array_split(order, k)):
        want[part] = i
    got = folds.exact_folds(spark.range(5, n + 5), "id", k, 42)
    # The one broadcast is that of the ranges of ranks.
    assert got._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 1
    sums = got.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.sum(F.col("id") * F.col("id") % 1009).alias("mixed"))
    ids = np.arange(5, n + 5)
    assert {r.fold: (r.n, r.ids, r.mixed) for r in sums.collect()} == {f: (int((own := ids[want == f]).size), int(own.sum()), int((own * own % 1009).sum())) for f in range(k)}
    assert folds.exact_folds(spark.range(0), "id", k, 42).count() == 0


def test_split(spark):
    df = spark.range(1001)
    for seed in (None, 3):
        a, b = folds.train_test_split(df, "id", 0.7, seed)
        assert (a.count(), b.count(), a.intersect(b).count()) == (700, 301, 0)
    assert folds.train_test_split(df, "id", 0.7)[0].agg(F.max("id")).first()[0] == 699
