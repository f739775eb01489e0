import json

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from tidemark.operators import classifier, metrics, polish
from tidemark.operators.classifier import CriticalRangeClassifier, CriticalRangeModel
from tidemark.operators.dedupe import DuplicateColumnConsolidator
from tidemark.operators.logistic_cv import L1LogisticCV
from tidemark.operators.rectify import Rectifier
from tidemark.operators.scale import StandardScaler
from tidemark.plans import experiments
from tidemark.plans.experiments import ExperimentConfig, run_experiments
from tidemark.sources import frames, persist
from tidemark.streaming.score import append_to, apply

SIGNAL, NOISE = ([1 if c == "+" else -1 for c in signs] for signs in ("+++---+-", "-+-+-+-+"))


def twins(spark):
    rows = [(i, float(s), float(s), float(n), float(n), int(s > 0)) for i, (s, n) in enumerate(zip(SIGNAL, NOISE, strict=True))]
    return spark.createDataFrame(rows, "row_id long, P1_S_1 double, P1_S_2 double, P2_N_1 double, P2_N_2 double, y int")


def windows(spark, n=600):
    df = spark.range(n).select("id", *(F.randn(i + 1).alias(f"feat_T{i}") for i in range(4)))
    return df.withColumn("y", (F.col("feat_T1").between(0.3, 1.4) & F.col("feat_T3").between(-0.9, 0.4)).cast("int"))


PLAIN = {"labelCol": "y", "rowIdCol": "row_id", "Cs": [10.0], "cv": 2, "rectify": False, "use_scaler": False}


def test_consolidated_fit(spark):
    model = CriticalRangeClassifier(**PLAIN).fit(twins(spark))
    assert model.duplicate_report["duplicate_cols_removed"] == 2
    assert model.fit_feature_names == ["P1_S_1", "P2_N_1"]
    assert model.coef["P1_S_1"] == model.coef["P1_S_2"] == pytest.approx(model.coef_fit["P1_S_1"] / 2)
    assert abs(model.coef_fit["P1_S_1"]) > 1e-6
    p = model.transform(twins(spark)).toPandas()
    assert np.isfinite(p[["p0", "p1"]].to_numpy()).all() and np.allclose(p.p0 + p.p1, 1) and np.allclose(p.decision, p.p1 - p.p0)
    assert model.score(twins(spark)) == 1.0
    assert model.predict(twins(spark), threshold=1.1).filter("prediction = 1").count() == 0


@pytest.mark.parametrize("stage,seen", [("expanded", 4), ("fit", 2)])
def test_polish_stage(spark, monkeypatch, stage, seen):
    calls = []

    def stub(df, coef, *rest):
        calls.append(len(coef))
        return polish.Polished(dict.fromkeys(coef, 0.0), 0.0, True, {"adopted": True})

    monkeypatch.setattr(classifier.polish, "polish", stub)
    model = CriticalRangeClassifier(**PLAIN, logic_polish=True, logic_polish_stage=stage).fit(twins(spark))
    assert calls == [seen] and model.diag["stage"] == stage
    assert set(model.coef.values()) == {0.0}
    assert {r.p1 for r in model.transform(twins(spark)).collect()} == {0.5}


def test_whole_and_saved(spark, tmp_path):
    df = windows(spark).persist()
    for params in ({}, {"rectify": False}, {"logic_polish": True, "logic_intercept": "maxj"}, {"logic_polish": True, "logic_polish_stage": "fit"}, {"rectify": False, "logic_polish": True, "logic_maxk": 2}):
        model = CriticalRangeClassifier(labelCol="y", rowIdCol="id", Cs=5, **params).fit(df)
        got = model.transform(df).orderBy("id").select("p1").toPandas()
        path = str(tmp_path / str(len(params)) / str(params.get("logic_polish_stage", "x")) / str(params.get("rectify", "r")))
        persist.save_model(spark, model, path)
        back = persist.load_model(spark, path)
        assert back.transform(df).orderBy("id").select("p1").toPandas().equals(got)
        assert (back.coef, back.intercept, back.limits, back.duplicate_report, back.diag) == (model.coef, model.intercept, model.limits, model.duplicate_report, model.diag)
    assert CriticalRangeClassifier(labelCol="y", rowIdCol="id", Cs=5).fit(df).score(df) > 0.8


def test_limits_files(spark, tmp_path):
    limits = Rectifier(labelCol="y", featureCols=["feat_T1", "feat_T3"]).fit(windows(spark)).limits
    persist.write_limits(spark, limits, str(tmp_path / "limits"))
    assert persist.read_limits(spark, str(tmp_path / "limits")) == limits


def test_pipeline(spark):
    df = windows(spark)
    names = [f"feat_T{i}" for i in range(4)]
    steps = [Rectifier(labelCol="y", featureCols=names), DuplicateColumnConsolidator(featureCols=names), L1LogisticCV(labelCol="y", featureCols=names, Cs=3)]
    out = Pipeline(stages=steps).fit(df).transform(df)
    assert {"p0", "p1", "prediction"} <= set(out.columns) and out.count() == 600


def test_parameter_grids(spark):
    df = windows(spark, 200)
    rectifier = Rectifier(labelCol="y", featureCols=["feat_T1"])
    grid = ParamGridBuilder().addGrid(rectifier.sdfilter, [0.5, None]).build()
    models = dict(rectifier.fitMultiple(df, grid))
    assert models[0].limits[0].hi < models[1].limits[0].hi and rectifier.fit(df, {rectifier.snap: 0.9}).limits[0].lo is None


def test_saved_pipelines(spark, tmp_path):
    df, names = windows(spark), [f"feat_T{i}" for i in range(4)]
    steps = [StandardScaler(featureCols=names), Rectifier(labelCol="y", featureCols=names), DuplicateColumnConsolidator(featureCols=names), L1LogisticCV(labelCol="y", featureCols=names, Cs=[0.1, 1.0])]
    steps += [CriticalRangeClassifier(labelCol="y", featureCols=["feat_T1"], rectify=False, Cs=[1.0], logic_polish=True)]
    pipeline = Pipeline(stages=steps)
    pipeline.write().overwrite().save(str(tmp_path / "pipeline"))
    back = Pipeline.load(str(tmp_path / "pipeline"))
    assert [s.get_params() for s in back.getStages()] == [s.get_params() | {k: list(x) for k, x in s.get_params().items() if isinstance(x, tuple)} for s in steps]
    clean = df.select("id", "y", *names)
    model = Pipeline(stages=steps[:4]).fit(clean)
    model.save(str(tmp_path / "model"))
    loaded = PipelineModel.load(str(tmp_path / "model"))
    assert loaded.transform(clean).select("id", "p1").orderBy("id").collect() == model.transform(clean).select("id", "p1").orderBy("id").collect()
    whole = CriticalRangeClassifier(labelCol="y", rowIdCol="id", Cs=3, logic_polish=True, logic_intercept="maxj").fit(df)
    whole.save(str(tmp_path / "whole"))
    again = CriticalRangeModel.load(str(tmp_path / "whole"))
    assert again.state() == whole.state() and json.loads(again.diagnostics_json())["J0"] == whole.diag["J0"]


def test_scaler(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0), (float("nan"), 2.0)], "x double, c double")
    out = StandardScaler().fit_transform(df).collect()
    assert [r.x for r in out[:2]] == [-1.0, 1.0] and [r.c for r in out] == [0.0] * 3
    assert StandardScaler(with_mean=False, with_std=False).fit_transform(df).first().x == 1.0


def test_parameters():
    c = CriticalRangeClassifier(Cs=3)
    assert c.get_params()["Cs"] == 3 and c.get_params()["logic_rel_tol"] == 0.01
    assert c.set_params(cv=9).get_params()["cv"] == 9
    assert c.copy({c.cv: 4}).getOrDefault("cv") == 4 and c.getOrDefault(c.cv) == 9
    with pytest.raises(ValueError):
        c.set_params(depth=1)


def test_bad_settings(spark):
    for bad in ({"duplicate_mode": "x"}, {"duplicate_expansion": "x"}, {"logic_polish_stage": "x"}, {"featureCols": ["gone"]}):
        with pytest.raises(ValueError):
            CriticalRangeClassifier(labelCol="y", **bad).fit(twins(spark))


def test_experiments(spark, monkeypatch):
    """Measured on the driver or distributed, with the same results."""
    configs = [ExperimentConfig(logic_intercept="maxj"), ExperimentConfig(seed=2, train_frac=0.5, logic_target=2.0)]
    out = run_experiments(windows(spark), "y", "id", configs, Cs=3, cv=2).collect()
    assert len(out) == 2 and not out[1].adopted and 0.5 < out[0].auc_test <= 1
    monkeypatch.setattr(experiments, "HISTOGRAM_ROWS", 0)
    again = run_experiments(windows(spark), "y", "id", configs, Cs=3, cv=2).collect()
    for a, b in zip(out, again, strict=True):
        assert [a[n] for n in ("J_train", "J_test", "auc_train", "auc_test")] == pytest.approx([b[n] for n in ("J_train", "J_test", "auc_train", "auc_test")])
    assert metrics.measures([(1.0, 0.5, 1, 3)]) == (0.0, None)


def test_stream(spark, tmp_path):
    df = windows(spark)
    df.write.parquet(str(tmp_path / "in"))
    model = CriticalRangeClassifier(labelCol="y", rowIdCol="id", Cs=3).fit(df)
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    append_to(apply(stream, model, ["id", "p1"]), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.id: r.p1 for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.id: r.p1 for r in model.transform(df).collect()}


def test_frames(spark, tmp_path):
    df = spark.sql("SELECT 1 AS i, array(float(1), float(2)) AS v, timestamp'1970-01-01 00:00:02' AS t, true AS b")
    wide = frames.numbers(frames.fan_out(df, "v", 3, "e")).first()
    assert (wide.e0, wide.e1, wide.e2, wide.t, wide.b) == (1.0, 2.0, None, 2.0, 1.0)
    frames.write_csv(df.select("i", "b"), str(tmp_path / "csv"), single=True)
    assert frames.read_csv(spark, str(tmp_path / "csv")).first().i == 1
