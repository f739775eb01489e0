"""Batch experiments: a seeded split, a fit, and measures on both parts, for each configuration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import quoted
from tidemark.operators import metrics
from tidemark.operators.classifier import CriticalRangeClassifier, CriticalRangeModel
from tidemark.operators.folds import split_column
from tidemark.operators.polish import Policy


#: Distinct scores by part and label that are measured on the driver; beyond, the same measures are distributed.
HISTOGRAM_ROWS = 50_000


@dataclass(frozen=True)
class ExperimentConfig:
    """One experiment's split and polish settings."""

    seed: int = 42
    train_frac: float = 0.7
    logic_target: float | None = None
    logic_k_policy: str = "global"
    logic_intercept: str = "mean"
    logic_scale: float = 10.0


SCHEMA = (
    "seed int, train_frac double, logic_target double, logic_k_policy string, logic_intercept string, logic_scale double, "
    "adopted boolean, k_chosen int, J_train double, J_test double, auc_train double, auc_test double"
)


def _policy(config: ExperimentConfig, params: Mapping[str, object]) -> Policy:
    """The polish settings of a configuration; ``params`` may hold more of the classifier's."""
    names = ("rel_tol", "maxk", "smooth_k", "firstmin_drop", "firstmin_frac", "m", "m_frac")
    more = {n: params[f"logic_{n}"] for n in names if f"logic_{n}" in params}
    return Policy(scale=config.logic_scale, target=config.logic_target, k_policy=config.logic_k_policy, intercept=config.logic_intercept, **more)


def run_experiment(df: DataFrame, label: str, row_id: str, config: ExperimentConfig, **params: object) -> tuple[dict[str, object], CriticalRangeModel]:
    """The result row of one configuration, and its model. AUC is None for a part with one class."""
    return _run(df, label, row_id, [config], params)[0]


def _run(df: DataFrame, label: str, row_id: str, configs: Sequence[ExperimentConfig], params: Mapping[str, object]) -> list[tuple[dict[str, object], CriticalRangeModel]]:
    """Results of configurations that share a split, so also the fit before the polish.

    All that follows the fit depends only on how many rows of each part have which label and rectified features, so it
    runs on a table of those counts.
    """
    settings = {"Cs": 21, "cv": 5, "solver": "cd", **params}
    stage = str(settings.pop("logic_polish_stage", "expanded"))
    for c in configs:
        _policy(c, settings).check()
    part, count = "__train", "__rows"
    both = split_column(df, row_id, configs[0].train_frac, configs[0].seed, part).persist()
    patterns = None
    try:
        learner = CriticalRangeClassifier(labelCol=label, rowIdCol=row_id, random_state=configs[0].seed, **settings)
        base = learner.set_params(logic_polish=False).fit(both.filter(part).drop(part))
        features = base.feature_names
        rectified = base.rectifier.transform(both) if base.rectifier else both
        keys = [quoted(c) for c in (*features, label, part)]
        patterns = rectified.groupBy(*keys).agg(F.count(F.lit(1)).alias(count)).persist()
        out = []
        for c in configs:
            model = base.polished(patterns.filter(part), _policy(c, settings), stage, (), count)
            scored = patterns.withColumn("p1", model.probability(raw=False)).withColumn("prediction", (F.col("p1") >= 0.5).cast("int"))
            row: dict[str, object] = {**c.__dict__, "adopted": bool(model.diag.get("adopted")), "k_chosen": model.diag.get("k_chosen")}
            grouped = scored.groupBy(part, quoted(label).cast("double").alias("y"), "p1", "prediction").agg(F.sum(count).alias("n"))
            found = grouped.limit(HISTOGRAM_ROWS + 1).collect()
            for name, first in (("train", True), ("test", False)):
                if len(found) <= HISTOGRAM_ROWS:
                    j, auc = metrics.measures([(r.y, r.p1, r.prediction, r.n) for r in found if r[part] == first])
                else:
                    rows = scored.filter(F.col(part) == first)
                    j, auc = metrics.youden_j(rows, label, "prediction", count), metrics.roc_auc_table(rows, label, "p1", count).first()["auc"]
                row |= {f"J_{name}": j, f"auc_{name}": auc}
            out.append((row, model))
        return out
    finally:
        both.unpersist()
        if patterns is not None:
            patterns.unpersist()


def run_experiments(df: DataFrame, label: str, row_id: str, configs: Sequence[ExperimentConfig], **params: object) -> DataFrame:
    """The table of result rows, one for each configuration, in order."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    groups: dict[tuple[int, float], list[ExperimentConfig]] = {}
    for c in configs:
        groups.setdefault((c.seed, c.train_frac), []).append(c)
    found = {c: row for group in groups.values() for c, (row, _) in zip(group, _run(df, label, row_id, group, params), strict=True)}
    return df.sparkSession.createDataFrame([tuple(found[c][n] for n in names) for c in configs], SCHEMA)
