"""Limits as JSON, and whole models as a directory of Parquet tables with a JSON description."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.classifier import CriticalRangeModel
from tidemark.operators.dedupe import DuplicateClass, DuplicateColumnModel
from tidemark.operators.logistic_cv import L1LogisticModel
from tidemark.operators.rectify import Limit, RectifierModel
from tidemark.operators.scale import StandardScalerModel

_LIMITS = "map<string, map<string, array<double>>>"


def limits_json(limits: Sequence[Limit]) -> str:
    """Limits as {group: {feature: [lo, hi]}}, null for an open side."""
    out: dict[str, dict[str, list]] = {}
    for v in limits:
        out.setdefault(v.group, {})[v.feature] = [v.lo, v.hi]
    return json.dumps(out, indent=2)


def limits_from_json(text: str) -> list[Limit]:
    """The inverse of :func:`limits_json`; positions follow the order of the text."""
    pairs = [(g, f, lo, hi) for g, fs in json.loads(text).items() for f, (lo, hi) in fs.items()]
    return [Limit(g, f, i, lo, hi) for i, (g, f, lo, hi) in enumerate(pairs)]


def parsed_limits(texts: DataFrame, column: str = "value") -> DataFrame:
    """Rows (group, feature, lo, hi) of limits in JSON."""
    groups = texts.select(F.explode(F.from_json(column, _LIMITS)).alias("group", "features"))
    pairs = groups.select("group", F.explode("features").alias("feature", "pair"))
    return pairs.select("group", "feature", F.get("pair", F.lit(0)).alias("lo"), F.get("pair", F.lit(1)).alias("hi"))


def write_limits(spark: SparkSession, limits: Sequence[Limit], path: str) -> None:
    """Limits as one JSON document below ``path``."""
    spark.createDataFrame([(limits_json(limits),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_limits(spark: SparkSession, path: str) -> list[Limit]:
    """What :func:`write_limits` wrote."""
    return limits_from_json(spark.read.text(path, wholetext=True).first()[0])


def save_model(spark: SparkSession, model: CriticalRangeModel, path: str) -> None:
    """A whole classifier: limits, duplicate classes, scales, coefficients, rule and diagnostics."""
    if model.rectifier:
        model.rectifier.limits_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/limits")
    model.consolidator.classes_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/classes")
    model.logistic.losses_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/losses")
    scale = dict(zip(model.scaler.features, zip(model.scaler.mean, model.scaler.scale, strict=True), strict=True)) if model.scaler else {}
    full = dict(zip(model.full_scaler.features, zip(model.full_scaler.mean, model.full_scaler.scale, strict=True), strict=True)) if model.full_scaler else {}
    rows = []
    for i, f in enumerate(model.feature_names):
        fitted = f in model.coef_fit
        rows.append((f, i, model.coef[f], model.coef_fit.get(f), model.logistic.coef.get(f) if fitted else None, (model.rule or {}).get(f), *(scale.get(f) or (None, None)), *(full.get(f) or (None, None))))
    schema = "feature string, pos int, coef double, coef_fit double, coef_logistic double, rule double, mean double, scale double, full_mean double, full_scale double"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/coefficients")
    meta = {
        "label": model.label, "rectified": model.rectifier is not None, "complement_prefix": model.rectifier.complement_prefix if model.rectifier else None, "scaled": model.scaler is not None,
        "mode": model.consolidator.mode, "expansion": model.consolidator.expansion, "aliases": model.consolidator.cross_group_alias_classes,
        "intercept": model.intercept, "logistic_intercept": model.logistic.intercept, "C": model.logistic.C, "Cs": model.logistic.Cs, "solver": model.logistic.solver, "penalty": "l1",
        "cv_rule": model.logistic.cv_rule, "zero_clamp": model.logistic.zero_clamp, "has_rule": model.rule is not None, "diag": model.diag,
    }
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> CriticalRangeModel:
    """What :func:`save_model` wrote."""
    meta = json.loads(spark.read.text(f"{path}/meta", wholetext=True).first()[0])
    limits = [Limit(*r) for r in spark.read.parquet(f"{path}/limits").orderBy("pos").collect()] if meta["rectified"] else []
    members: dict[int, list[str]] = {}
    for r in spark.read.parquet(f"{path}/classes").orderBy("class_id", "pos").collect():
        members.setdefault(r.class_id, []).append(r.member)
    rows = spark.read.parquet(f"{path}/coefficients").orderBy("pos").collect()
    names = [r.feature for r in rows]
    fitted = [r for r in rows if r.coef_fit is not None]
    losses = [{"fold": r.fold, "path_pos": r.path_pos, "C": r.C, "loss": r.val_loss} for r in spark.read.parquet(f"{path}/losses").collect()]
    model = CriticalRangeModel(
        meta["label"],
        RectifierModel(limits, meta["complement_prefix"]) if meta["rectified"] else None,
        DuplicateColumnModel(names, [DuplicateClass(tuple(members[i])) for i in sorted(members)], meta["mode"], meta["expansion"], meta["aliases"]),
        StandardScalerModel([r.feature for r in fitted], [r.mean for r in fitted], [r.scale for r in fitted]) if meta["scaled"] else None,
        StandardScalerModel(names, [r.full_mean for r in rows], [r.full_scale for r in rows]) if meta["scaled"] else None,
        L1LogisticModel({r.feature: r.coef_logistic for r in fitted}, meta["logistic_intercept"], meta["C"], meta["Cs"], losses, meta["solver"], meta["cv_rule"], meta["zero_clamp"]),
    )
    model.diag, model.intercept = meta["diag"], meta["intercept"]
    model.coef_fit, model.coef = {r.feature: r.coef_fit for r in fitted}, {r.feature: r.coef for r in rows}
    if meta["has_rule"]:
        model.rule, model.rule_intercept = {r.feature: r.rule for r in rows}, meta["intercept"]
    return model
