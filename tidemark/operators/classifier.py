"""The whole classifier: rectify, consolidate duplicates, scale if needed, choose a penalty, and polish into a vote rule."""

from __future__ import annotations

import json
import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import naming
from tidemark.functions.expr import quoted, sigmoid
from tidemark.operators import metrics, polish
from tidemark.operators.base import Fitted, Learner, numeric_columns, one_of, require
from tidemark.operators.dedupe import EXPANSIONS, MODES, DuplicateColumnConsolidator, DuplicateColumnModel
from tidemark.operators.logistic_cv import L1LogisticCV, L1LogisticModel
from tidemark.operators.rectify import Rectifier, RectifierModel
from tidemark.operators.scale import StandardScaler, StandardScalerModel

log = logging.getLogger(__name__)


class CriticalRangeClassifier(Learner):
    """Learns an interpretable classifier of a 0/1 label; see the operators it is made of for the parameters."""

    PARAMS = {
        "labelCol": "label", "featureCols": None, "rowIdCol": None, "foldCol": None, "foldMode": "auto",
        "rectify": True, "groups": None, "sdfilter": 3.0, "snap": 0.001, "quantile_bounds": None, "add_complements": False, "complement_prefix": "n", "exclude_features": (),
        "duplicate_mode": "within_group", "duplicate_expansion": "split_evenly", "use_scaler": None,
        "Cs": 15, "solver": "cd", "cv": 3, "tol": 1e-4, "max_iter": 2000, "random_state": 42, "cv_rule": "min", "zero_clamp": 0.0,
        "logic_polish": False, "logic_polish_stage": "expanded", "logic_scale": 10.0, "logic_target": None, "logic_maxk": None, "logic_rel_tol": 0.01, "logic_Ks_plot": (),
        "logic_k_policy": "global", "logic_smooth_k": 3, "logic_firstmin_drop": 0.05, "logic_firstmin_frac": 0.5, "logic_intercept": "mean", "logic_m": None, "logic_m_frac": None,
        "verbose": True,
    }

    def _policy(self) -> polish.Policy:
        v = self.values()
        return polish.Policy(
            v.logic_scale, v.logic_target, v.logic_maxk, v.logic_rel_tol, v.logic_k_policy or "global", v.logic_smooth_k,
            v.logic_firstmin_drop, v.logic_firstmin_frac, v.logic_intercept, v.logic_m, v.logic_m_frac,
        )

    def _fit(self, df: DataFrame) -> CriticalRangeModel:
        v = self.values()
        one_of("duplicate_mode", v.duplicate_mode, MODES)
        one_of("duplicate_expansion", v.duplicate_expansion, EXPANSIONS)
        one_of("logic_polish_stage", v.logic_polish_stage, ["expanded", "fit"])
        policy = self._policy()
        policy.check()
        ids = [c for c in (v.rowIdCol, v.foldCol) if c]
        names = list(v.featureCols) if v.featureCols else numeric_columns(df, [v.labelCol, *ids])
        excluded = set(map(str, v.exclude_features or ()))
        names = [n for n in names if n not in excluded]
        require(df, [*names, v.labelCol, *ids])
        naming.check_names(names)
        work = df.select(*(quoted(c) for c in dict.fromkeys([*names, v.labelCol, *ids])))

        rectifier = None
        if v.rectify:
            shared = {k: getattr(v, k) for k in Rectifier.PARAMS if k in self.PARAMS and k not in ("featureCols", "exclude_features")}
            rectifier = Rectifier(featureCols=names, **shared).fit(work)
            work, names = rectifier.transform(work), rectifier.output_features
        work = work.persist()
        try:
            consolidator = DuplicateColumnConsolidator(featureCols=names, mode=v.duplicate_mode, expansion=v.duplicate_expansion).fit(work)
            reduced = consolidator.transform(work)
            scale = v.use_scaler
            if scale is None:
                # Rectified columns are -1 and +1 by construction.
                scale = not v.rectify
            scaler = StandardScaler(featureCols=consolidator.features).fit(reduced) if scale else None
            ready = scaler.transform(reduced) if scaler else reduced
            logistic = L1LogisticCV(
                featureCols=consolidator.features, labelCol=v.labelCol, rowIdCol=v.rowIdCol, foldCol=v.foldCol, foldMode=v.foldMode, Cs=v.Cs, cv=v.cv,
                solver=v.solver, tol=v.tol, max_iter=v.max_iter, random_state=v.random_state, cv_rule=v.cv_rule, zero_clamp=v.zero_clamp,
            ).fit(ready)
            if v.verbose:
                log.info("chose C=%g of %s by rule %s; mean losses by C: %s", logistic.C, logistic.Cs, v.cv_rule, logistic.mean_losses())
            full_scaler = None
            if scaler:
                place = {r: i for i, r in enumerate(scaler.features)}
                of = {m: place[c.rep] for c in consolidator.duplicate_classes for m in c.members}
                full_scaler = StandardScalerModel(names, [scaler.mean[of[n]] for n in names], [scaler.scale[of[n]] for n in names])
            model = CriticalRangeModel(v.labelCol, rectifier, consolidator, scaler, full_scaler, logistic)
            return model.polished(work, policy, v.logic_polish_stage, v.logic_Ks_plot or ()) if v.logic_polish else model
        finally:
            work.unpersist()


class CriticalRangeModel(Fitted):
    """A fitted classifier: coefficients on the consolidated and on all features, and scoring as one projection."""

    def __init__(self, label: str, rectifier: RectifierModel | None, consolidator: DuplicateColumnModel, scaler: StandardScalerModel | None, full_scaler: StandardScalerModel | None, logistic: L1LogisticModel):
        super().__init__()
        self.label, self.rectifier, self.consolidator, self.scaler, self.full_scaler, self.logistic = label, rectifier, consolidator, scaler, full_scaler, logistic
        self.diag: dict[str, object] = {}
        self.rule: dict[str, float] | None = None
        self.rule_intercept = 0.0
        self.coef_fit, self.intercept = dict(logistic.coef), logistic.intercept
        self.coef = consolidator.expand(self.coef_fit)

    def state(self) -> dict[str, object]:
        parts = {n: getattr(self, n) for n in ("rectifier", "consolidator", "scaler", "full_scaler", "logistic")}
        own = {n: getattr(self, n) for n in ("diag", "rule", "rule_intercept", "coef_fit", "intercept", "coef")}
        return {"label": self.label, "parts": {n: m and m.state() for n, m in parts.items()}, "own": own}

    @classmethod
    def from_state(cls, state: dict) -> CriticalRangeModel:
        kinds = {"rectifier": RectifierModel, "consolidator": DuplicateColumnModel, "scaler": StandardScalerModel, "full_scaler": StandardScalerModel, "logistic": L1LogisticModel}
        model = cls(state["label"], **{n: state["parts"][n] and kind.from_state(state["parts"][n]) for n, kind in kinds.items()})
        for name, value in state["own"].items():
            setattr(model, name, value)
        return model

    def diagnostics_json(self) -> str:
        """The diagnostics of the polish as JSON, for a record of its own."""
        return json.dumps(self.diag, indent=2)

    def adopt(self, coef: Mapping[str, float], intercept: float, expanded: bool) -> None:
        """Takes over a vote rule, on all features or on the consolidated ones."""
        self.intercept = float(intercept)
        if expanded:
            self.rule, self.rule_intercept, self.coef = dict(coef), float(intercept), dict(coef)
        else:
            self.coef_fit, self.coef = dict(coef), self.consolidator.expand(coef)

    def polished(self, frame: DataFrame, policy: polish.Policy, stage: str = "expanded", scales: Sequence[float] = (), weight: str | None = None) -> CriticalRangeModel:
        """This fit with a vote rule that is sought on ``frame``, which has the rectified features and the label."""
        expanded = stage == "expanded"
        ready = frame if expanded else self.consolidator.transform(frame)
        scaler = self.full_scaler if expanded else self.scaler
        coef = self.consolidator.expand(self.logistic.coef) if expanded else self.logistic.coef
        found = polish.polish(scaler.transform(ready) if scaler else ready, coef, self.logistic.intercept, self.label, policy, scales, weight)
        model = CriticalRangeModel(self.label, self.rectifier, self.consolidator, self.scaler, self.full_scaler, self.logistic)
        model.diag = {"stage": stage, **found.diag}
        log.info("polish: intercept %s, k by %s, J0 %s, chose k=%s with J %s, adopted %s", policy.intercept, policy.k_policy, *(found.diag.get(n) for n in ("J0", "k_chosen", "J_chosen", "adopted")))
        if found.adopted:
            model.adopt(found.coef, found.intercept, expanded)
        return model

    @property
    def classes(self) -> list[int]:
        return [0, 1]

    @property
    def limits(self) -> list:
        return self.rectifier.limits if self.rectifier else []

    @property
    def duplicate_report(self) -> dict[str, object]:
        return self.consolidator.report

    @property
    def feature_names(self) -> list[str]:
        """All features after rectifying."""
        return self.consolidator.input_features

    @property
    def fit_feature_names(self) -> list[str]:
        """The features that were fitted."""
        return self.consolidator.features

    def probability(self, raw: bool = True) -> Column:
        """The positive class's probability as an expression over the input columns, or over the rectified ones."""
        weights, b = (self.rule, self.rule_intercept) if self.rule is not None else (self.coef_fit, self.intercept)
        scaler = self.full_scaler if self.rule is not None else self.scaler
        terms = {n: w for n, w in weights.items() if w}
        columns = dict(zip(self.rectifier.output_features, self.rectifier.columns(), strict=True)) if self.rectifier and raw else {}
        score = F.lit(float(b))
        for n, w in terms.items():
            x = columns.get(n, quoted(n)).cast("double")
            if scaler:
                i = scaler.features.index(n)
                x = (x - scaler.mean[i]) / scaler.scale[i]
            score = score + F.lit(float(w)) * x
        return sigmoid(score)

    def _transform(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        require(df, self.rectifier.features if self.rectifier else self.feature_names)
        return df.withColumn("p1", self.probability()).withColumns({"p0": 1 - F.col("p1"), "decision": 2 * F.col("p1") - 1, "prediction": (F.col("p1") >= threshold).cast("int")})

    def predict(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        """``df`` with p1, p0, decision and prediction at a threshold."""
        return self._transform(df, threshold)

    def score(self, df: DataFrame, threshold: float = 0.5) -> float:
        """Accuracy."""
        return metrics.accuracy(self._transform(df, threshold), self.label, "prediction")
