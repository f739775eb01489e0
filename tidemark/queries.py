"""Every query of the classification engine by name, and the same in DuckDB's SQL where SQL can express it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import expr, naming
from tidemark.operators import folds, metrics, polish
from tidemark.operators.classifier import CriticalRangeClassifier
from tidemark.operators.dedupe import DuplicateColumnConsolidator
from tidemark.operators.logistic_cv import L1LogisticCV, L1LogisticModel, choose, grid
from tidemark.operators.rectify import Limit, Rectifier, RectifierModel
from tidemark.operators.scale import StandardScaler, all_pm1
from tidemark.plans.experiments import ExperimentConfig, run_experiments
from tidemark.sources import frames
from tidemark.sources.persist import limits_json, load_model, parsed_limits, save_model
from tidemark.streaming.score import append_to, apply

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
RULE = "l_quantity BETWEEN 15 AND 35 AND l_discount BETWEEN 0.03 AND 0.07"
#: Fixed ranges and weights, so that what follows them can be checked alone.
RANGES = {"l_quantity": (15.0, 35.0), "l_extendedprice": (20000.0, 60000.0), "l_discount": (0.03, 0.07), "l_tax": (0.02, None)}
WEIGHTS, INTERCEPT = {"l_quantity": 1.2, "l_extendedprice": -0.3, "l_discount": 0.9, "l_tax": 0.1}, -1.4


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with its SQL if there is any."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lineitem(spark: SparkSession, sf_dir: str, label: str = "l_returnflag = 'R'") -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *FEATURES, F.expr(f"int({label})").alias("label"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", "value", F.expr("int(event_type = 'purchase')").alias("label"))


# Critical ranges


def _limits(spark: SparkSession, sf_dir: str, **params: object) -> DataFrame:
    model = Rectifier(labelCol="label", featureCols=FEATURES, **params).fit(_lineitem(spark, sf_dir))
    return model.limits_table(spark).withColumns({c: F.round(c, 6) for c in ("lo", "hi")})


def _limits_sql(band: float | None, lo: str = "min(x)", hi: str = "max(x)", snap: float | None = None) -> str:
    parts = []
    for i, f in enumerate(FEATURES):
        inside = f"AND x > (SELECT avg(x) - {band} * stddev_pop(x) FROM p) AND x < (SELECT avg(x) + {band} * stddev_pop(x) FROM p)" if band else ""
        opened = (
            f"CASE WHEN (SELECT count(*) FROM a WHERE a.x < lo) >= greatest(1, floor({snap} * (SELECT count(*) FROM a))) THEN lo END AS lo, "
            f"CASE WHEN (SELECT count(*) FROM a WHERE a.x > hi) >= greatest(1, floor({snap} * (SELECT count(*) FROM a))) THEN hi END AS hi"
            if snap
            else "lo, hi"
        )
        parts.append(f"""SELECT '{f}' AS "group", '{f}' AS feature, {i} AS pos, round(lo, 6) AS lo, round(hi, 6) AS hi FROM (
            WITH a AS (SELECT {f}::DOUBLE AS x, l_returnflag = 'R' AS y FROM lineitem), p AS (SELECT x FROM a WHERE y),
            b AS (SELECT {lo} AS lo, {hi} AS hi FROM p WHERE true {inside}) SELECT {opened} FROM b)""")
    return " UNION ALL ".join(parts)


@query("rectifier_limits_sigma", _limits_sql(1.0))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _limits(spark, sf_dir, sdfilter=1.0, snap=None)


@query("rectifier_limits_nofilter", _limits_sql(None))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _limits(spark, sf_dir, sdfilter=None, snap=None)


@query("rectifier_limits_quantile", _limits_sql(3.0, "quantile_cont(x, 0.1)", "quantile_cont(x, 0.85)"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _limits(spark, sf_dir, sdfilter=3.0, snap=None, quantile_bounds=(0.1, 0.85))


@query("rectifier_limits_snap", _limits_sql(1.0, snap=0.21))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _limits(spark, sf_dir, sdfilter=1.0, snap=0.21)


@query("limits_long", _limits_sql(1.0))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _limits(spark, sf_dir, sdfilter=1.0, snap=None, wide=0)


@query("limits_long_quantile", _limits_sql(None, "quantile_cont(x, 0.05)", "quantile_cont(x, 0.95)"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _limits(spark, sf_dir, sdfilter=None, snap=None, quantile_bounds=(0.05, 0.95), wide=0)


@query("rectifier_no_positives", "SELECT feature AS \"group\", feature, pos, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi FROM (VALUES " + ", ".join(f"('{f}', {i})" for i, f in enumerate(FEATURES)) + ") AS v(feature, pos)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _lineitem(spark, sf_dir, "false")
    return Rectifier(labelCol="label", featureCols=FEATURES).fit(frame).limits_table(spark)


@query("rectifier_exclusions", f"SELECT * REPLACE (CASE WHEN pos > 2 THEN pos - 1 ELSE pos END AS pos) FROM ({_limits_sql(1.0)}) WHERE feature <> 'l_discount'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _limits(spark, sf_dir, sdfilter=1.0, snap=None, exclude_features=["l_discount"])


@query("limits_json_roundtrip", f'SELECT "group", feature, lo, hi FROM ({_limits_sql(1.0, snap=0.21)})')
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = Rectifier(labelCol="label", featureCols=FEATURES, sdfilter=1.0, snap=0.21).fit(_lineitem(spark, sf_dir))
    text = spark.createDataFrame([(limits_json(model.limits),)], "value string")
    return parsed_limits(text).withColumns({c: F.round(c, 6) for c in ("lo", "hi")})


def _fixed(complement: str | None = None) -> RectifierModel:
    return RectifierModel([Limit(naming.prefix(f), f, i, lo, hi) for i, (f, (lo, hi)) in enumerate(RANGES.items())], complement)


def _pm1_sql(f: str, x: str | None = None) -> str:
    lo, hi = RANGES[f]
    x = x or f"{f}::DOUBLE"
    tests = [t for t in (f"{x} < {lo}" if lo is not None else "", f"{x} > {hi}" if hi is not None else "") if t]
    return f"CASE WHEN {' OR '.join(tests)} THEN -1 ELSE 1 END::TINYINT"


_RECTIFIED_SQL = "SELECT l_orderkey, l_linenumber, " + ", ".join(f"{_pm1_sql(f)} AS {f}" for f in FEATURES)


@query("rectify_transform", f"{_RECTIFIED_SQL} FROM lineitem")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixed().transform(_lineitem(spark, sf_dir).drop("label"))


@query("rectify_complements", f"{_RECTIFIED_SQL}, {', '.join(f'(-({_pm1_sql(f)}))::TINYINT AS n{f}' for f in FEATURES)} FROM lineitem")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixed("n").transform(_lineitem(spark, sf_dir).drop("label"))


@query("rectify_nan_null", f"SELECT l_orderkey, l_linenumber, {_pm1_sql('l_quantity', 'CASE WHEN l_linenumber IN (1, 2) THEN NULL ELSE l_quantity END')} AS l_quantity FROM lineitem")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    holed = F.expr("CASE WHEN l_linenumber = 1 THEN double('NaN') WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END")
    frame = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", holed.alias("l_quantity"))
    return RectifierModel([Limit("l_quantity", "l_quantity", 0, *RANGES["l_quantity"])]).transform(frame)


# Names

_NAMES = ["V1_t10", "V1_t2", "V1_t", "b", "a1", "b10", "b2", "123", "_x", "V2_t0", "V1_t1"]
_NAMES_SQL = "(VALUES " + ", ".join(f"('{n}', {i})" for i, n in enumerate(_NAMES)) + ") AS v(feature, i)"


@query(
    "organise_by_prefix",
    f"""WITH n AS (SELECT feature, i, regexp_replace(feature, '[0-9]+$', '') AS prefix FROM {_NAMES_SQL}),
    o AS (SELECT *, min(i) OVER (PARTITION BY prefix) AS first, nullif(substr(feature, length(prefix) + 1), '')::INTEGER AS num FROM n)
    SELECT prefix, feature, (row_number() OVER (ORDER BY first, num NULLS LAST, i) - 1)::INTEGER AS pos FROM o""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = naming.groups_by_prefix(_NAMES)
    order = naming.ordered(groups, _NAMES)
    return spark.createDataFrame([(naming.prefix(n), n, i) for i, n in enumerate(order)], "prefix string, feature string, pos int")


@query("root_feature_group", f"SELECT feature, split_part(feature, '_', 1) AS root FROM {_NAMES_SQL}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(n,) for n in _NAMES], "feature string")
    return names.select("feature", naming.root_group_column(F.col("feature")).alias("root"))


# Duplicate columns

_COPIES = {"P1_A_1": "value > 50", "P1_A_2": "NOT value <= 50", "P2_B_1": "value > 50", "P3_C_1": "event_id % 3 = 0", "P3_C_2": "event_id % 3 = 0"}
_COPIES_SQL = ", ".join(f"CASE WHEN {c} THEN 1 ELSE -1 END AS {n}" for n, c in _COPIES.items())


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", *(F.expr(f"CASE WHEN {c} THEN 1 ELSE -1 END").alias(n) for n, c in _COPIES.items()))


def _consolidated(spark: SparkSession, sf_dir: str, mode: str):
    return DuplicateColumnConsolidator(featureCols=list(_COPIES), mode=mode).fit(_copies(spark, sf_dir))


def _classes_sql(mode: str) -> str:
    names = list(_COPIES)
    pairs = " UNION ALL ".join(
        f"SELECT {j} AS pos, {i} AS rep_pos, {'bool_and(' + a + ' IS NOT DISTINCT FROM ' + b + ')' if i != j else 'true'} AS same FROM t"
        for j, b in enumerate(names) for i, a in enumerate(names[: j + 1])
        if i == j or mode == "global" or mode == "within_group" and naming.root_group(a) == naming.root_group(b)
    )
    values = ", ".join(f"({i}, '{n}', '{naming.root_group(n)}')" for i, n in enumerate(names))
    return f"""WITH t AS (SELECT {_COPIES_SQL} FROM events), n AS (SELECT * FROM (VALUES {values}) AS v(pos, member, root)),
        r AS (SELECT pos, min(rep_pos) AS rep_pos FROM ({pairs}) WHERE same GROUP BY pos)
        SELECT (dense_rank() OVER (ORDER BY rep_pos) - 1)::INTEGER AS class_id, m.member AS rep, n.member, n.pos, n.root FROM r JOIN n USING (pos) JOIN n m ON m.pos = r.rep_pos"""


for _mode in ("within_group", "global", "none"):
    query(f"duplicate_{_mode}", _classes_sql(_mode))(lambda spark, sf_dir, mode=_mode: _consolidated(spark, sf_dir, mode).classes_table(spark))

_REPORT = {"within_group": (3, 2, 2), "global": (2, 2, 3)}


@query("duplicate_report", " UNION ALL ".join(
    f"SELECT '{m}' AS mode, 'split_evenly' AS expansion, {len(_COPIES)}::BIGINT AS input_features, count(DISTINCT class_id)::BIGINT AS fit_features, "
    f"count(DISTINCT class_id) FILTER (size > 1)::BIGINT AS duplicate_groups, (count(*) - count(DISTINCT class_id))::BIGINT AS duplicate_cols_removed, "
    f"(SELECT count(*) FROM (SELECT class_id FROM ({_classes_sql('global')}) GROUP BY class_id HAVING count(*) > 1 AND count(DISTINCT root) > 1))::BIGINT AS cross_group_alias_classes "
    f"FROM (SELECT *, count(*) OVER (PARTITION BY class_id) AS size FROM ({_classes_sql(m)}))"
    for m in _REPORT
))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = [_consolidated(spark, sf_dir, m).report for m in _REPORT]
    return spark.createDataFrame([tuple(r.values()) for r in reports], "mode string, expansion string, input_features long, fit_features long, duplicate_groups long, duplicate_cols_removed long, cross_group_alias_classes long")


@query("duplicate_representatives", f"SELECT event_id, {', '.join(f'{n}::INTEGER AS {n}' for n in ('P1_A_1', 'P2_B_1', 'P3_C_1'))} FROM (SELECT event_id, {_COPIES_SQL} FROM events)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _copies(spark, sf_dir)
    return _consolidated(spark, sf_dir, "within_group").transform(frame).select("event_id", *(F.col(n).cast("int") for n in ("P1_A_1", "P2_B_1", "P3_C_1")))


_COEF = {"P1_A_1": 6.0, "P2_B_1": 4.0, "P3_C_1": 2.0}
for _how, _share in (("split_evenly", "count(*) OVER (PARTITION BY class_id)"), ("representative_only", "1")):
    query(
        f"expand_{'split_evenly' if _how == 'split_evenly' else 'broadcast'}",
        f"SELECT member AS feature, pos, CASE rep {' '.join(f'''WHEN '{k}' THEN {v}''' for k, v in _COEF.items())} END::DOUBLE / {_share} AS coef FROM ({_classes_sql('within_group')})",
    )(lambda spark, sf_dir, how=_how: _consolidated(spark, sf_dir, "within_group").expand_table(spark.createDataFrame(list(_COEF.items()), "feature string, coef double"), how))


# Scaling, scoring and metrics


@query("standard_scale", "SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT coalesce(nullif(stddev_pop(value), 0), 1) FROM events), 6) AS value FROM events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _events(spark, sf_dir).select("event_id", "value")
    return StandardScaler(featureCols=["value"]).fit(frame).transform(frame).withColumn("value", F.round("value", 6))


@query("pm1_columns", f"SELECT * FROM (SELECT 'P1_A_1' AS feature, true AS pm1 UNION ALL SELECT 'value', bool_and(value IN (-1, 1)) FROM events UNION ALL SELECT 'sign', bool_and(sign(value - 100) IN (-1, 1)) FROM events)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _read(spark, sf_dir, "events").select("value", F.expr("CASE WHEN value > 50 THEN 1 ELSE -1 END").alias("P1_A_1"), F.signum(F.col("value") - 100).alias("sign"))
    return spark.createDataFrame(list(all_pm1(frame, ["P1_A_1", "value", "sign"]).items()), "feature string, pm1 boolean")


@query(
    "sigmoid_softplus_logloss",
    """WITH z AS (SELECT (value - 100) / 5 AS z, (event_type = 'purchase')::INTEGER AS y FROM events)
    SELECT round(avg(1 / (1 + exp(-greatest(least(z, 40), -40)))), 6) AS mean_sigmoid, round(avg(ln(1 + exp(-abs(z))) + greatest(z, 0)), 6) AS mean_softplus,
        round(avg(ln(1 + exp(-abs(z))) + greatest(z, 0) - y * z), 6) AS log_loss, round(avg(sign(z) * greatest(abs(z) - 2, 0)), 6) AS mean_soft_threshold FROM z""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, y = (F.col("value") - 100) / 5, F.col("label")
    means = {"mean_sigmoid": expr.sigmoid(z), "mean_softplus": expr.softplus(z), "log_loss": expr.log_loss(y, z), "mean_soft_threshold": expr.soft_threshold(z, 2.0)}
    return _events(spark, sf_dir).agg(*(F.round(F.avg(e), 6).alias(n) for n, e in means.items()))


_SCORE_SQL = f"{INTERCEPT} + " + " + ".join(f"({w}) * {_pm1_sql(f)}" for f, w in WEIGHTS.items())
_P_SQL = f"1 / (1 + exp(-({_SCORE_SQL})))"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.logistic_cv import scored

    return scored(_fixed().transform(_lineitem(spark, sf_dir, RULE)), WEIGHTS, INTERCEPT)


@query("linear_score_proba", f"SELECT l_orderkey, l_linenumber, round({_P_SQL}, 6) AS p1, round(1 - {_P_SQL}, 6) AS p0 FROM lineitem")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round("p1", 6).alias("p1"), F.round("p0", 6).alias("p0"))


@query("decision_function", f"SELECT l_orderkey, l_linenumber, round(2 * ({_P_SQL}) - 1, 6) AS decision FROM lineitem")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round("decision", 6).alias("decision"))


@query("predict_threshold", f"SELECT l_orderkey, l_linenumber, ({_P_SQL} >= 0.5)::INTEGER AS prediction FROM lineitem")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("l_orderkey", "l_linenumber", "prediction")


@query("accuracy", f"SELECT round(avg((({_P_SQL} >= 0.5) = ({RULE}))::INTEGER), 6) AS accuracy FROM lineitem")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).agg(F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), 6).alias("accuracy"))


_COUNTS_SQL = "count(*) FILTER (y AND p) AS tp, count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (NOT y AND NOT p) AS tn, count(*) FILTER (NOT y AND p) AS fp"


@query("youden_j", f"SELECT *, round(tp / (tp + fn) + tn / (tn + fp) - 1, 6) AS j FROM (SELECT {_COUNTS_SQL} FROM (SELECT {RULE} AS y, {_P_SQL} >= 0.5 AS p FROM lineitem))")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.youden_table(_scored(spark, sf_dir), "label", "prediction").withColumn("j", F.round("j", 6))


@query(
    "roc_auc",
    """WITH r AS (SELECT l_returnflag = 'R' AS y, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2 AS rank FROM lineitem),
    c AS (SELECT sum(rank) FILTER (y) AS s, count(*) FILTER (y)::DOUBLE AS p, count(*) FILTER (NOT y)::DOUBLE AS n FROM r)
    SELECT round((s - p * (p + 1) / 2) / (p * n), 6) AS auc, p::BIGINT AS positives, n::BIGINT AS negatives FROM c""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc_table(_lineitem(spark, sf_dir), "label", "l_discount").withColumn("auc", F.round("auc", 6))


@query(
    "pr_curve",
    """WITH r AS (SELECT row_number() OVER o AS pos, sum((event_type = 'purchase')::INTEGER) OVER (o ROWS UNBOUNDED PRECEDING) AS tp, value AS threshold FROM events
        WINDOW o AS (ORDER BY value DESC, event_id))
    SELECT 0::BIGINT AS pos, 1.0::DOUBLE AS precision, 0.0::DOUBLE AS recall, 1.0::DOUBLE AS threshold
    UNION ALL SELECT pos, round(tp / pos, 6), round(tp / (SELECT max(tp) FROM r), 6), threshold FROM r""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pr_curve(_events(spark, sf_dir), "label", "value", "event_id").withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


# Splits


@query("kfold_split", "SELECT event_id, (ntile(3) OVER (ORDER BY event_id) - 1)::INTEGER AS fold FROM events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.key_folds(_read(spark, sf_dir, "events").select("event_id"), "event_id", 3)


@query("fold_sizes", "SELECT fold, count(*) AS n FROM (SELECT (ntile(7) OVER (ORDER BY event_id) - 1)::INTEGER AS fold FROM events) GROUP BY fold")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.hash_folds(_read(spark, sf_dir, "events").select("event_id"), ["event_id"], 7, 42).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query("train_test_split", "SELECT event_id FROM events ORDER BY event_id LIMIT (SELECT floor(0.7 * count(*))::BIGINT FROM events)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.train_test_split(_read(spark, sf_dir, "events").select("event_id"), "event_id", 0.7)[0]


@query("train_test_sizes", "SELECT floor(0.7 * count(*))::BIGINT AS train, count(*) - floor(0.7 * count(*))::BIGINT AS test, count(*) AS ids FROM events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded split: sizes of both parts, and that they share no row."""
    both = folds.split_column(_read(spark, sf_dir, "events").select("event_id"), "event_id", 0.7, 3)
    return both.agg(F.count_if("train").alias("train"), F.count_if(~F.col("train")).alias("test"), F.countDistinct("event_id").alias("ids"))


@query("exact_fold_sizes", "SELECT fold, count(*) AS n FROM (SELECT (ntile(7) OVER (ORDER BY event_id) - 1)::INTEGER AS fold FROM events) GROUP BY fold")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.exact_folds(_read(spark, sf_dir, "events").select("event_id"), "event_id", 7, 42).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


# Patterns and votes

_PATTERN_SQL = f"SELECT {', '.join(f'{_pm1_sql(f)} AS {f}' for f in FEATURES)}, ({RULE})::INTEGER AS label FROM lineitem"
_ORDER = polish.strongest(WEIGHTS, None)
_VOTES_SQL = " UNION ALL ".join(
    f"SELECT {k} AS k, ({' + '.join(f'({s}) * {f}' for f, s in _ORDER[:k])})::DOUBLE AS vote, sum(label)::BIGINT AS pos, count(*) AS n FROM ({_PATTERN_SQL}) GROUP BY vote" for k in range(1, len(_ORDER) + 1)
)


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixed().transform(_lineitem(spark, sf_dir, RULE)).drop("l_orderkey", "l_linenumber")


@query("pattern_counts", f"SELECT *, count(*) AS n FROM ({_PATTERN_SQL}) GROUP BY ALL")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _patterns(spark, sf_dir).groupBy(*FEATURES, "label").agg(F.count(F.lit(1)).alias("n"))


@query("vote_histogram", _VOTES_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polish.vote_histogram(_patterns(spark, sf_dir), _ORDER, "label")


def _polished(spark: SparkSession, sf_dir: str, **policy: object) -> DataFrame:
    found = polish.polish(_patterns(spark, sf_dir), WEIGHTS, INTERCEPT, "label", polish.Policy(**policy))
    return found.curve_table(spark).select("k", "feature", F.round("J", 6).alias("j"), F.round("b", 6).alias("b"))


_NAMED_SQL = "(VALUES " + ", ".join(f"({k + 1}, '{f}')" for k, (f, _) in enumerate(_ORDER)) + ") AS o(k, feature)"
_SUMS_SQL = f"SELECT k, sum(pos) AS p, sum(n - pos) AS q FROM ({_VOTES_SQL}) GROUP BY k"


def _mofk_sql(m: str) -> str:
    return f"""WITH v AS ({_VOTES_SQL}), t AS ({_SUMS_SQL}), b AS (SELECT k, -10.0 * (2 * {m} - k - 1) AS b FROM {_NAMED_SQL})
        SELECT k, feature, round(sum(CASE WHEN 10 * vote + b >= 0 THEN pos / p ELSE 0 END) + sum(CASE WHEN 10 * vote + b < 0 THEN (n - pos) / q ELSE 0 END) - 1, 6) AS j, round(b::DOUBLE, 6) AS b
        FROM v JOIN t USING (k) JOIN b USING (k) JOIN {_NAMED_SQL} USING (k) GROUP BY k, feature, b"""


@query("polish_mofk", _mofk_sql("ceil(0.6 * k)"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _polished(spark, sf_dir, intercept="mofk", m_frac=0.6)


@query("polish_k_scan", _mofk_sql("k"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _polished(spark, sf_dir, intercept="mofk")


@query("polish_maxj", f"""
    WITH v AS (SELECT k, 10 * vote AS s, pos, n FROM ({_VOTES_SQL})), t AS ({_SUMS_SQL}),
    e AS (SELECT k, s, lead(s) OVER (PARTITION BY k ORDER BY s) AS nxt FROM v),
    c AS (SELECT k, (s + nxt) / 2 AS thr FROM e WHERE nxt IS NOT NULL UNION ALL SELECT k, min(s) - 1e-9 FROM v GROUP BY k UNION ALL SELECT k, max(s) + 1e-9 FROM v GROUP BY k),
    j AS (SELECT k, thr, sum(CASE WHEN s >= thr THEN pos / p ELSE (n - pos) / q END) - 1 AS j FROM c JOIN v USING (k) JOIN t USING (k) GROUP BY k, thr)
    SELECT k, feature, round(j, 6) AS j, round(0 - thr, 6) AS b FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(j, 12) DESC, thr) AS r FROM j) JOIN {_NAMED_SQL} USING (k) WHERE r = 1""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _polished(spark, sf_dir, intercept="maxj")


_BEST_SQL = f"""
    WITH v AS (SELECT k, 10 * vote AS s, pos, n FROM ({_VOTES_SQL})), t AS ({_SUMS_SQL}),
    j AS (SELECT k, c.s AS thr, sum(CASE WHEN v.s >= c.s THEN pos / p ELSE (n - pos) / q END) - 1 AS j FROM (SELECT k, s FROM v) c JOIN v USING (k) JOIN t USING (k) GROUP BY k, c.s),
    best AS (SELECT k, max(round(j, 12)) AS j FROM j GROUP BY k),
    j0 AS (SELECT tp / (tp + fn) + tn / (tn + fp) - 1 AS j0 FROM (SELECT {_COUNTS_SQL} FROM (SELECT {RULE} AS y, {_P_SQL} >= 0.5 AS p FROM lineitem)))"""


@query("polish_choice", f"{_BEST_SQL} SELECT round(j0, 6) AS j0, (SELECT k FROM best ORDER BY j DESC, k LIMIT 1)::INTEGER AS k_chosen, round((SELECT max(j) FROM best), 6) AS j_chosen, (SELECT max(j) FROM best) >= 0.99 * j0 AS adopted FROM j0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base J, the k with the highest J, and whether the rule is adopted."""
    d = polish.polish(_patterns(spark, sf_dir), WEIGHTS, INTERCEPT, "label", polish.Policy(intercept="maxj")).diag
    return spark.createDataFrame([(round(d["J0"], 6), d["k_chosen"], round(d["J_chosen"], 6), d["adopted"])], "j0 double, k_chosen int, j_chosen double, adopted boolean")


@query("polish_scales", f"{_BEST_SQL} SELECT scale, round((SELECT max(j) FROM best), 6) AS j FROM (VALUES (2.0::DOUBLE), (10.0)) AS s(scale)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best J of each scale; thresholds of the highest J scale along, so it is the same."""
    found = polish.polish(_patterns(spark, sf_dir), WEIGHTS, INTERCEPT, "label", polish.Policy(intercept="maxj"), [2.0, 10.0])
    return found.scales_table(spark).select("scale", F.round("J", 6).alias("j"))


_SERIES = [0.2, 0.5, 0.6, 0.4, 0.3, 0.45, 0.7, 0.65]


@query("smooth_valley", f"""
    WITH s AS (SELECT * FROM (VALUES {", ".join(f"({i + 1}, {v})" for i, v in enumerate(_SERIES))}) AS v(k, j)),
    m AS (SELECT k, j, CASE WHEN k IN (1, {len(_SERIES)}) THEN j ELSE avg(j) OVER (ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END AS js FROM s),
    d AS (SELECT *, max(js) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) - js AS drop, lag(js) OVER (ORDER BY k) AS a, lead(js) OVER (ORDER BY k) AS b FROM m),
    v AS (SELECT coalesce(min(k) FILTER (drop >= 0.05 AND js <= a AND js <= b), ceil(0.5 * {len(_SERIES)})) AS valley FROM d)
    SELECT k, round(js::DOUBLE, 6) AS j_smooth, valley::INTEGER AS k_first_min, (SELECT arg_max(k, j) FROM s) AS k_global, (SELECT arg_max(k, j) FROM s, v WHERE k <= valley) AS k_premin FROM m, v""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    overall, early = (polish.choose_k(_SERIES, polish.Policy(k_policy=p)) for p in ("global", "premin"))
    rows = [(i + 1, round(v, 6), overall.valley, overall.k, early.k) for i, v in enumerate(overall.smooth)]
    return spark.createDataFrame(rows, "k int, j_smooth double, k_first_min int, k_global int, k_premin int")


_LOSSES = [[0.70, 0.52, 0.49, 0.50], [0.66, 0.60, 0.58, 0.57], [0.69, 0.55, 0.54, 0.56]]
_LOSSES_SQL = "(VALUES " + ", ".join(f"({f}, {p}, {v})" for f, row in enumerate(_LOSSES) for p, v in enumerate(row)) + ") AS l(fold, path_pos, loss)"
_MEANS_SQL = f"WITH m AS (SELECT path_pos, avg(loss) AS mean, stddev_samp(loss) / sqrt(count(*)) AS se FROM {_LOSSES_SQL} GROUP BY path_pos), b AS (SELECT * FROM m ORDER BY mean, path_pos LIMIT 1)"
for _rule, _sql in (("cv_min", "SELECT path_pos FROM b"), ("cv_one_se", "SELECT min(m.path_pos) AS path_pos FROM m, b WHERE m.mean <= b.mean + b.se")):
    query(_rule, f"{_MEANS_SQL} {_sql}")(
        lambda spark, sf_dir, rule=_rule: spark.createDataFrame([(choose([{"fold": f, "path_pos": p, "loss": v} for f, row in enumerate(_LOSSES) for p, v in enumerate(row)], "min" if rule == "cv_min" else "1se"),)], "path_pos int")
    )


# Whole fits. With one -1/+1 feature, the optimality conditions give the penalised fit in closed form: in either group of
# rows, the mean probability is the group's rate, moved towards the other's by 1 / (2 C rows). Fits of more features are
# held against the conditions by tests.

_FIT_C = [0.002, 0.01, 0.1, 5.0]
_FIT_LABEL = "value BETWEEN 60 AND 200 OR event_id % 7 = 0"
_FIT_SQL = f"""
    WITH x AS (SELECT ntile(3) OVER (ORDER BY event_id) - 1 AS fold, CASE WHEN value < 50 OR value > 120 THEN -1 ELSE 1 END AS x, ({_FIT_LABEL})::INTEGER AS y FROM events),
    g AS (
        SELECT f.fold, count(*) FILTER (x = 1) AS np, count(*) FILTER (x = -1) AS nm, avg(y) FILTER (x = 1) AS rp, avg(y) FILTER (x = -1) AS rm, avg(y) AS r
        FROM x JOIN (VALUES (0), (1), (2), (3)) AS f(fold) ON x.fold <> f.fold GROUP BY f.fold),
    c AS (SELECT * FROM (VALUES {", ".join(f"({i}, {c}::DOUBLE)" for i, c in enumerate(_FIT_C))}) AS c(path_pos, c)),
    p AS (
        SELECT fold, path_pos, c, abs(np * (r - rp) - nm * (r - rm)) > 1 / c AS used, r,
            rp - sign(rp - rm) / (2 * c * np) AS pp, rm + sign(rp - rm) / (2 * c * nm) AS pm FROM g, c),
    w AS (
        SELECT fold, path_pos, c, CASE WHEN used THEN (ln(pp / (1 - pp)) - ln(pm / (1 - pm))) / 2 ELSE 0 END AS w,
            CASE WHEN used THEN (ln(pp / (1 - pp)) + ln(pm / (1 - pm))) / 2 ELSE ln(r / (1 - r)) END AS b FROM p),
    l AS (
        SELECT w.fold::INTEGER AS fold, path_pos, c, avg(ln(1 + exp(b + w * x)) - y * (b + w * x)) AS val_loss FROM w JOIN x ON x.fold = w.fold GROUP BY ALL)"""


def _fit_one(spark: SparkSession, sf_dir: str, **params: object):
    frame = _read(spark, sf_dir, "events").select("event_id", "value", F.expr(f"int({_FIT_LABEL})").alias("label"))
    marked = RectifierModel([Limit("value", "value", 0, 50.0, 120.0)]).transform(folds.key_folds(frame, "event_id", 3))
    return L1LogisticCV(featureCols=["value"], labelCol="label", foldCol="fold", **({"Cs": _FIT_C, "cv": 3, "tol": 1e-6} | params)).fit(marked)


@query("fit_l1_losses", f"{_FIT_SQL} SELECT fold, path_pos, c, round(val_loss, 6) AS val_loss FROM l")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fit_one(spark, sf_dir).losses_table(spark).withColumn("val_loss", F.round("val_loss", 6)).withColumnRenamed("C", "c")


_CHOSEN_SQL = f"""{_FIT_SQL}, m AS (SELECT path_pos, avg(val_loss) AS mean FROM l GROUP BY path_pos),
    best AS (SELECT c, w, b FROM w WHERE fold = 3 AND path_pos = (SELECT path_pos FROM m ORDER BY mean, path_pos LIMIT 1))"""
_SOLVED = ["cd", "saga", "liblinear", "fista", "hybrid", "mllib"]


@query("fit_l1_solvers", f"{_CHOSEN_SQL} SELECT solver, round(w, 3) AS coef, round(b, 3) AS intercept FROM best, (VALUES {', '.join(f'({chr(39)}{n}{chr(39)})' for n in _SOLVED)}) AS s(solver)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same optimum by every solver, and by distributed fits as for large designs."""
    rows = []
    for name in _SOLVED:
        params = {"pattern_limit": 0} if name == "mllib" else {"solver": name, "tol": 1e-9}
        model = _fit_one(spark, sf_dir, **params)
        rows.append((name, round(model.coef["value"], 3), round(model.intercept, 3)))
    return spark.createDataFrame(rows, "solver string, coef double, intercept double")


@query("fit_l1_zero_clamp", f"{_CHOSEN_SQL} SELECT 0.0::DOUBLE AS coef, round(b, 4) AS intercept FROM best")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _fit_one(spark, sf_dir, zero_clamp=99.0)
    return spark.createDataFrame([(model.coef["value"], round(model.intercept, 4))], "coef double, intercept double")


@query("fit_base_rate", f"SELECT 0.0::DOUBLE AS coef, round(ln(r / (1 - r)), 6) AS intercept FROM (SELECT avg(({_FIT_LABEL})::INTEGER) AS r FROM events)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under a penalty that leaves no weight, the intercept is the log-odds of the label."""
    model = _fit_one(spark, sf_dir, Cs=[1e-7])
    return spark.createDataFrame([(model.coef["value"], round(model.intercept, 6))], "coef double, intercept double")


@query("penalty_grid", "SELECT i::INTEGER AS path_pos, 10.0 ** (2 * i - 4) AS c FROM range(5) AS r(i)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(grid(5))), "path_pos int, c double")


@query("fit_l1_coef", f"""{_FIT_SQL}, m AS (SELECT path_pos, avg(val_loss) AS mean FROM l GROUP BY path_pos)
    SELECT c, round(w, 4) AS coef, round(b, 4) AS intercept FROM w WHERE fold = 3 AND path_pos = (SELECT path_pos FROM m ORDER BY mean, path_pos LIMIT 1)""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _fit_one(spark, sf_dir)
    return spark.createDataFrame([(model.C, round(model.coef["value"], 4), round(model.intercept, 4))], "c double, coef double, intercept double")


@query("fit_predict_l1")
def fit_predict_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A penalty path with cross-validation on rectified columns, and the scores it gives."""
    frame = _fixed().transform(_lineitem(spark, sf_dir, RULE))
    model = L1LogisticCV(featureCols=FEATURES, labelCol="label", Cs=7, cv=3).fit(frame)
    return model.transform(frame).select("l_orderkey", "l_linenumber", "label", F.round("p1", 6).alias("p1"), "prediction")


_LEARNED_SQL = " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, {i} AS pos, CASE WHEN below >= greatest(1, floor(0.001 * n)) THEN lo END AS lo, CASE WHEN above >= greatest(1, floor(0.001 * n)) THEN hi END AS hi
    FROM (SELECT lo, hi, count(*) AS n, count(*) FILTER ({f} < lo) AS below, count(*) FILTER ({f} > hi) AS above FROM lineitem, (
        SELECT min({f}) AS lo, max({f}) AS hi FROM lineitem, (SELECT avg({f}) AS m, stddev_pop({f}) AS s FROM lineitem WHERE {RULE}) WHERE {RULE} AND {f} > m - 3 * s AND {f} < m + 3 * s)
        GROUP BY lo, hi)"""
    for i, f in enumerate(FEATURES)
)


# The label is a rule of two features, so the polish finds it: each has a vote, and J is highest where both ranges are met.
@query("fit_polish", f"""
    WITH l AS ({_LEARNED_SQL}), used AS (SELECT feature, lo, hi FROM l WHERE feature IN ('l_quantity', 'l_discount')),
    long AS (SELECT rid, y, feature, x FROM (SELECT row_number() OVER () AS rid, ({RULE}) AS y, {", ".join(FEATURES)} FROM lineitem) UNPIVOT (x FOR feature IN ({", ".join(FEATURES)}))),
    v AS (SELECT s, count(*) FILTER (y) AS pos, count(*) AS n FROM (
        SELECT rid, any_value(y) AS y, 10 * sum(CASE WHEN coalesce(x < lo, false) OR coalesce(x > hi, false) THEN -1 ELSE 1 END) AS s FROM long JOIN used USING (feature) GROUP BY rid) GROUP BY s),
    e AS (SELECT s, lead(s) OVER (ORDER BY s) AS nxt FROM v),
    j AS (SELECT thr, sum(CASE WHEN s >= thr THEN pos / p ELSE (n - pos) / q END) - 1 AS j FROM v, (SELECT sum(pos) AS p, sum(n - pos) AS q FROM v), (SELECT (s + nxt) / 2 AS thr FROM e WHERE nxt IS NOT NULL) GROUP BY thr)
    SELECT feature, lo, hi, CASE WHEN feature IN ('l_quantity', 'l_discount') THEN 10 ELSE 0 END::DOUBLE AS coef, (SELECT (0 - thr)::DOUBLE FROM j ORDER BY round(j, 12) DESC, thr LIMIT 1) AS intercept, true AS adopted FROM l""")
def fit_polish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole classifier with a polished rule: learned ranges, coefficients and the rule."""
    model = CriticalRangeClassifier(labelCol="label", featureCols=FEATURES, Cs=7, logic_polish=True, logic_intercept="maxj").fit(_lineitem(spark, sf_dir, RULE))
    rows = [(v.feature, v.lo, v.hi, float(model.coef[v.feature]), float(model.intercept), bool(model.diag["adopted"])) for v in model.limits]
    return spark.createDataFrame(rows, "feature string, lo double, hi double, coef double, intercept double, adopted boolean")


@query("polish_mean", f"""
    WITH RECURSIVE v AS ({_VOTES_SQL}), t AS (SELECT k, sum(pos) / sum(n) AS rate, sum(n) AS total, sum(pos) AS p, sum(n - pos) AS q FROM v GROUP BY k),
    halved AS (
        SELECT k, -40.0::DOUBLE AS lo, 40.0::DOUBLE AS hi, 0 AS i FROM t
        UNION ALL
        SELECT k, CASE WHEN over THEN lo ELSE mid END, CASE WHEN over THEN mid ELSE hi END, i + 1 FROM (
            SELECT h.k, lo, hi, i, (lo + hi) / 2 AS mid, sum(n / (1 + exp(-(2 * vote + (lo + hi) / 2)))) / any_value(total) > any_value(rate) AS over
            FROM halved h JOIN v ON v.k = h.k JOIN t ON t.k = h.k WHERE i < 50 GROUP BY h.k, lo, hi, i)),
    b AS (SELECT k, (lo + hi) / 2 AS b FROM halved WHERE i = 50)
    SELECT k, feature, round(sum(CASE WHEN 2 * vote + b >= 0 THEN pos / p ELSE 0 END) + sum(CASE WHEN 2 * vote + b < 0 THEN (n - pos) / q ELSE 0 END) - 1, 6) AS j, round(b, 6) AS b
    FROM v JOIN t USING (k) JOIN b USING (k) JOIN {_NAMED_SQL} USING (k) GROUP BY k, feature, b""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _polished(spark, sf_dir, intercept="mean", scale=2.0)


@query("experiment_grid")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 10).cast("double").alias("digit"), F.expr("int(o_totalprice BETWEEN 100000 AND 200000 AND o_custkey % 10 < 5)").alias("label"))
    configs = [ExperimentConfig(seed=s, logic_intercept=i) for s, i in ((1, "mean"), (1, "maxj"), (2, "mofk"))]
    return run_experiments(frame, "label", "o_orderkey", configs, Cs=5, cv=3)


_STREAM_X = "CASE WHEN value < 50 OR value > 120 THEN -1 ELSE 1 END::TINYINT"


@query("stream_rectify_score", f"SELECT event_id, value, round(1 / (1 + exp(-(0.75 * value - 0.5))), 6) AS p1, (0.75 * value - 0.5 >= 0)::INTEGER AS prediction FROM (SELECT event_id, {_STREAM_X} AS value FROM events)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _place(spark, "stream")
    schema = _read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select("event_id", "value")
    marked = apply(stream, RectifierModel([Limit("value", "value", 0, 50.0, 120.0)]))
    scored = apply(marked, L1LogisticModel({"value": 0.75}, -0.5, 1.0, [1.0]), ["event_id", "value", "p1", "prediction"])
    query = append_to(scored.withColumn("p1", F.round("p1", 6)), f"{place}/out", f"{place}/state")
    query.awaitTermination()
    return spark.read.parquet(f"{place}/out")


def _place(spark: SparkSession, name: str) -> str:
    """A new folder for a query's files in the shared folder of the session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.gettempdir()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("csv_roundtrip", "SELECT n_nationkey::INTEGER AS n_nationkey, n_name, n_regionkey::INTEGER AS n_regionkey FROM nation")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _place(spark, "csv")
    frames.write_csv(_read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), place)
    return frames.read_csv(spark, place).select(F.col("n_nationkey").cast("int"), "n_name", F.col("n_regionkey").cast("int"))


@query("model_roundtrip", f"SELECT l_orderkey, l_linenumber, ({RULE})::INTEGER AS prediction FROM lineitem")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole classifier, saved, loaded and applied: it has found the rule that made the label."""
    frame, place = _lineitem(spark, sf_dir, RULE), _place(spark, "model")
    model = CriticalRangeClassifier(labelCol="label", featureCols=FEATURES, Cs=7, logic_polish=True, logic_intercept="maxj").fit(frame)
    save_model(spark, model, place)
    return load_model(spark, place).transform(frame).select("l_orderkey", "l_linenumber", "prediction")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn a classifier of a rule over lineitem and score every row with it."""
    frame = _lineitem(spark, sf_dir, RULE)
    model = CriticalRangeClassifier(labelCol="label", featureCols=FEATURES, Cs=7, logic_polish=True, logic_intercept="maxj").fit(frame)
    return model.transform(frame).select("l_orderkey", "l_linenumber", "label", "p1", "decision", "prediction")
