import pytest

from tidemark.operators.dedupe import DuplicateColumnConsolidator

ROWS = [(1, 1, 1, -1), (-1, -1, -1, -1), (1, 1, 1, 1), (-1, -1, -1, 1)]
NAMES = ["P1_A_1", "P1_A_2", "P2_B_1", "P3_C_1"]


def fit(spark, **params):
    return DuplicateColumnConsolidator(featureCols=NAMES, **params).fit(spark.createDataFrame(ROWS, ", ".join(f"{n} int" for n in NAMES)))


def test_within_group(spark):
    model = fit(spark)
    assert model.features == [n for n in NAMES if n != "P1_A_2"]
    assert (model.report["duplicate_cols_removed"], model.report["cross_group_alias_classes"], model.report["duplicate_groups"]) == (1, 1, 1)
    assert list(model.expand([6, 4, 2]).values()) == [3, 3, 4, 2]
    assert list(model.expand([6, 4, 2], "representative_only").values()) == [6, 6, 4, 2]
    assert list(model.expand({"P2_B_1": 4.0, "other": 1.0}).values()) == [0, 0, 4, 0]
    out = model.transform(spark.createDataFrame(ROWS, ", ".join(f"{n} int" for n in NAMES)))
    assert out.columns == model.features
    table = model.expand_table(spark.createDataFrame([("P1_A_1", 6.0), ("P2_B_1", 4.0)], "feature string, coef double"))
    assert {r.feature: r.coef for r in table.collect()} == {"P1_A_1": 3.0, "P1_A_2": 3.0, "P2_B_1": 4.0, "P3_C_1": 0.0}


def test_global_and_none(spark):
    model = fit(spark, mode="global")
    assert model.features == ["P1_A_1", "P3_C_1"]
    assert list(model.expand([6, 2]).values()) == [2, 2, 2, 2]
    assert fit(spark, mode="none").features == NAMES


def test_errors(spark):
    with pytest.raises(ValueError):
        fit(spark, mode="some")
    with pytest.raises(ValueError):
        fit(spark).expand([1.0])
    with pytest.raises(ValueError):
        fit(spark).expand([1.0, 2.0, 3.0], "halves")
    with pytest.raises(ValueError):
        fit(spark).transform(spark.createDataFrame([(1,)], "P1_A_1 int"))


def test_values_not_multisets(spark):
    rows = [(1.0, 0.0, float("nan"), None, 0.0), (0.0, 1.0, 2.0, 2.0, -0.0), (1.0, 0.0, None, None, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    classes = [c.members for c in DuplicateColumnConsolidator(mode="global").fit(df).duplicate_classes]
    assert classes == [("a",), ("b",), ("c", "d"), ("e",)]
    assert DuplicateColumnConsolidator(mode="global").fit(df.limit(0)).features == ["a"]
