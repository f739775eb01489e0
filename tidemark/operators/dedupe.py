"""Duplicate columns: find columns that are equal in every row, keep one of each class, and spread coefficients back.

Each column gets a fingerprint in one aggregate: a sum and an exclusive or of hashes of its value with a hash of the whole
row, so equal columns have equal fingerprints and no row id is needed. Columns that share one are then compared value by value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import naming
from tidemark.functions.expr import clean, quoted
from tidemark.operators.base import Fitted, Learner, numeric_columns, one_of, require

MODES, EXPANSIONS = ("none", "within_group", "global"), ("split_evenly", "representative_only")


@dataclass(frozen=True)
class DuplicateClass:
    """Columns that are equal; the first represents them."""

    members: tuple[str, ...]

    @property
    def rep(self) -> str:
        return self.members[0]


def equal_columns(df: DataFrame, names: Sequence[str]) -> list[list[str]]:
    """Names by equality of their columns, in order. NaN equals NULL, and 0.0 equals -0.0."""
    if not names:
        return []
    values = {n: clean(quoted(n)) for n in names}
    row = F.xxhash64(*values.values())
    # Sums of 16-bit numbers don't overflow below 2**47 rows.
    hashed = lambda n, seed: F.xxhash64(row, F.lit(seed), values[n])
    prints = [p for n in names for p in (F.sum(hashed(n, 1).bitwiseAND(F.lit(0xFFFF))), F.bit_xor(hashed(n, 2)))]
    found = df.agg(*(p.alias(f"c{i}") for i, p in enumerate(prints))).first()
    buckets: dict[tuple, list[str]] = {}
    for i, n in enumerate(names):
        buckets.setdefault((found[2 * i], found[2 * i + 1]), []).append(n)
    tests = [(members[0], n) for members in buckets.values() for n in members[1:]]
    if not tests:
        return [[n] for n in names]
    same = df.agg(*(F.bool_and(values[a].eqNullSafe(values[b])).alias(f"c{i}") for i, (a, b) in enumerate(tests))).first()
    owner = {b: a for (a, b), ok in zip(tests, same, strict=True) if ok is not False}
    classes: dict[str, list[str]] = {}
    for n in names:
        classes.setdefault(owner.get(n, n), []).append(n)
    return list(classes.values())


class DuplicateColumnConsolidator(Learner):
    """Learns classes of duplicate columns: within root groups, over all columns, or none."""

    PARAMS = {"featureCols": None, "labelCol": None, "mode": "within_group", "expansion": "split_evenly"}

    def _fit(self, df: DataFrame) -> DuplicateColumnModel:
        v = self.values()
        one_of("mode", v.mode, MODES)
        one_of("expansion", v.expansion, EXPANSIONS)
        names = list(v.featureCols) if v.featureCols else numeric_columns(df, [v.labelCol])
        require(df, names)
        naming.check_names(names)
        everywhere = equal_columns(df, names)
        if v.mode == "none":
            classes = [[n] for n in names]
        elif v.mode == "global":
            classes = everywhere
        else:
            split: dict[tuple[str, str], list[str]] = {}
            for members in everywhere:
                for n in members:
                    split.setdefault((naming.root_group(n), members[0]), []).append(n)
            classes = list(split.values())
        place = {n: i for i, n in enumerate(names)}
        classes = sorted((sorted(c, key=place.get) for c in classes), key=lambda c: place[c[0]])
        aliases = sum(len(c) > 1 and len({naming.root_group(n) for n in c}) > 1 for c in everywhere)
        return DuplicateColumnModel(names, [DuplicateClass(tuple(c)) for c in classes], v.mode, v.expansion, aliases)


class DuplicateColumnModel(Fitted):
    """Learned classes."""

    def __init__(self, input_features: Sequence[str], classes: Sequence[DuplicateClass], mode: str, expansion: str, cross_group_alias_classes: int):
        super().__init__()
        self.input_features, self.duplicate_classes = list(input_features), list(classes)
        self.mode, self.expansion, self.cross_group_alias_classes = mode, expansion, cross_group_alias_classes

    def state(self) -> dict[str, object]:
        classes = [list(c.members) for c in self.duplicate_classes]
        return {
            "input_features": self.input_features, "classes": classes, "mode": self.mode, "expansion": self.expansion,
            "cross_group_alias_classes": self.cross_group_alias_classes,
        }

    @classmethod
    def from_state(cls, state: dict) -> DuplicateColumnModel:
        return cls(**(state | {"classes": [DuplicateClass(tuple(c)) for c in state["classes"]]}))

    @property
    def features(self) -> list[str]:
        """The representatives, in order."""
        return [c.rep for c in self.duplicate_classes]

    @property
    def report(self) -> dict[str, object]:
        """What was found, as the fields of a one-row table."""
        return {
            "mode": self.mode,
            "expansion": self.expansion,
            "input_features": len(self.input_features),
            "fit_features": len(self.features),
            "duplicate_groups": sum(len(c.members) > 1 for c in self.duplicate_classes),
            "duplicate_cols_removed": len(self.input_features) - len(self.features),
            "cross_group_alias_classes": self.cross_group_alias_classes,
        }

    def classes_table(self, spark: SparkSession) -> DataFrame:
        """Rows (class_id, rep, member, pos, root)."""
        place = {n: i for i, n in enumerate(self.input_features)}
        rows = [(i, c.rep, m, place[m], naming.root_group(m)) for i, c in enumerate(self.duplicate_classes) for m in c.members]
        return spark.createDataFrame(rows, "class_id int, rep string, member string, pos int, root string")

    def _transform(self, df: DataFrame) -> DataFrame:
        require(df, self.input_features)
        gone = set(self.input_features) - set(self.features)
        return df.select(*(quoted(c) for c in df.columns if c not in gone))

    def expand(self, coef: Mapping[str, float] | Sequence[float], expansion: str | None = None) -> dict[str, float]:
        """Coefficients of all input features. split_evenly shares a class's coefficient; representative_only, despite
        its name, gives the whole of it to every member."""
        how = self.expansion if expansion is None else expansion
        one_of("expansion", how, EXPANSIONS)
        if not isinstance(coef, Mapping):
            if len(coef) != len(self.features):
                raise ValueError("as many coefficients as representatives are needed")
            coef = dict(zip(self.features, coef, strict=True))
        of = {m: (c.rep, len(c.members) if how == "split_evenly" else 1) for c in self.duplicate_classes for m in c.members}
        return {n: float(coef.get(of[n][0], 0.0)) / of[n][1] for n in self.input_features}

    def expand_table(self, coef: DataFrame, expansion: str | None = None) -> DataFrame:
        """The same by a join: (feature, coef) of representatives becomes (feature, pos, coef) of all members."""
        how = self.expansion if expansion is None else expansion
        one_of("expansion", how, EXPANSIONS)
        sizes = [(c.rep, m, self.input_features.index(m), len(c.members) if how == "split_evenly" else 1) for c in self.duplicate_classes for m in c.members]
        table = coef.sparkSession.createDataFrame(sizes, "rep string, member string, pos int, shares int")
        joined = table.join(coef.select(F.col("feature").alias("rep"), "coef"), "rep", "left")
        return joined.select(F.col("member").alias("feature"), "pos", (F.coalesce("coef", F.lit(0.0)) / F.col("shares")).alias("coef"))
