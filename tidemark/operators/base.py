"""What all estimators and models share: pyspark.ml parameters, and saving as steps of a pyspark.ml Pipeline."""

from __future__ import annotations

from collections.abc import Sequence
from types import SimpleNamespace
from typing import Any

from pyspark.ml.base import Estimator, Model
from pyspark.ml.param import Param
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Learner(Estimator, DefaultParamsWritable, DefaultParamsReadable):
    """An estimator with the parameters and defaults in ``PARAMS``; each is a pyspark.ml Param of that name."""

    PARAMS: dict[str, object] = {}

    def __init__(self, **params: object):
        super().__init__()
        if unknown := set(params) - set(self.PARAMS):
            raise TypeError(f"unknown parameters: {sorted(unknown)}")
        for name in self.PARAMS:
            setattr(self, name, Param(self, name, f"see {type(self).__name__}"))
        self._setDefault(**self.PARAMS)
        self._set(**params)

    def values(self) -> Any:
        """All parameters as attributes."""
        return SimpleNamespace(**self.get_params())

    def get_params(self) -> dict[str, object]:
        """All parameters by name."""
        return {name: self.getOrDefault(name) for name in self.PARAMS}

    def set_params(self, **params: object) -> Learner:
        """Changes parameters; unknown names raise ValueError."""
        if unknown := set(params) - set(self.PARAMS):
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        return self._set(**params)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        """``df`` through the model that is fitted to it."""
        return self.fit(df).transform(df)


class Fitted(Model, MLWritable, MLReadable):
    """A model with plain attributes, written as what :meth:`state` gives."""

    def state(self) -> dict[str, Any]:
        """What JSON can hold of the model."""
        raise NotImplementedError

    @classmethod
    def from_state(cls, state: dict[str, Any]) -> Fitted:
        """The model of a state."""
        return cls(**state)

    def write(self) -> MLWriter:
        """A writer of pyspark.ml."""
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        """A reader of pyspark.ml."""
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: Fitted):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        DefaultParamsWriter.saveMetadata(self.model, path, SparkSession.getActiveSession() or self.sparkSession, extraMetadata={"state": self.model.state()})


class _Reader(MLReader):
    def __init__(self, cls: type[Fitted]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> Fitted:
        return self.cls.from_state(DefaultParamsReader.loadMetadata(path, SparkSession.getActiveSession() or self.sparkSession)["state"])


def one_of(name: str, value: object, allowed: Sequence[object]) -> None:
    """Raises ValueError unless the value is allowed."""
    if value not in allowed:
        raise ValueError(f"{name} must be one of {list(allowed)}, not {value!r}")


def numeric_columns(df: DataFrame, leave_out: Sequence[str | None]) -> list[str]:
    """Columns that hold numbers or booleans, in order, without some."""
    skip = set(leave_out)
    return [f.name for f in df.schema.fields if f.name not in skip and isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def require(df: DataFrame, names: Sequence[str]) -> None:
    """Raises ValueError if columns are missing."""
    if missing := [n for n in names if n not in set(df.columns)]:
        raise ValueError(f"missing features: {missing}")
