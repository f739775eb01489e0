"""Fitted models on Structured Streaming frames: rectifying and scoring are row-local, so they need no state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.classifier import CriticalRangeModel
from tidemark.operators.rectify import RectifierModel


def apply(stream: DataFrame, model: CriticalRangeModel | RectifierModel, columns: Sequence[str] | None = None) -> DataFrame:
    """The model's output on a stream (or a table), all or some columns."""
    out = model.transform(stream)
    return out.select(*columns) if columns else out


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there, and then ends, to Parquet below ``path``; rows are written once even if it is run again."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
