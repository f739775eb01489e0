"""Feature frames: CSV in and out, and columns of numbers from arrays and timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.expr import quoted


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV table with a header; without a schema, types are inferred by another pass."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """``df`` as CSV with a header; ``single`` makes one file of a small result."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def fan_out(df: DataFrame, array: str, size: int, prefix: str) -> DataFrame:
    """``df`` with the array's first ``size`` values as double columns prefix0, prefix1, ...; missing ones are NULL."""
    values = [F.get(quoted(array), F.lit(i)).cast("double").alias(f"{prefix}{i}") for i in range(size)]
    return df.select(*(quoted(c) for c in df.columns if c != array), *values)


def numbers(df: DataFrame) -> DataFrame:
    """``df`` with decimals and booleans as doubles, and timestamps and dates as seconds."""

    def cast(f: T.StructField):
        x = quoted(f.name)
        if isinstance(f.dataType, (T.DecimalType, T.BooleanType)):
            return x.cast("double").alias(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return (F.unix_micros(x.cast("timestamp")) / 1e6).alias(f.name)
        return x

    return df.select(*(cast(f) for f in df.schema.fields))
