"""Splits: k folds of which the first n mod k are one larger, and train/test splits of an exact size."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.cluster import ship
from tidemark.functions.expr import quoted
from tidemark.operators.running import ranked

#: Rows that the "exact" mode handles at once.
BATCH_ROWS = 1 << 16


def fold_of(rank: Column, n: int, k: int) -> Column:
    """The fold of a rank from 0 when n rows are cut into k runs, the first n mod k of them one longer."""
    short, long = divmod(n, k)
    edge = long * (short + 1)
    return F.when(rank < edge, F.floor(rank / (short + 1))).otherwise(long + F.floor((rank - edge) / max(1, short))).cast("int")


def _shuffled(df: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    hashed = F.xxhash64(F.lit(seed), *(quoted(k) for k in keys))
    return df.withColumn("__hash", hashed)


def hash_folds(df: DataFrame, keys: Sequence[str], k: int, seed: int, out: str = "fold") -> DataFrame:
    """``df`` with folds by the rank of a seeded hash of the key columns."""
    if k < 2:
        raise ValueError("at least two folds are needed")
    n = df.count()
    ranks = ranked(_shuffled(df, keys, seed), "__hash", "__rank", keys)
    return ranks.withColumn(out, fold_of(F.col("__rank"), n, k)).drop("__rank", "__hash")


def key_folds(df: DataFrame, key: str, k: int, out: str = "fold") -> DataFrame:
    """``df`` with folds by the rank of a numeric key."""
    return ranked(df, key, "__rank").withColumn(out, fold_of(F.col("__rank"), df.count(), k)).drop("__rank")


def shuffled_folds(spark: SparkSession, n: int, k: int, seed: int, out: str = "fold") -> DataFrame:
    """The fold of every rank from 0 to n - 1 by NumPy's seeded shuffle of them, as columns __rank and ``out``.

    The shuffle is one sequence of draws, so one task makes it, of any length: its arrays are files in the task's temporary
    folder, 5 bytes a row up to 256 folds and 2**32 rows, and rows leave it in batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            with tempfile.TemporaryDirectory() as folder:
                array = lambda name, kind: np.asarray(np.memmap(f"{folder}/{name}", kind, "w+", shape=n))
                order, fold = array("order", np.min_scalar_type(n - 1)), array("fold", np.min_scalar_type(k - 1))
                for at in range(0, n, BATCH_ROWS):
                    order[at : at + BATCH_ROWS] = np.arange(at, min(n, at + BATCH_ROWS))
                np.random.default_rng(seed).shuffle(order)
                short, long = divmod(n, k)
                for i in range(k):
                    start, end = i * short + min(i, long), (i + 1) * short + min(i + 1, long)
                    for at in range(start, end, BATCH_ROWS):
                        fold[order[at : min(end, at + BATCH_ROWS)]] = i
                for at in range(0, n, BATCH_ROWS):
                    part = fold[at : at + BATCH_ROWS].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), pa.array(part)], names=["__rank", "fold"])

    ship(spark)
    return spark.range(0, min(n, 1), 1, 1).mapInArrow(run, "__rank long, fold int").toDF("__rank", out)


def exact_folds(df: DataFrame, row_id: str, k: int, seed: int, out: str = "fold") -> DataFrame:
    """``df`` with the folds that NumPy's seeded shuffle of row positions gives, positions being ranks of ``row_id``."""
    if k < 2:
        raise ValueError("at least two folds are needed")
    # Spark takes the folds for as small as the one row that they are made from, and would broadcast them.
    table = shuffled_folds(df.sparkSession, df.count(), k, seed, out).hint("merge")
    return ranked(df, row_id, "__rank").join(table, "__rank").drop("__rank")


def split_column(df: DataFrame, key: str, frac: float, seed: int | None = None, out: str = "train") -> DataFrame:
    """``df`` with whether a row is in the first part: exactly floor(frac * n) rows, those of lowest seeded hash of the key,
    or of lowest key without a seed."""
    cut = math.floor(frac * df.count())
    ranks = ranked(df, key, "__rank") if seed is None else ranked(_shuffled(df, [key], seed), "__hash", "__rank", [key]).drop("__hash")
    return ranks.withColumn(out, F.col("__rank") < cut).drop("__rank")


def train_test_split(df: DataFrame, key: str, frac: float, seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The two parts of :func:`split_column` as tables."""
    both = split_column(df, key, frac, seed, "__first")
    return both.filter("__first").drop("__first"), both.filter("not __first").drop("__first")
