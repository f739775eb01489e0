"""Helpers that several corpus operators share."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.cluster import ship

#: Text handled at once inside a Python worker, in bytes; arrays over its bytes are several times as large.
CHUNK_BYTES = 1 << 18

#: Most bytes of the batches that Spark hands to a Python worker; by default it takes 64 MB, held several times over.
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Words of the contracts: runs of anything but these six ASCII blanks.
WORD_BREAKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame) -> DataFrame:
    """``df``, whose session can import this package in its workers and is set to Arrow batches of at most BATCH_BYTES, unless they are smaller already."""
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    now = str(conf.get(_BATCH_KEY, f"{BATCH_BYTES + 1}")).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(_BATCH_KEY, BATCH_BYTES)
    return df


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` with batches and a schema of any column names, dots included, which Spark itself can't resolve here."""
    names, new = df.columns, schema.names
    plain = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=plain.names)

    return bounded(df).toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(renamed, plain).toDF(*new)


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold at most ``limit`` bytes of ``text``, or one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of UTF-8 bytes with a newline after each, and the n + 1 row starts in it; null is empty."""
    rows = [(x or "").encode() for x in column.to_pylist()]
    starts = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in rows], out=starts[1:])
    return np.frombuffer(b"\n".join([*rows, b""]), np.uint8), starts


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64); values wrap."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and cut from its lineage, so lost executors cost no recomputation.

    The folder is the session's, or the one in spark.checkpoint.dir. Only in local mode may there be none: all of it runs
    on one machine then, and a folder of its own is made.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def placed(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """``df`` checkpointed in partitions by ``key``, which later joins and groups by the key find in place.

    There are ``parts`` of them, or as many as the session's shuffles have.

    An adaptive plan doesn't report its partitions to a checkpoint, so this one plan is not adaptive.
    """
    conf, adaptive = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(adaptive)
    conf.set(adaptive, False)
    try:
        return checkpointed(df.repartition(parts or int(conf.get("spark.sql.shuffle.partitions")), key))
    finally:
        conf.set(adaptive, before)


def sweep(spark: SparkSession) -> None:
    """Lets the driver notice which tables are out of use, so that Spark removes their shuffle files before the job ends."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def folded(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
