"""Mixing sources to target weights by Pfair scheduling.

The rows of every source are cut into blocks. Time is counted in slots of one block. In the ideal mix, a source with
weight w and n blocks has had min(n, w v) of them at virtual time v, and v(t) is where these sum to t; so a source that
runs out leaves its share to the others in proportion. Block i is released in the slot in which the ideal mix reaches
it and due by the end of the slot in which the ideal mix completes it; in every slot the released block with the
earliest deadline runs. No deadline is missed, and after every slot each source is less than one block from its ideal.

Weights are taken as the exact rationals that they are and compared in whole numbers, so nothing is rounded however long
the mix runs. One task makes the schedule and hands it on as it goes: it holds the sources, and the schedule has one row
for each block. It is broadcast if it has at most BROADCAST_BLOCKS rows, else joined by source and block. Every source is
scheduled by its own weight, however many there are.

Within a source, rows are ordered by a hash of their id and text, so neither a null nor a repeated id gathers rows. Ranks
come from small hash buckets plus the counts of the buckets before, so no source is ranked in one task; only rows that
are equal in id and text share a bucket whatever their number.

Edge cases: a null source is a source of its own; null and repeated doc_ids, null, empty and long texts are rows like
others; rows that are equal in id and text may change places; equal deadlines go to the source first in order; a target
of 0 or none given for a source puts its rows after all others'; other columns pass through, whatever their names; an
empty table gives an empty table. No row is dropped.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator, Mapping, Sequence
from fractions import Fraction
from itertools import batched
from math import lcm
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import quoted
from tidemark.llm.common import bounded

#: Slots that the schedule hands on at once.
BATCH = 1024
#: Rows in a block, and about the rows that are ranked in one task's sort at once.
BLOCK_ROWS, BUCKET_ROWS = 64, 4_096
#: Blocks of all sources up to which the schedule is broadcast, about 25 MB.
BROADCAST_BLOCKS = 250_000


def slots(units: Iterable[tuple[Any, int, float]]) -> Iterator[tuple[Any, int, int]]:
    """(unit, block, slot) of every block, by slot, of units given as (unit, blocks, weight above 0); ties go to the first."""
    rows = [(u, n, Fraction(w)) for u, n, w in units if n]
    scale = lcm(*(w.denominator for _, _, w in rows))
    names, blocks, weight = [u for u, _, _ in rows], [n for _, n, _ in rows], [int(w * scale) for _, _, w in rows]
    # Fractions of two weights differ by at least 1 over their product, so this many binary digits order them exactly.
    digits = 2 * max(weight, default=1).bit_length() + 1
    ends = sorted(range(len(rows)), key=lambda k: Fraction(blocks[k], weight[k]), reverse=True)
    waiting = [(0, k, 0) for k in range(len(rows))]
    ready: list[tuple[int, int, int]] = []
    done, active = 0, sum(weight)
    for t in range(sum(blocks)):
        # At the slot's end the virtual time is (t + 1 - done) / active; units that end before have had all their blocks.
        while ends and active * blocks[ends[-1]] <= (t + 1 - done) * weight[ends[-1]]:
            k = ends.pop()
            done, active = done + blocks[k], active - weight[k]
        while waiting and (not ends or waiting[0][2] * active < (t + 1 - done) * weight[waiting[0][1]]):
            _, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, ((i + 1 << digits) // weight[k], k, i))
        _, k, i = heapq.heappop(ready)
        yield names[k], i, t
        if i + 1 < blocks[k]:
            heapq.heappush(waiting, ((i + 1 << digits) // weight[k], k, i + 1))


def planned(units: Iterable[tuple[Any, int, float]]) -> Iterator[tuple[Any, int, int]]:
    """:func:`slots` of the units with a weight, then of the others by weights of 1."""
    units = list(units)
    first = [x for x in units if x[2] > 0]
    base = sum(n for _, n, _ in first)
    yield from slots(first)
    yield from ((u, i, base + t) for u, i, t in slots((u, n, 1) for u, n, w in units if not w > 0))


def _plan(units: DataFrame, given: dict[Any, float] | None) -> DataFrame:
    """The schedule (u, block, slot) of a table (u, blocks, w), made in one task; ``given`` weights replace w."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, kind = [], pa.null()
        for b in batches:
            kind = b.schema.field("u").type
            own = zip(*(b.column(c).to_pylist() for c in ("u", "blocks", "w")), strict=True)
            rows += own if given is None else ((u, n, given.get(u, 0.0)) for u, n, _ in own)
        rows.sort(key=lambda r: (False,) if r[0] is None else (True, r[0]))
        for part in batched(planned(rows), BATCH):
            u, block, slot = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, kind), pa.array(block, pa.int64()), pa.array(slot, pa.int64())], ["u", "block", "slot"])

    kind = units.schema["u"].dataType.simpleString()
    return bounded(units.select("u", "blocks", "w")).repartition(1).mapInArrow(run, f"u {kind}, block long, slot long")


def _joined(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join by u, where null is a source like others, and ``key``."""
    right = right.withColumnsRenamed({"u": "__u", key: "__key"})
    return left.join(right, F.col("u").eqNullSafe(F.col("__u")) & (F.col(key) == F.col("__key"))).drop("__u", "__key")


def mix(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, source: str = "source", doc_id: str = "doc_id", text: str = "text",
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """Every row of ``docs`` as the struct ``row`` (of all columns, or those in ``carry``), with its block (within its
    source), slot, and position in the mix.

    Without weights, a source's target is the square root of its rows.
    """
    given = None if weights is None else {k: float(w) for k, w in weights.items()}
    counts = docs.groupBy(F.col(source).alias("u")).agg(F.count(F.lit(1)).alias("n"))
    most, blocks = counts.agg(F.max("n"), F.sum(F.ceil(F.col("n") / BLOCK_ROWS))).first()
    plan = _plan(counts.select("u", F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks"), F.sqrt("n").alias("w")), given)
    if (blocks or 0) <= BROADCAST_BLOCKS:
        plan = F.broadcast(plan)

    buckets = F.lit(max(1, -(-(most or 1) // BUCKET_ROWS)))
    key = F.xxhash64(doc_id, text)
    row = F.struct(*(["*"] if carry is None else map(quoted, carry)))
    keyed = docs.select(row.alias("row"), F.col(source).alias("u"), key.alias("key"), F.col(doc_id).alias("id"))
    keyed = keyed.withColumn("bucket", F.pmod("key", buckets).cast("int"))
    sums = docs.groupBy(F.col(source).alias("u"), F.pmod(key, buckets).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    before = sums.select("u", "bucket", (F.sum("n").over(Window.partitionBy("u").orderBy("bucket")) - F.col("n")).alias("before"))
    # A bucket's count comes into its window as a first row: a join by a source that may be null would shuffle the texts again.
    inside = Window.partitionBy("u", "bucket").orderBy(F.col("before").isNull(), "key", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = keyed.unionByName(before, allowMissingColumns=True)
    ranked = both.withColumn("rank", F.row_number().over(inside).cast("long") - 2 + F.max("before").over(inside)).filter(F.col("before").isNull())
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / BLOCK_ROWS))
    placed = _joined(ranked, plan, "block")
    return placed.select("row", "block", "slot", (F.col("slot") * BLOCK_ROWS + F.col("rank") % BLOCK_ROWS).alias("position"))


def mix_report(docs: DataFrame, weights: Mapping[str | None, float] | None = None) -> DataFrame:
    """Per document: doc_id, source, block (within its source), slot and position in the mix."""
    return mix(docs, weights, carry=["doc_id", "source"]).select("row.doc_id", "row.source", "block", "slot", "position")


def mixed(docs: DataFrame, weights: Mapping[str | None, float] | None = None, position: str | None = None) -> DataFrame:
    """``docs`` in the order of the mix, with the place in it as a column ``position`` if it is to have a name."""
    ordered = mix(docs, weights).orderBy("position")
    return ordered.select("row.*", *([F.col("position").alias(position)] if position else []))
