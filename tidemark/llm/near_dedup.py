"""Near-duplicate detection with b-bit MinHash over word shingles.

A document's set holds the hashes of its distinct word shingles. HASHES minima of the set are cut into BANDS bands, and
documents that share a band's minima are candidates. Of every minimum, the low BITS bits are kept in a packed
signature; the share of equal slots, counted with bit operations and corrected for chance collisions, estimates the
similarity, and only pairs with an estimate near the threshold or above go on. Links are confirmed on the full sets.

The result is exact up to what banding and estimate miss: at similarity 0.8 a pair shares no band with a probability
of (1 - 0.8**4)**32, about 5e-8, and an estimate below ESTIMATE lies over five standard deviations low.

No group is ever expanded into all its pairs:

1. Documents with equal sets are one class, represented by their smallest doc_id.
2. In each band bucket every class is paired with the smallest one only (a partial aggregate and a join, so a hot
   bucket is pre-aggregated and can be split).
3. Confirmed pairs are linked into components by alternating large-star and small-star rounds on tables of edges.
4. Buckets that still span several components are compared again, across components only, in blocks of bounded size;
   first the best few partners of each class, then more, then all that are left. Untested pairs inside one component
   can't change the result. Every pair is found in the first bucket that it shares only.
5. Of pairs whose classes both have many, the sets meet in blocks too, so a set is sent once for each block that it meets
   and not once for each pair. The pairs compared in a family of unlinked documents still grow with its square.

Edge cases: a null or empty text, or one without words, has an empty set and is linked with nothing; with fewer words
than a shingle takes, all of them are the only shingle; long texts are read whole; pairs at the threshold itself are
linked; rows that share a doc_id count as linked; a null doc_id takes no part, gets a null component and is kept; other
columns pass through :func:`deduplicated`, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import quoted
from tidemark.llm.common import bounded, checkpointed, chunks, mix64, placed, sweep
from tidemark.llm.words import Words

BANDS, BAND_ROWS, BITS = 32, 4, 4
HASHES = BANDS * BAND_ROWS
#: Pairs with a lower estimated similarity are dropped without a look at their sets.
ESTIMATE = 0.6
#: Classes of a bucket that are compared at once when its components are.
BLOCK = 2048
#: Pairs that are compared at once inside such a block.
PAIRS = 1 << 18
#: Partners from which a class meets others of as many in blocks, and the most classes and about the shingles of a block.
MANY, BLOCK_SETS, BLOCK_SHINGLES = 64, 2048, 1 << 20
#: Bits of the bitmap for each id, and the most of it as a power of two.
SPARE, MOST_BITS = 16, 29
#: Partners of a class whose sets are met in one place.
PART = 4096
#: Best partners of a class in each other component, by round; the last round takes all.
PARTNERS = (4, 64, None)
_SLOT = 1 / (1 << BITS)
_WIDTH = HASHES * BITS // 64
_LOW_BITS = sum(1 << i for i in range(0, 64, BITS))

_random = np.random.default_rng(1)
_FLIP = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]
_TIMES = (_random.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1))[:, None]


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text, A-Z folded."""
    w = Words(column, fold=True)
    gram = w.hash
    for k in range(1, words):
        gram = gram[:-1] * np.uint64(0xD1342543DE82EF95) + w.hash[k:]
    gram, bounds, out = mix64(gram), w.row_words().tolist(), []
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a >= words:
            s = np.sort(gram[a : b - words + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for k in range(a, b):
                whole = mix64(whole * np.uint64(0xD1342543DE82EF95) + w.hash[k])
            out.append(whole)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    """The minimum of every hash function over a set that isn't empty."""
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(high), 4096):
        np.minimum(out, ((high[k : k + 4096] ^ _FLIP) * _TIMES).min(axis=1), out=out)
    return out


def packed(mins: np.ndarray) -> np.ndarray:
    """The low bits of all minima in 64-bit words, by document."""
    slots = (mins & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(mins), _WIDTH, 64 // BITS)
    return (slots << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)


def band_keys(mins: np.ndarray) -> np.ndarray:
    """A hash of each band's number and minima, by document."""
    rows = mins.reshape(len(mins), BANDS, BAND_ROWS).astype(np.uint64)
    key = np.broadcast_to(mix64(np.arange(1, BANDS + 1, dtype=np.uint64)), rows.shape[:2])
    for k in range(BAND_ROWS):
        key = mix64(key * np.uint64(0xD1342543DE82EF95) + rows[:, :, k])
    return key


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """Per document: doc_id, n_shingles, two hashes of its set, its signature and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            sets = shingle_sets(part.column("text"), words)
            mins = np.array([minima(s) if len(s) else np.zeros(HASHES, np.uint32) for s in sets])
            one = np.array([s.sum() for s in sets], np.uint64)
            two = np.array([mix64(s ^ np.uint64(_LOW_BITS)).sum() for s in sets], np.uint64)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel().view(np.int64)))
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "set_a": one.view(np.int64),
                "set_b": two.view(np.int64),
                "signature": lists(packed(mins)),
                "bands": lists(np.ascontiguousarray(band_keys(mins))),
            })

    schema = "doc_id long, n_shingles long, set_a long, set_b long, signature array<long>, bands array<long>"
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def estimate(a: Column, b: Column) -> Column:
    """Similarity by the bit count of unequal slots, corrected for slots that are equal by chance."""
    unequal = F.lit(0)
    for k in range(_WIDTH):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        for shift in (1 << i for i in range(BITS.bit_length() - 1)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        unequal = unequal + F.bit_count(x.bitwiseAND(F.lit(_LOW_BITS)))
    return (1 - unequal / HASHES - _SLOT) / (1 - _SLOT)


def likely(a: str, b: str, percent: int) -> Column:
    """Whether the sizes and signatures of two classes let them be similar."""
    small, large = F.least(f"{a}.n_shingles", f"{b}.n_shingles"), F.greatest(f"{a}.n_shingles", f"{b}.n_shingles")
    return (100 * small >= percent * large) & (estimate(F.col(f"{a}.signature"), F.col(f"{b}.signature")) >= ESTIMATE - 0.8 + percent / 100)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """:func:`estimate` for rows of signatures."""
    x = a ^ b
    for shift in (1 << i for i in range(BITS.bit_length() - 1)):
        x |= x >> np.uint64(shift)
    unequal = np.bitwise_count(x & np.uint64(_LOW_BITS)).sum(axis=1, dtype=np.int64)
    return (1 - unequal / HASHES - _SLOT) / (1 - _SLOT)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): node and component, its smallest node; nodes without edges are absent.

    Large-star and small-star rounds alternate until the edges are stars around the smallest nodes. Each takes the
    minimum over a node's neighbours by a partial aggregate and joins it back, so a hot node is no hot task.
    """

    def star(both: DataFrame, large: bool) -> DataFrame:
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        kept = both.join(least, "u").filter("v > u" if large else "v < u")
        out = kept.select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.unionByName(least.filter("m < u").select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    def turned(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = mark(edges)
    while before[0]:
        edges = checkpointed(star(turned(checkpointed(star(turned(edges), True))), False))
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as asked for.

    Sets stay where they are for the joins by document; the set of b is sent once, to that of a. A class a with many
    partners is met in parts of about PART of them.
    """
    of = lambda side: sets.select(F.col("doc_id").alias(side), F.col("shingles").alias(f"set_{side}"))
    pairs = pairs.select("a", "b")
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    salted = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    left = salted.join(of("b"), "b")
    right = parts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).join(of("a"), "a")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return left.join(right, ["a", "part"]).filter(100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)).select("a", "b")


def _confirmed_in_blocks(pairs: DataFrame, facts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """:func:`_confirmed` for pairs (a, b, la, lb) of which a class may have very many.

    If both have at least MANY, they meet in blocks. Classes near the same component are in the same blocks.
    """
    ends = bounded(pairs).select(F.explode(F.array("a", "b")).alias("doc_id"), F.least("la", "lb").alias("home"))
    busy = checkpointed(ends.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("home").alias("home")).filter(F.col("n") >= MANY).select("doc_id", "home"))
    if busy.isEmpty():
        return _confirmed(pairs, sets, percent)
    sized = busy.join(facts.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles")), "doc_id")
    blocks = sized.groupBy("home").agg(F.ceil(F.greatest(F.sum("n_shingles") / BLOCK_SHINGLES, F.count(F.lit(1)) / BLOCK_SETS)).alias("blocks"))
    block = F.xxhash64("home", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    at = checkpointed(sized.join(blocks, "home").select("doc_id", block.alias("block")))
    side = lambda x: at.select(F.col("doc_id").alias(x), F.col("block").alias(f"block_{x}"))
    told = checkpointed(pairs.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left"))
    dense = told.filter("block_a is not null and block_b is not null")
    dense = dense.select("a", "b", F.xxhash64(F.least("block_a", "block_b"), F.greatest("block_a", "block_b")).alias("cell"))
    needed = dense.select(F.col("cell").alias("place"), F.explode(F.array("a", "b")).alias("doc_id")).distinct()

    def meet(some: pa.Table, own: pa.Table) -> pa.Table:
        return _linked(some, own, percent)

    met = dense.groupBy("cell").cogroup(needed.join(sets, "doc_id").select("place", "doc_id", "shingles").groupBy("place")).applyInArrow(meet, "a long, b long")
    return met.unionByName(_confirmed(told.filter("block_a is null or block_b is null"), sets, percent))


def _linked(pairs: pa.Table, own: pa.Table, percent: int) -> pa.Table:
    """The pairs (a, b) of which some sets are as similar as asked for; own: doc_id, shingles."""
    docs, lists = own.column("doc_id").to_numpy(), own.column("shingles").combine_chunks()
    order = np.argsort(docs, kind="stable")
    docs, sizes = docs[order], lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)[order]
    lists = lists.take(pa.array(order))
    values, codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    ends = np.cumsum(sizes)
    each = [codes[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    a, b = pairs.column("a").to_numpy(), pairs.column("b").to_numpy()
    by = np.argsort(a, kind="stable")
    a, b = a[by], b[by]
    # Rows that share a doc_id are sets of their own.
    low, high = np.searchsorted(docs, b, "left"), np.searchsorted(docs, b, "right")
    seen, good = np.zeros(len(values), bool), np.zeros(len(a), bool)
    for start, end in zip(starts := np.flatnonzero(np.append(True, a[1:] != a[:-1])).tolist(), [*starts[1:], len(a)], strict=True):
        count = (high - low)[start:end]
        pair = np.repeat(np.arange(start, end), count)
        if not len(pair):
            continue
        other = low[pair] + np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
        for i in range(np.searchsorted(docs, a[start], "left"), np.searchsorted(docs, a[start], "right")):
            seen[each[i]] = True
            for k in range(0, len(other), 512):
                part = other[k : k + 512]
                hits = np.append(0, np.cumsum(seen[np.concatenate([each[j] for j in part.tolist()])], dtype=np.int64))
                at = np.append(0, np.cumsum(sizes[part]))
                both = hits[at[1:]] - hits[at[:-1]]
                good[pair[k : k + 512][100 * both >= percent * (sizes[i] + sizes[part] - both)]] = True
            seen[each[i]] = False
    return pa.table({"a": a[good], "b": b[good]})


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (whether it is that one).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets; ``percent`` is 80 or more.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100, for which the bands are laid out")
    docs = docs.select("doc_id", "text")
    # Null ids take no part, so they aren't dealt by id.
    nameless = signatures(docs.filter("doc_id is null"), words).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    docs = docs.filter("doc_id is not null")
    found = placed(signatures(docs, words), "doc_id")
    keyed = found.select("doc_id", "n_shingles", "set_a", "set_b")
    # Empty sets are in no class but their own.
    filled, empty = keyed.filter("n_shingles > 0"), keyed.filter("n_shingles = 0")
    classes = filled.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("class"))
    in_class = filled.join(classes, ["set_a", "set_b", "n_shingles"]).select("doc_id", "n_shingles", "class")
    member = checkpointed(in_class.unionByName(empty.select("doc_id", "n_shingles", F.col("doc_id").alias("class"))))
    reps = found.join(member.filter("doc_id = class and n_shingles > 0").select("doc_id").distinct(), "doc_id", "left_semi")
    rows = reps.select("doc_id", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = checkpointed(rows.join(buckets, "key").distinct())
    some = checkpointed(shared.select("doc_id").distinct())
    facts = checkpointed(reps.select("doc_id", "n_shingles", "signature", "bands").join(some, "doc_id", "left_semi"))
    sets = placed(_sets(docs, some, words), "doc_id")
    sweep(docs.sparkSession)

    pairs = shared.filter("least <> doc_id").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct()
    both = pairs.join(facts.alias("x"), F.col("a") == F.col("x.doc_id")).join(facts.alias("y"), F.col("b") == F.col("y.doc_id"))
    tested = checkpointed(both.filter(likely("x", "y", percent)).select("a", "b"))
    # Rows that share a doc_id but not a set are linked through it.
    shared_ids = member.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("z")).filter("a < z").select("doc_id", "a")
    links = _confirmed(tested, sets, percent).unionByName(member.join(shared_ids, "doc_id").select("a", F.col("class").alias("b")))
    found_components = checkpointed(components(links))

    for partners in PARTNERS:
        rest = checkpointed(_across(shared, facts, found_components, tested, partners, percent))
        if rest.isEmpty():
            break
        tested = checkpointed(tested.unionByName(rest.select("a", "b")))
        sweep(docs.sparkSession)
        stars = found_components.filter("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
        more = checkpointed(_confirmed_in_blocks(rest, facts, sets, percent))
        if not more.isEmpty():
            found_components = checkpointed(components(stars.unionByName(more)))

    named = member.join(found_components, member["class"] == found_components["node"], "left")
    every = named.select("doc_id", "n_shingles", F.coalesce("component", "class").alias("component_id")).unionByName(nameless)
    return every.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with the smallest doc_id of each group of near duplicates; of rows that share it, the first by text."""
    found = checkpointed(near_duplicates(docs, words, percent))
    gone = checkpointed(found.filter("not kept").select("doc_id").distinct())
    again = found.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    names = [quoted(c) for c in docs.columns]
    doubtful, clear = parted(docs, gone)
    left = doubtful.join(gone, "doc_id", "left_anti").select(*names).unionByName(clear)
    if again.isEmpty():
        return left
    repeated = left.join(again, "doc_id", "left_semi").select(F.struct(*names).alias("row"))
    nth = F.row_number().over(Window.partitionBy("row.doc_id").orderBy("row.text"))
    first = repeated.withColumn("nth", nth).filter("nth = 1").select("row.*")
    return left.join(again, "doc_id", "left_anti").select(*names).unionByName(first)


def parted(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` whose doc_id is in ``ids`` with a few others, and the rest, by a bitmap of hashed ids.

    It keeps texts out of the shuffles of exact joins that don't concern them. The bitmap has SPARE bits for each id, 64 MB
    at most, and is broadcast in pieces of 4 kB; with more ids than that, more of the others are in the first part.
    """
    bits = 1 << min(MOST_BITS, max(15, (SPARE * ids.count()).bit_length()))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    piece, place = F.bitmap_bucket_number(slot), F.bitmap_bit_position(slot)
    pieces = ids.select(piece.alias("__piece"), place.alias("__place")).groupBy("__piece").agg(F.bitmap_construct_agg("__place").alias("__bits"))
    byte = F.conv(F.hex(F.expr("substring(__bits, int(__place div 8) + 1, 1)")), 16, 10).cast("int")
    told = docs.withColumn("__piece", piece).withColumn("__place", place).join(F.broadcast(pieces), "__piece", "left")
    hit = F.coalesce(F.getbit(byte, (F.col("__place") % 8).cast("int")) == 1, F.lit(False))
    names = [quoted(c) for c in docs.columns]
    return told.filter(hit).select(*names), told.filter(~hit).select(*names)


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """The full sets of some documents, one for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            sets = shingle_sets(part.column("text"), words)
            ends = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate(sets).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "shingles": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))})

    own = parted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids)[0].join(ids, "doc_id", "left_semi")
    return bounded(own).mapInArrow(run, "doc_id long, shingles array<long>").filter("size(shingles) > 0")


def _across(shared: DataFrame, facts: DataFrame, found: DataFrame, tested: DataFrame, partners: int | None, percent: int) -> DataFrame:
    """Untested likely pairs of classes that share a bucket of three or more but no component."""
    labelled = shared.filter("size > 2").join(found, F.col("doc_id") == F.col("node"), "left").select("key", "size", "doc_id", F.coalesce("component", "doc_id").alias("label"))
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    # A set that isn't in the bucket is of another row with the same doc_id.
    rows = labelled.join(open_keys, "key", "left_semi").join(facts, "doc_id").filter(F.array_contains("bands", F.col("key")))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    # A block meets every block of its bucket once.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "doc_id", "label", "n_shingles", "signature", "bands")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in _grouped(batches, ["key", "low", "high"]):
            yield from _likely_pairs(bucket, percent)

    cells = bounded(rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high"))
    pairs = cells.mapInArrow(run, "a long, b long, la long, lb long, guess double").join(tested, ["a", "b"], "left_anti")
    if partners is None:
        # Rows that share a doc_id may find a pair more than once.
        return pairs.select("a", "b", "la", "lb").distinct()
    pairs = checkpointed(pairs)
    best = lambda me, other: F.row_number().over(Window.partitionBy(me, other).orderBy(F.desc("guess"), "a", "b")) <= partners
    # The best of two components is among the best of both; a single class would take all of the other one if one side were enough.
    return pairs.withColumn("first", best("a", "lb")).withColumn("second", best("b", "la")).filter("first and second").select("a", "b", "la", "lb").distinct()


def _grouped(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal keys, whole."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        starts = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1).tolist()]
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(int(c[start]) for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _likely_pairs(bucket: pa.Table, percent: int) -> Iterator[pa.RecordBatch]:
    """The likely pairs between components of one or two blocks of a bucket, if it is the first that they share."""
    get = lambda name: bucket.column(name).to_numpy()
    wide = lambda name, width: bucket.column(name).combine_chunks().flatten().to_numpy().reshape(-1, width)
    key, low, high = (bucket.column(c)[0].as_py() for c in ("key", "low", "high"))
    doc, label, size, block = get("doc_id"), get("label"), get("n_shingles"), get("block")
    if not (label != label[0]).any():
        return
    signature, bands = wide("signature", _WIDTH).view(np.uint64), wide("bands", BANDS)
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    step = max(1, PAIRS // max(1, len(right)))
    for k in range(0, len(left), step):
        some = left[k : k + step]
        unlike = label[some][:, None] != label[right]
        if low == high:
            unlike &= doc[some][:, None] < doc[right]
        i, j = np.nonzero(unlike)
        i, j = some[i], right[j]
        fit = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
        i, j = i[fit], j[fit]
        guess = estimates(signature[i], signature[j])
        near = guess >= ESTIMATE - 0.8 + percent / 100
        i, j, guess = i[near], j[near], guess[near]
        first = np.argmax(bands[i] == bands[j], axis=1)
        own = bands[i, first] == key
        i, j, guess = i[own], j[own], guess[own]
        i, j = np.where(doc[i] < doc[j], i, j), np.where(doc[i] < doc[j], j, i)
        yield pa.RecordBatch.from_pydict({"a": doc[i], "b": doc[j], "la": label[i], "lb": label[j], "guess": guess})
