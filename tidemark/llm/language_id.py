"""Language identification with hyperdimensional profiles.

Each of 48 letter slots has a random vector of +1 and -1. A letter trigram is bound as the product of its letters'
vectors, permuted by their place (rolled by two, one and no places); a text's vector is the bundle (sum) of its
trigrams' vectors. A language's prototype is the bundle of all its training texts, over the whole table: every Spark
partition bundles its own rows, these sums are added up by language and dimension, and the totals come to the driver:
DIMENSIONS values for each language, whatever the rows. A text gets the language whose prototype has the highest cosine with its
vector.

Letters are folded to lower case; a-z have slots of their own, other letters share 21 slots by code point, and every
run of anything else is one boundary, as are both ends of a text.

Edge cases: a null text or one without a letter is ``und`` with score 0, as is every text if nothing was learned; null
languages aren't learned; equal cosines go to the language first in order; repeated rows count again in training; an
empty table gives an empty table; long texts are read whole. A label that isn't a language, such as an id, would learn
without bound, so more than MAX_LANGUAGES learned languages raise ValueError; memory is bounded until then.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded, chunks, mapped

DIMENSIONS, SLOTS, SEED = 1024, 48, 20
MAX_LANGUAGES = 2000
UNKNOWN = "und"
#: Trigram vectors that are bundled at once; languages of which a worker holds counts, 0.9 MB each.
_BLOCK, _OPEN = 512, 64


@lru_cache(maxsize=1)
def _slots() -> np.ndarray:
    """The slot of every code point; 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        letter = chr(point)
        if letter.isalpha():
            low = ord(letter.lower()[0])
            out[point] = low - 96 if 97 <= low <= 122 else 27 + zlib.crc32(low.to_bytes(4, "little")) % (SLOTS - 27)
    return out


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, ...]:
    """The vector of every slot as the first, second and third letter of a trigram."""
    letters = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (SLOTS, DIMENSIONS))
    return np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters


def bound(grams: np.ndarray) -> np.ndarray:
    """The bound vectors of trigrams."""
    first, second, third = _letters()
    out = first[grams // (SLOTS * SLOTS)]
    out *= second[grams // SLOTS % SLOTS]
    out *= third[grams % SLOTS]
    return out


def profile(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """The distinct trigrams of a text and their counts, None if it has no letter."""
    codes = _slots()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    letter = codes > 0
    if not letter.any():
        return None
    codes = codes[letter | np.append(True, letter[:-1])]
    padded = np.zeros(len(codes) + 2, np.int32)
    padded[1:-1] = codes
    if not padded[1]:
        padded = padded[1:]
    if not padded[-2]:
        padded = padded[:-1]
    grams = np.sort(padded[:-2] * (SLOTS * SLOTS) + padded[1:-1] * SLOTS + padded[2:])
    first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
    return grams[first], np.diff(np.append(first, len(grams)))


def bundle(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of the trigrams' vectors, each times its count."""
    out = np.zeros(DIMENSIONS, np.float64)
    for k in range(0, len(grams), _BLOCK):
        # einsum stays on one thread, where a BLAS product of this size would start one for each core.
        out += np.einsum("i,ij->j", counts[k : k + _BLOCK].astype(np.float32), bound(grams[k : k + _BLOCK]).astype(np.float32))
    return out


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes of the languages of all rows whose language isn't null."""

    def bundled(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, c in counts.items():
            grams = np.flatnonzero(c)
            # Integers, so the order of addition doesn't matter.
            sums = np.zeros(DIMENSIONS, np.int64)
            for k in range(0, len(grams), _BLOCK):
                sums += c[grams[k : k + _BLOCK]] @ bound(grams[k : k + _BLOCK]).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"lang": [name] * DIMENSIONS, "dimension": pa.array(range(DIMENSIONS), pa.int32()), "value": sums})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for part in chunks(batches, "text"):
            for t, name in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                if (p := profile(t)) is not None:
                    if name not in counts:
                        counts[name] = np.zeros(SLOTS**3, np.int64)
                    counts[name][p[0]] += p[1]
                    if len(counts) > _OPEN:
                        yield from bundled(counts)
                        counts.clear()
        yield from bundled(counts)

    labelled = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang is not null and text is not null")
    sums = bounded(labelled).mapInArrow(run, "lang string, dimension int, value long").groupBy("lang", "dimension").agg(F.sum("value").alias("value"))
    found: dict[str, np.ndarray] = {}
    for name, dimension, value in sums.limit((MAX_LANGUAGES + 1) * DIMENSIONS).collect():
        found.setdefault(name, np.zeros(DIMENSIONS))[dimension] = value
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return found


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs`` with the predicted language and its cosine, at least 0 (columns of those names are replaced)."""
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] for n in names]).reshape(len(names), DIMENSIONS)
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)
    kept = docs.drop(pred, score)

    def judge(t: str | None) -> tuple[str, float]:
        p = profile(t)
        if p is None or not names:
            return UNKNOWN, 0.0
        vector = bundle(*p)
        cosines = matrix @ vector / max(np.linalg.norm(vector), 1e-300)
        best = int(np.argmax(cosines))
        return names[best], min(1.0, max(0.0, float(cosines[best])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text):
            found = [judge(t) for t in part.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], names=[*part.schema.names, pred, score])

    return mapped(kept, run, T.StructType([*kept.schema.fields, T.StructField(pred, T.StringType(), False), T.StructField(score, T.DoubleType(), False)]))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is a multiple of 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def identify(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; learned from the rows that aren't held out."""
    docs = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    prototypes = learn(docs.filter("not held_out"))
    return predict(docs.select("doc_id", "held_out", "text"), prototypes).drop("text")
