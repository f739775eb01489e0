r"""Quality rules from repetition coverage: rolling hashes of several n-gram lengths over whole texts, in numpy.

A prefix sum of byte codes times powers of an odd base gives the hash of any run of bytes, so of every word and line;
n-gram hashes are rolled from word hashes, one length after the other. Hashes that occur twice or more in a text mark
the words under them as covered; coverage is measured in code points of words. A document is dropped if the characters
inside duplicated n-grams or duplicated lines exceed a share of its word characters that depends on the length.

Words are runs of anything but blank and \t\n\v\f\r. Hashes have 64 bits and are compared inside one text only.

Edge cases: a null or empty text has no words, fails the base rule and isn't kept; the last line needs no newline;
repeated rows are judged one by one; an empty table gives an empty table. Texts are handled whole, in chunks of rows
that hold about CHUNK_BYTES bytes; a longer text is a chunk by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import bounded, chunks, mix64
from tidemark.llm.words import Words

#: Most percent of a text's word characters inside duplicated n-grams, by n.
NGRAM_PERCENT = {5: 25, 6: 24, 7: 23, 8: 22, 9: 21, 10: 20}
#: Most percent of the lines, and of the word characters, in lines equal to an earlier one.
LINE_PERCENT, LINE_CHAR_PERCENT = 50, 30
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def _twice(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    ordered = np.sort(keys)
    repeated = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(repeated):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(repeated, keys), len(repeated) - 1)
    return repeated[at] == keys


def measures(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts of every text of the column."""
    words = Words(column)
    data, rows, start, end, row, word = words.data, words.rows, words.start, words.end, words.row, words.hash
    n = len(rows) - 1
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOLS[data], out=symbols[1:])

    def per_row(row: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(row, weight, n)[:n].astype(np.int64)

    chars = points[end] - points[start]
    salt = mix64(row.astype(np.uint64) + np.uint64(1))
    out = {"n_words": per_row(row), "word_chars": per_row(row, chars), "n_symbols": symbols[rows[1:]] - symbols[rows[:-1]]}

    gram = word.copy()
    for size in range(2, max(NGRAM_PERCENT) + 1):
        gram = gram[:-1] * np.uint64(0xD1342543DE82EF95) + word[size - 1 :]
        if size in NGRAM_PERCENT:
            inside = np.flatnonzero(row[: len(gram)] == row[size - 1 :])
            first = inside[_twice(mix64(gram[inside] ^ salt[inside]))]
            change = np.bincount(first, minlength=len(word) + 1) - np.bincount(first + size, minlength=len(word) + 1)
            covered = np.cumsum(change)[:-1] > 0
            out[f"dup_{size}gram_chars"] = per_row(row[covered], chars[covered])
            if size == 5:
                out["n_repeat_words"] = per_row(row[covered])

    end = np.flatnonzero(data == 10)
    start = np.append(0, end[:-1] + 1)[: len(end)]
    words_before = np.searchsorted(words.start, np.append(start, len(data)))
    full = words_before[1:] > words_before[:-1]
    upto = np.append(0, np.cumsum(chars))
    line_chars = (upto[words_before[1:]] - upto[words_before[:-1]])[full]
    start, end = start[full], end[full]
    line_row = np.searchsorted(rows, start, "right") - 1
    key = mix64(words.hashed(start, end) ^ mix64(line_row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    again = order[1:][key[order][1:] == key[order][:-1]]
    out["n_lines"] = per_row(line_row)
    out["n_dup_lines"] = per_row(line_row[again])
    out["dup_line_chars"] = per_row(line_row[again], line_chars[again])
    return out


def judged(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The base rule's verdict and the final one."""
    failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    bad = (100 * m["n_dup_lines"] > LINE_PERCENT * m["n_lines"]) | (100 * m["dup_line_chars"] > LINE_CHAR_PERCENT * m["word_chars"])
    for size, percent in NGRAM_PERCENT.items():
        bad |= 100 * m[f"dup_{size}gram_chars"] > percent * m["word_chars"]
    return {"base_failed": failed, "kept": ~failed & ~bad}


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "dup_line_chars", *(f"dup_{n}gram_chars" for n in NGRAM_PERCENT)]


def repetition_rules(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the counts, base_failed and kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            m = measures(part.column("text"))
            verdict = judged(m)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id")} | {k: pa.array(m[k], pa.int64()) for k in _COUNTS} | {k: pa.array(v) for k, v in verdict.items()})

    schema = ", ".join(["doc_id long", *(f"{k} long" for k in _COUNTS), "base_failed boolean", "kept boolean"])
    return bounded(docs).select("doc_id", "text").mapInArrow(run, schema)
