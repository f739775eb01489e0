"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Every piece that the split pattern matches is encoded by itself. A segment tree over its byte positions holds the rank
of the pair that starts at each live position, and in each node the least rank below it; going down from the root to
the left on ties finds the leftmost pair of least rank. A merge changes the leaves of the merged position and of its
live neighbours only, so it costs a logarithmic number of node updates, and a piece of n bytes O(n log n).

Pieces of like length are encoded together, one tree per row of a numpy matrix (:func:`_encode_rows`); few long pieces
take the same tree as a plain list (:func:`_encode_long`). Pieces that were met before come from a bounded memo.

Edge cases: a null or empty text has no ids and decodes to no bytes; a repeated row is encoded again; an empty table
gives an empty table; ids outside the vocabulary raise ValueError in :meth:`ByteBPE.decode`.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import bounded, chunks, mapped

_NONE = np.int32(0x7FFFFFFF)
#: Pieces in the memo, and the bytes up to which a piece is kept there.
MEMO_PIECES, MEMO_BYTES = 120_000, 64
#: Texts that are encoded together, in bytes.
_CHUNK = 1 << 20
#: Groups of fewer pieces of one padded length are encoded one by one.
_FEW = 6
#: For texts of these characters alone, the standard library's faster matcher splits as the pattern does.
_PLAIN = re.compile("[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ſ]")
_SPLIT_GPT2 = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPLIT_PLAIN = re.compile(r"""'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")


class ByteBPE:
    """A vocabulary of byte strings by rank, with the pattern that splits texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.plain = _SPLIT_PLAIN if pattern == _SPLIT_GPT2 else None
        self.tokens = {i: t for t, i in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {
            (left << 32) | right: rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None
        }
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()] + [_NONE], np.int32)
        self.keys = np.append(self.keys, np.iinfo(np.int64).max)
        self.byte_pairs = self._rank(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))
        self.memo: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBPE:
        """From a rank file: one base64 token and its rank a line."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}, pattern)

    def split(self, text: str) -> list[str]:
        """The pieces of a text, in order."""
        if self.plain is not None and not _PLAIN.search(text):
            return self.plain.findall(text)
        return self.pattern.findall(text)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], _NONE)

    def _encode_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of the pieces, of at most ``width`` bytes (a power of two), as little-endian unsigned 32-bit integers."""
        n, levels = len(pieces), width.bit_length() - 1
        data = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(n, width)
        size = np.array([len(p) for p in pieces], np.int32)
        live = np.arange(width, dtype=np.int32) < size[:, None]
        tree = np.full((n, 2 * width), _NONE, np.int32)
        tree[:, width:-1] = np.where(live[:, 1:], self.byte_pairs[data[:, :-1].astype(np.int32) << 8 | data[:, 1:]], _NONE)
        for k in range(levels, 0, -1):
            low = tree[:, 1 << k : 2 << k]
            tree[:, 1 << (k - 1) : 1 << k] = np.minimum(low[:, ::2], low[:, 1::2])
        # Flat views: position p of row r is at r * width + p, node q at 2 * r * width + q.
        ids, live, tree = self.byte_ids[data].ravel(), live.ravel(), tree.ravel()
        after = np.tile(np.arange(1, width + 1, dtype=np.int32), n)
        before = after - 2
        root = np.flatnonzero(tree[1 :: 2 * width] < _NONE) * (2 * width)
        while len(root):
            row, rank, node = root >> 1, tree[root + 1], np.ones(len(root), np.int64)
            for _ in range(levels):
                node <<= 1
                child = root + node
                node += tree[child] > tree[child + 1]
            at = row + node - width
            gone = row + after[at]
            then = after[gone]
            ids[at], live[gone], after[at] = rank, False, then
            inner = np.flatnonzero(then < size[row // width])
            next_at = row[inner] + then[inner]
            before[next_at] = (node - width)[inner]
            fresh = np.full(len(root), _NONE)
            fresh[inner] = self._rank(rank[inner], ids[next_at])
            prior = before[at]
            led = np.flatnonzero(prior >= 0)
            prior_at = row[led] + prior[led]
            for base, p, value in ((root, gone - row, _NONE), (root, node - width, fresh), (root[led], prior[led].astype(np.int64), self._rank(ids[prior_at], rank[led]))):
                p = p + width
                tree[base + p] = value
                for _ in range(levels):
                    p >>= 1
                    child = base + 2 * p
                    tree[base + p] = np.minimum(tree[child], tree[child + 1])
            root = root[tree[root + 1] < _NONE]
        ids, live = ids.reshape(n, width), live.reshape(n, width)
        flat, ends = ids[live].astype("<u4").tobytes(), np.cumsum(live.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]

    def _encode_long(self, piece: bytes) -> bytes:
        """As :meth:`_encode_rows`, for one piece."""
        n, none, pairs = len(piece), int(_NONE), self.pairs
        width = 1 << max(1, (n - 1).bit_length())
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        tree[width : width + n - 1] = [pairs.get((a << 32) | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(at: int, value: int) -> None:
            node = at + width
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if a <= b else b

        while (rank := tree[1]) < none:
            node = 1
            while node < width:
                node = 2 * node + (tree[2 * node] > tree[2 * node + 1])
            at = node - width
            gone = after[at]
            then = after[gone]
            ids[at], after[at], ids[gone] = rank, then, -1
            put(gone, none)
            put(at, pairs.get((rank << 32) | ids[then], none) if then < n else none)
            if then < n:
                before[then] = at
            if (prior := before[at]) >= 0:
                put(prior, pairs.get((ids[prior] << 32) | rank, none))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece; a piece that is a token itself has that token's id alone."""
        out: list[bytes] = [b""] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif piece:
                groups.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, group in groups.items():
            if len(group) < _FEW or width > 256:
                for i in group:
                    out[i] = self._encode_long(pieces[i])
                continue
            step = max(_FEW, (1 << 19) // width)
            for k in range(0, len(group), step):
                part = group[k : k + step]
                for i, x in zip(part, self._encode_rows([pieces[i] for i in part], width), strict=True):
                    out[i] = x
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split, memo = [self.split(t) for t in texts], self.memo
        new = list(set().union(*split).difference(memo)) if split else []
        fresh = dict(zip(new, self.encode_pieces([p.encode() for p in new]), strict=True))
        memo.update(fresh)
        out = [b"".join([memo[p] for p in pieces]) for pieces in split]
        if len(memo) > MEMO_PIECES:
            memo.clear()
        else:
            for p in new:
                if len(p) > MEMO_BYTES:
                    del memo[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids given as little-endian unsigned 32-bit integers."""
        try:
            return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        except KeyError as e:
            raise ValueError(f"no token has the id {e}") from None


@lru_cache(maxsize=2)
def loaded(path: str, pattern: str) -> ByteBPE:
    """One vocabulary a worker process."""
    return ByteBPE.load(path, pattern)


def _encoded(batches: Iterator[pa.RecordBatch], text: str, path: str, pattern: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    bpe = loaded(path, pattern)
    for part in chunks(batches, text, _CHUNK):
        yield part, bpe.encode([t or "" for t in part.column(text).to_pylist()])


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """All columns of ``docs`` with ``out``, the ids of ``text`` as array<int> (a column of that name is replaced)."""
    kept = docs.drop(out)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids in _encoded(batches, text, path, pattern):
            ends = np.cumsum([0, *map(len, ids)]) // 4
            flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
            arrays = [*part.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names, out])

    return mapped(kept, run, schema)


def decode_documents(docs: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "text") -> DataFrame:
    """All columns of ``docs`` but ``ids``, with ``out`` holding the decoded bytes (binary); null ids decode to no bytes."""
    kept = [f for f in docs.schema.fields if f.name not in (ids, out)]
    schema = T.StructType([*kept, T.StructField(out, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            texts = [bpe.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(texts, pa.binary())], names=[*(f.name for f in kept), out])

    return mapped(docs, run, schema)


def encode_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and the SHA-256 of its ids and of the bytes they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for part, ids in _encoded(batches, "text", path, pattern):
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"),
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids],
            })

    return bounded(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
