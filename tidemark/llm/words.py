"""Words of whole texts as numpy arrays: places, rows and 64-bit hashes, without a Python object for each word."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from tidemark.llm.common import joined_bytes, mix64

_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Two primes below 2**31 with a base for each. Modulo a power of two, every base has texts that collide (Thue-Morse).
_FIELDS = ((2_147_483_647, 1_103_515_243), (2_147_483_629, 1_597_334_677))


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """For each field, powers of the base and of its inverse for 2**bits positions."""

    def powers(base: int, prime: int) -> np.ndarray:
        p = np.ones(1 << bits, np.uint64)
        for k in range(bits):
            p[1 << k : 2 << k] = p[: 1 << k] * np.uint64(pow(base, 1 << k, prime)) % np.uint64(prime)
        return p

    return tuple((powers(base, prime), powers(pow(base, -1, prime), prime)) for prime, base in _FIELDS)


class Words:
    """The words (runs of anything but blank and \\t\\n\\v\\f\\r) of a column of texts; null is an empty text.

    data: all UTF-8 bytes, a newline after each text; rows: where each text starts, and the end; start, end, row: of
    each word; hash: of each word. With ``fold``, A-Z count as a-z.
    """

    def __init__(self, column: pa.Array, fold: bool = False):
        self.data, self.rows = joined_bytes(column)
        data = _LOWER[self.data] if fold else self.data
        self._fields = []
        for (prime, _), (power, inverse) in zip(_FIELDS, _powers(max(19, len(data).bit_length())), strict=True):
            sums = np.zeros(len(data) + 1, np.uint64)
            codes = _CODES % np.uint64(prime)
            np.cumsum(codes[data] * power[: len(data)] % np.uint64(prime), out=sums[1:])
            self._fields.append((np.uint64(prime), sums, inverse))
        blank = _BLANK[data]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if len(data) and not blank[0]:
            edge = np.append(0, edge)
        self.start, self.end = edge[::2], edge[1::2]
        self.row = np.searchsorted(self.rows, self.start, "right") - 1
        self.hash = self.hashed(self.start, self.end)

    def hashed(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from ``start`` up to ``end``: a prefix sum gives each in constant time."""
        out = (end - start).astype(np.uint64)
        for prime, sums, inverse in self._fields:
            # Sums only grow, so differences aren't negative.
            out = mix64(out) + (sums[end] - sums[start]) % prime * inverse[start] % prime
        return mix64(out)

    def row_words(self) -> np.ndarray:
        """Bounds of each row's words: those of row i are from item i up to item i + 1."""
        return np.searchsorted(self.row, np.arange(len(self.rows)))
