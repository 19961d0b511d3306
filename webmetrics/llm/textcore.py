"""Texts of an Arrow batch as byte arrays, and their words as 64-bit hashes, a whole slice at a time.

Runs inside Spark tasks only. Hashes depend on the word alone, not on the batch, so they can be joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 21

_U = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240217).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = [np.ones(1, _U), np.ones(1, _U)]

#: Lower case of A-Z by byte, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes that end a word: white space of ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of letters and digits; every byte of a character beyond ASCII counts.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bits of each value spread over all 64 (a fixed bijection)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, _U)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=_U)
    return _powers[0], _powers[1]


@dataclass
class Texts:
    """Rows `first` to `first + len(offsets) - 1` of a batch: their bytes, and where each begins."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Texts]:
    """The rows of a string column in slices of about `most` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, starts, values = column.buffers()
    offsets = np.frombuffer(starts, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield Texts(row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


@dataclass
class Words:
    """Words of a slice in order: byte ranges, hashes, and the first word of each row (one more at the end)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    prefix: np.ndarray

    def prefix_hash(self, index: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the first `size` bytes of words `index`, which are that long at least."""
        at = self.start[index]
        inverse = _powers[1]
        return mix((self.prefix[at + size] - self.prefix[at]) * inverse[at] + _U(size))


def words(texts: Texts, kind: np.ndarray = NOT_SPACE, lower: bool = True) -> Words:
    """Maximal runs of the bytes that `kind` marks."""
    data = LOWER[texts.data] if lower else texts.data
    inside = kind[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = texts.offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begin[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(begin)
    end = np.flatnonzero(last) + 1
    power, inverse = _power_tables(len(data) + 1)
    prefix = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE_VALUES[data] * power[: len(data)], out=prefix[1:])
    value = (prefix[end] - prefix[start]) * inverse[start]
    return Words(start, end, mix(value + (end - start).astype(_U)), np.searchsorted(start, texts.offsets), prefix)


def runs_of(values: Words, size: int, weights: list[int] | None = None) -> np.ndarray:
    """Hash of `size` words from each word on (in order, those of weight None or 0 left out); rows are not minded."""
    n = max(0, len(values.hash) - size + 1)
    total = np.zeros(n, _U)
    for k in range(size):
        if weights is None or weights[k]:
            total *= _U(_BASE)
            total += values.hash[k : k + n]
    return mix(total + _U(size))
