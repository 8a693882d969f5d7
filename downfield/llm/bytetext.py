"""Vectorised text kernels over Arrow batches: words, lines and rolling hashes straight from the UTF-8 buffer.

Every kernel takes a *piece*, some whole rows of a batch with a bounded number of bytes, so that the
temporary arrays stay small whatever the batch or the length of its texts (one long text is a piece alone).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_P = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_PINV = pow(_P, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, PIECE_BYTES + 64), base, _U)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        if len(got) <= 2 * PIECE_BYTES:
            _POWERS[base] = got
    return got[:n]


def powers(n: int, inverse: bool = False) -> np.ndarray:
    return _powers(_PINV if inverse else _P, n)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_string(column.type)):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offs else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of ``batch`` of about ``most`` bytes of ``column``, with their bytes and offsets."""
    raw, at = strings(batch.column(batch.schema.get_field_index(column)))
    begin, n = 0, batch.num_rows
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, side="right")) - 1)
        yield batch.slice(begin, end - begin), raw[at[begin] : at[end]], at[begin : end + 1] - at[begin]
        begin = end


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """H with H[e] - H[s] the hash of raw[s:e] times P**s."""
    out = np.zeros(len(raw) + 1, _U)
    np.cumsum(_BYTE[raw] * _powers(_P, len(raw)), out=out[1:])
    return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans."""
    return mix((h[end] - h[start]) * _powers(_PINV, len(h))[start] + (end - start).astype(_U))


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of ``inside`` bytes that stays within a row."""
    if not len(inside):
        z = np.zeros(0, np.int64)
        return z, z, z
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = at[:-1][(at[:-1] < at[1:])]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = at[1:][(at[:-1] < at[1:])] - 1
    last[edge] = inside[edge]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(at, start, side="right") - 1


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D]
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


class Words:
    """The words of a piece: start, end (bytes), row, hash; first[r]:first[r + 1] are row r's words."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, kind: np.ndarray, lower: bool):
        self.raw, self.at = (LOWER[raw] if lower else raw), at
        self.start, self.end, self.row = runs(kind[self.raw], at)
        self.h = prefix_hash(self.raw)
        self.hash = span_hash(self.h, self.start, self.end)
        self.first = np.searchsorted(self.row, np.arange(len(at)))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive hashes (len - n + 1 of them; those that cross a row are the caller's to drop)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, _U)
    out = np.zeros(count, _U)
    for j in range(n):
        out *= _U(0xD6E8FEB86659FD93)
        out += hashes[j : j + count]
    return mix(out)
