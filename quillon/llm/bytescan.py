"""Vectorised scanning of Arrow string columns, shared by the free-style operators.

Texts are looked at as one flat UTF-8 buffer with row offsets, so that word splitting and
hashing cost a few NumPy passes per byte and no Python object per word.  Work goes in blocks
of about a megabyte of text (or one text, where that is longer), which bounds memory.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, U64), np.ones(1, U64)]

#: Byte classes: letters and digits after lower-casing A-Z, and everything beyond ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x41:0x5B] = WORD_BYTES[0x61:0x7B] = True
WORD_BYTES[0x80:] = True
#: Everything but the ASCII white space.
SOLID_BYTES = np.ones(256, bool)
SOLID_BYTES[0x20] = False
SOLID_BYTES[0x09:0x0E] = False
#: Bytes whose words are hashed at once: prefix hashes and powers take over 40 bytes for each.
STRIDE = 1 << 18
#: Lower-cases A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column, limit: int = 1 << 20, rows: int = 4096) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) with at most ``limit`` bytes unless one text has more."""
    data, offsets = flat(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n, first + rows)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
    give_back()


def give_back() -> None:
    """Freed memory goes back to the system: workers live on and share an executor's memory with the JVM, as the driver's Python does."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base modulo 2**64, and of its inverse."""
    if len(_powers[0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        for i, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, base, U64)
            x[0] = 1
            _powers[i] = np.cumprod(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running polynomial hash: the hash of [s, e) is ``(c[e] - c[s]) * inverse_power[s]``."""
    p, _ = powers(len(values) + 1)
    c = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * p[:-1], out=c[1:])
    return c


def range_hash(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, q = powers(len(c))
    return mix((c[ends] - c[starts]) * q[starts] + (ends - starts).astype(U64))


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the maximal runs of bytes of a class; runs end with their row."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = table[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    heads = offsets[:-1]
    before[heads[heads < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    tails = offsets[1:]
    after[tails[tails > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offsets, starts, side="right") - 1
    return row, starts, ends


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, stops: list[np.ndarray]) -> list[np.ndarray]:
    """For each of ``stops`` the hashes from every word's start up to there, at most its end, after lower-casing A-Z."""
    out, first = [np.empty(len(starts), U64) for _ in stops], 0
    while first < len(starts):  # a hash doesn't depend on its place, so a stretch of STRIDE bytes (or one word) is hashed at a time
        base = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, base + STRIDE, side="right")))
        part = slice(first, last)
        c = prefix_hash(LOWER[data[base : ends[last - 1]]])
        for h, stop in zip(out, stops, strict=True):
            h[part] = range_hash(c, starts[part] - base, stop[part] - base)
        first = last
    return out


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, 64-bit hash) of every word after lower-casing A-Z."""
    row, starts, ends = spans(data, offsets, table)
    return row, starts, ends, hashes(data, starts, ends, [ends])[0]


def first_of(row: np.ndarray, rows: int) -> np.ndarray:
    """Where each row's words begin, with a closing bound (rows must be sorted)."""
    return np.searchsorted(row, np.arange(rows + 1))


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
