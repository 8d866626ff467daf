"""Numpy views of Arrow text columns, used inside tasks.

A batch is cut into slices of bounded size, so what a task holds does not grow
with the batch; a text longer than the bound forms a slice of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are expanded into arrays at once.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P, _P_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def filled(column: pa.Array) -> pa.Array:
    """A plain string array in which null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "") if column.null_count else column


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string or binary array, without a copy of the bytes."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges ``(a, b)`` whose texts come to ``limit`` bytes at most, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


def word_hashes(data: np.ndarray, offsets: np.ndarray, stem: int = 0) -> tuple[np.ndarray, ...]:
    """Document number and 64-bit hash of each ASCII-lower-cased word, in order.

    The hash is a polynomial over the word's bytes, taken from running sums, then
    mixed; it depends on nothing but the word. With ``stem``, the hash of each
    word's first ``stem`` bytes is a third result.

    Some fifty bytes are held for each byte of text, so what is longer than
    ``SLICE_BYTES`` is cut at white space; a single word is expanded whole.
    """
    n, at, parts = len(data), 0, []
    while n - at > SLICE_BYTES:
        gap = np.flatnonzero(_SPACE[data[at : at + SLICE_BYTES]])
        if len(gap):
            cut = at + int(gap[-1]) + 1
        else:
            cut = at + SLICE_BYTES
            while cut < n and not _SPACE[data[cut]]:
                cut += 1
        parts.append(_hashes(data, offsets, at, cut, stem))
        at = cut
    parts.append(_hashes(data, offsets, at, n, stem))
    return tuple(map(np.concatenate, zip(*parts, strict=True))) if len(parts) > 1 else parts[0]


def _hashes(data: np.ndarray, offsets: np.ndarray, at: int, to: int, stem: int) -> tuple[np.ndarray, ...]:
    """``word_hashes`` of the bytes from ``at`` to ``to``, which do not cut a word."""
    data, n = data[at:to], to - at
    if not n:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64)) + (np.zeros(0, np.uint64),) * (stem > 0)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to, "right")] - at] = True
    start = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    powers = np.full(n, _P, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data] + np.uint64(1)) * powers, out=sums[1:])
    inverse = np.full(n, _P_INV, np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)

    def mixed(stop):
        h = (sums[stop] - sums[start]) * inverse[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))

    doc = np.searchsorted(offsets, start + at, "right") - 1
    return (doc, mixed(end)) + ((mixed(np.minimum(end, start + stem)),) if stem else ())
