"""Numpy views of text columns, used inside mapInArrow tasks.

A column of strings arrives from Spark as one Arrow buffer. ``pieces`` cuts it
between documents into slices of a quarter megabyte (a longer document is a slice
of its own, never cut), so the arrays below stay small whatever the batch size.
Nulls read as empty texts.

Fingerprints are polynomial hashes modulo 2**64 over a table of mixed byte
values: with prefix sums the hash of any span costs two lookups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 1 << 18
_M = 0x9E3779B97F4A7C15          # odd multiplier of the polynomial
_M_INV = pow(_M, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (xor-shift-multiply)."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


BYTE_VALUE = mix((np.arange(256, dtype=U) + U(1)) * U(_M)) | U(1)

_pow: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown by doubling and kept."""
    have = _pow.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, dtype=U) if have is None else have
        while len(have) < n:
            step = U(pow(base, len(have), 1 << 64))
            have = np.concatenate([have, have * step])
        _pow[base] = have
    return have[:n]


class Spans:
    """Hashes of spans of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, dtype=U)
        np.cumsum(values * _powers(_M, n), out=self.sums[1:])
        self.back = _powers(_M_INV, n + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start]
                   + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def pieces(column: pa.Array, max_bytes: int = SLICE_BYTES
           ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for slices of whole texts; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    off = np.frombuffer(off, dtype=np.int64 if wide else np.int32)
    off = off[column.offset:column.offset + n + 1].astype(np.int64)
    data = (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size
            else np.zeros(0, dtype=np.uint8))
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def word_spans(data: np.ndarray, off: np.ndarray,
               is_word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets): byte spans of the words of each text.

    A word is a maximal run of bytes outside 0x20 and 0x09-0x0D (``is_word`` is
    another 256-entry byte class). Words of text i are word_offsets[i]:word_offsets[i+1].
    """
    if is_word is None:
        is_word = WORD_BYTE
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = is_word[data]
    begin = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begin[cut] |= inside[cut + 1]
    end[cut - 1] |= inside[cut]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


WORD_BYTE = np.ones(256, dtype=bool)
WORD_BYTE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

LOWER_BYTE = np.arange(256, dtype=np.uint8)
LOWER_BYTE[ord("A"):ord("Z") + 1] += 32


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Spans(BYTE_VALUE[data]).hash(starts, ends)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value (by its upper 32 bits) of each window."""
    n = len(values)
    if n < width:
        return np.zeros(0, dtype=np.int64)
    m = (values & U(0xFFFFFFFF00000000)) | np.arange(n, dtype=U)
    span = 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[:n - width + 1], m[width - span:])
    return (m & U(0xFFFFFFFF)).astype(np.int64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated starts[i] .. starts[i]+lengths[i]-1."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return np.arange(total, dtype=np.int64) + shift
