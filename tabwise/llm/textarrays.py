"""Vectorised text work inside Arrow tasks: words and word n-grams of whole texts as 64-bit hashes.

Texts are handled as UTF-8 bytes in slices of about ``SLICE_BYTES``, so memory
stays bounded by the slice (or by one longer text), not by the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for first, last in ranges:
        table[first:last + 1] = True
    return table


#: Words are runs of bytes other than space, tab, LF, VT, FF, CR.
WHITE_SPACE = separators((0x20, 0x20), (0x09, 0x0D))
#: Words are runs of digits, letters a-z and everything beyond ASCII.
NON_ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


class _Powers:
    up = down = np.ones(0, dtype=np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, SLICE_BYTES + 1)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up[:n], cls.down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that close values spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and int64 offsets (length n + 1); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each; a longer text is a range of its own."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


class Words(NamedTuple):
    hashes: np.ndarray   #: one 64-bit hash per word
    first: np.ndarray    #: index of each text's first word, and the total (length rows + 1)
    start: np.ndarray    #: byte offset of each word
    end: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = WHITE_SPACE) -> Words:
    """Hashes of the lower-cased words of each text."""
    data = LOWER[data]
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~separator[data]
    cut = np.zeros(n + 1, dtype=bool)      # a word never runs from one text into the next
    cut[offsets] = True
    begin = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    stop = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    up, down = _Powers.get(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    hashes = mix((total[stop] - total[begin]) * down[begin])
    return Words(hashes, np.searchsorted(begin, offsets), begin, stop)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word n-gram hashes in text order, and each text's first index (length rows + 1).

    A text with fewer words than ``size``, but not none, is one shingle.
    """
    factor = np.uint64(0xD6E8FEB86659FD93)
    counts = np.diff(w.first)
    out = np.zeros(len(w.hashes), dtype=np.uint64)
    reach = len(w.hashes) - size + 1
    if reach > 0:
        acc = w.hashes[:reach].copy()
        for k in range(1, size):
            acc = acc * factor + w.hashes[k:k + reach]
        out[:reach] = mix(acc)
    index = np.arange(len(w.hashes)) - np.repeat(w.first[:-1], counts)
    keep = index + size <= np.repeat(counts, counts)
    for row in np.flatnonzero((counts > 0) & (counts < size)):
        acc = 0
        for h in w.hashes[w.first[row]:w.first[row + 1]].tolist():
            acc = (acc * int(factor) + h) & 0xFFFFFFFFFFFFFFFF
        at = w.first[row]
        out[at] = mix(np.array([(acc + int(counts[row])) & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0]
        keep[at] = True
    return out[keep], np.concatenate([[0], np.cumsum(np.where(counts >= size, counts - size + 1, counts > 0))])


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text of the column."""
    data, offsets = text_bytes(column)
    for a, b in slices(offsets):
        part = offsets[a:b + 1]
        hashes, first = shingles(words(data[part[0]:part[-1]], part - part[0]), size)
        for row in range(b - a):
            yield a + row, np.unique(hashes[first[row]:first[row + 1]])
