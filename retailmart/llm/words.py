"""Words and word n-grams of whole texts, hashed for many texts at once inside a task.

A word is a run of bytes other than space and tab to carriage return, or of the bytes that a
caller names (``ALNUM``). Words and n-grams are
known by 64-bit hashes that don't depend on process or machine; two different n-grams of one
comparison share a hash with a probability of about 2^-64 for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

SOLID = np.ones(256, bool)  # bytes of a word: all but white space
SOLID[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.ones(256, bool)  # bytes of a term: digits, letters, and whatever is not ASCII
ALNUM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]


class _Powers:
    """Powers of an odd number modulo 2^64, and of its inverse, as far as needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(_MULTIPLIER, -1, 1 << 64)
            steps = np.full(n, _MULTIPLIER, np.uint64), np.full(n, inverse, np.uint64)
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.cumprod(s, dtype=np.uint64) for s in steps)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


@dataclass
class Words:
    """Words of rows ``first`` to ``first + rows - 1``; word i is data[start[i]:end[i]] of row ``row[i]``."""

    first: int
    rows: int
    data: np.ndarray
    cuts: np.ndarray  # where each row's text begins in data, and the end
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray

    def bounds(self) -> np.ndarray:
        """Row r has the words bounds[r] to bounds[r + 1] - 1."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))


def text_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null has no bytes."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    _, offsets, data = array.buffers()
    n = len(array)
    cuts = np.frombuffer(offsets, np.int64, n + 1 + array.offset)[array.offset :] if n else np.zeros(1, np.int64)
    return cuts, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def words_of(array: pa.Array, lower: bool = False, solid_bytes: np.ndarray = SOLID) -> Iterator[Words]:
    """Whole texts in row order, about CHUNK_BYTES at a time (a longer text by itself)."""
    cuts, data = text_buffers(array)
    table = _BYTE_LOWER if lower else _BYTE
    first = 0
    while first < len(array):
        after = int(np.searchsorted(cuts, cuts[first] + CHUNK_BYTES, "right")) - 1
        after = min(max(after, first + 1), len(array))
        piece, own = data[cuts[first] : cuts[after]], cuts[first : after + 1] - cuts[first]
        n = len(piece)
        solid = solid_bytes[piece]
        fresh = np.zeros(n + 1, bool)  # a text begins here, or the data end
        fresh[own] = True
        start = np.flatnonzero(solid & (fresh[:-1] | ~np.concatenate(([False], solid[:-1]))))
        end = np.flatnonzero(solid & (fresh[1:] | ~np.concatenate((solid[1:], [False])))) + 1
        up, down = _POWERS.reach(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[piece] * up[:n], out=sums[1:])
        value = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
        row = np.searchsorted(own, start, "right") - 1
        yield Words(first, after - first, piece, own, start, end, row, value)
        first = after


def windows(value: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n neighbours, in order; empty if there are fewer."""
    if len(value) < n:
        return np.zeros(0, np.uint64)
    out = value[: len(value) - n + 1] + np.uint64(n)
    for k in range(1, n):
        out = mix(out * np.uint64(_MULTIPLIER) + value[k : len(value) - n + 1 + k])
    return out


def shingle_sets(array: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct n-gram hashes of its A-Z-lowered text, as uint64.

    A text of fewer words is one n-gram as a whole; one without words has none.
    """
    for chunk in words_of(array, lower=True):
        grams = windows(chunk.hash, n)
        bounds = chunk.bounds()
        for r in range(chunk.rows):
            a, b = bounds[r], bounds[r + 1]
            if b - a >= n:
                own = grams[a : b - n + 1].copy()
                own.sort()
                keep = np.ones(len(own), bool)
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                yield own[keep]
            elif b > a:
                yield windows(chunk.hash[a:b], int(b - a))
            else:
                yield np.zeros(0, np.uint64)
