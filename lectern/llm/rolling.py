"""Vectorised words and Rabin-Karp hashes over Arrow string columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The six characters that separate words: space and 0x09 to 0x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, factor in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the entropy of each 64-bit value over all its bits; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rabin-Karp hash of values[start:end] for each pair, from one running sum."""
    up, down = powers(max(len(values), int(start.max(initial=0)) + 1))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)))
    return mix((total[end] - total[start]) * down[start])


class Words:
    """The words of each text of a string column.

    data: the texts' bytes in a row; start, end: of each word therein; first: of each text, its first word;
    at: its first byte (both with one entry more than texts).
    """

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column, "").cast(pa.large_string())
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        self.data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.empty(0, np.uint8)
        self.at = at = at - at[0]
        n = len(self.data)
        inside = ~SPACES[self.data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[at[:-1][at[:-1] < n]] = False
        after[at[1:][at[1:] > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, at)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return spans(_CODE[self.data], self.start, self.end)

    def kept(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kept words of every text, joined by one space: bytes and the texts' offsets therein."""
        n = len(self.data)
        step = np.zeros(n + 1, np.int8)
        step[self.start[keep]] += 1
        step[self.end[keep]] -= 1
        taken = np.cumsum(step[:n], dtype=np.int8).astype(bool)
        chosen = np.flatnonzero(keep)
        owner = np.searchsorted(self.first, chosen, "right")
        gap = self.end[chosen[:-1][owner[1:] == owner[:-1]]]
        data = self.data.copy()
        data[gap] = 0x20
        taken[gap] = True
        return data[taken], np.concatenate(([0], np.cumsum(taken, dtype=np.int64)))[self.at]


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of ``width`` values that stay in one text, and the text of each."""
    count = np.maximum(np.diff(first) - width + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    begin = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    return begin + np.arange(len(text)), text


def leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """For each i, where values[i:i+width] has its smallest entry (by the upper 40 bits; the leftmost of equal ones)."""
    n = len(values) - width + 1
    low = np.uint64((1 << 24) - 1)
    packed = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        packed = np.minimum(packed[:-span], packed[span:])
        span *= 2
    packed = np.minimum(packed[:n], packed[width - span : width - span + n])
    return (packed & low).astype(np.int64)
