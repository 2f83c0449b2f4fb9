"""Whole columns of texts as byte arrays: slicing, tokens and their hashes, in numpy.

Tokens are maximal runs of bytes of one kind, so UTF-8 letters outside ASCII (bytes from 0x80) stay together. Hashes have
64 bits. Everything works on the bytes of many texts at once; temporaries are bounded by ``WINDOW``, not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WINDOW = 1 << 20
MULTIPLIER, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets. A null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = column.cast(pa.large_string())
    _, offsets, data = wide.buffers()
    if not len(wide):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def ranges(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes in all, or of a single longer row."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high
        low = high


def whitespace_kinds() -> np.ndarray:
    """Tokens are runs of anything but ASCII white space."""
    kinds = np.ones(256, np.uint8)
    kinds[list(b" \t\n\r\f\v")] = 0
    return kinds


def run_kinds() -> np.ndarray:
    """Tokens are runs of letters and digits, or runs of other signs."""
    kinds = np.full(256, 2, np.uint8)
    kinds[list(b" \t\n\r\f\v")] = 0
    kinds[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
    kinds[0x80:] = 1
    return kinds


def lower_table() -> np.ndarray:
    """Lower case for A-Z, other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Tokens:
    """Splits and hashes tokens. ``kinds`` gives the kind of each byte, 0 for separators; one object per task."""

    def __init__(self, kinds: np.ndarray, lower: bool = False):
        self.kinds, self.table = kinds, lower_table() if lower else None
        self.powers, self.inverses = self._grow(WINDOW + 1)

    @staticmethod
    def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
        powers, inverses = np.full(n, MULTIPLIER, np.uint64), np.full(n, INVERSE, np.uint64)
        powers[0] = inverses[0] = 1
        return np.cumprod(powers, dtype=np.uint64), np.cumprod(inverses, dtype=np.uint64)

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the tokens, and for each row the number of its first token (n + 1 values)."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        kind = self.kinds[data]
        change = np.empty(len(data) + 1, bool)
        change[0] = change[-1] = True
        np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
        change[offsets] = True
        bounds = np.flatnonzero(change)
        real = kind[bounds[:-1]] != 0
        starts, ends = bounds[:-1][real], bounds[1:][real]
        return starts, ends, np.searchsorted(starts, offsets)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each token's bytes, by differences of a running polynomial modulo 2^64."""
        out, low = np.empty(len(starts), np.uint64), 0
        while low < len(starts):
            high = max(low + 1, int(np.searchsorted(ends, starts[low] + WINDOW, "right")))
            first, last = starts[low], ends[high - 1]
            if last - first >= len(self.powers):
                self.powers, self.inverses = self._grow(int(last - first) + 1)
            part = data[first:last] if self.table is None else self.table[data[first:last]]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * self.powers[: len(part)], out=sums[1:])
            s, e = starts[low:high] - first, ends[low:high] - first
            out[low:high] = mixed((sums[e] - sums[s]) * self.inverses[s])
            low = high
        return out

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token hashes, and for each row the number of its first token (n + 1 values)."""
        starts, ends, rows = self.split(data, offsets)
        return self.hashes(data, starts, ends), rows


def grams(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hashes of the n-grams that start at each word but the last n - 1, whatever row the words belong to."""
    count = max(0, len(words) - n + 1)
    found = np.full(count, seed, np.uint64)
    for i in range(n):
        found = mixed(found * np.uint64(MULTIPLIER) + words[i : i + count])
    return found


def numbers_of(rows: np.ndarray) -> np.ndarray:
    """For each token the number of its row."""
    return np.repeat(np.arange(len(rows) - 1), np.diff(rows))
