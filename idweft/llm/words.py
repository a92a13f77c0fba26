"""Words and hashes of texts, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Words are runs of anything but the six ASCII space characters: what bytes.split() gives.
WORD = r"[^\x20\x09-\x0D]+"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1_024) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, so that what a worker holds besides them stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of word ranges of one text: a polynomial over 64 bits with prefix sums."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        if len(_powers[0]) <= n:
            size = max(2 * n, 4096)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            for i, base in enumerate((_BASE, inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _powers[i] = np.cumprod(steps, dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * _powers[0][:n], dtype=np.uint64, out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words from start (inclusive) to end (exclusive), for arrays of both."""
        value = (self.sums[end] - self.sums[start]) * _powers[1][start]
        return mixed(value + (end - start).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """Hash of every window of ``size`` words."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        value = (self.sums[size:] - self.sums[:n]) * _powers[1][:n]
        return mixed(value + np.uint64(size))


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of ``size`` words that begins at one of ``starts``."""
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + size, n), minlength=n + 1)
    return np.cumsum(steps[:n]) > 0
