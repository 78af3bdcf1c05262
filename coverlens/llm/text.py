"""Texts in Arrow batches as arrays of word hashes. No Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text that are turned into arrays at once; a longer text goes alone.
CHUNK = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
MULTIPLIERS = _random.integers(1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, modulo 2**64, as far as a text has been long."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int):
        while len(self.up) < n:
            size = np.uint64(len(self.up))
            lift, drop = (np.uint64(pow(b, int(size), 1 << 64)) for b in (_BASE, _INVERSE))
            self.up = np.concatenate([self.up, self.up * lift])
            self.down = np.concatenate([self.down, self.down * drop])
        return self.up, self.down


_powers = _Powers()


def layout(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins in the bytes of all texts (one more entry: the end), and those bytes. Null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets.astype(np.int64), np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``size`` bytes, or one row."""
    rows, lo = len(offsets) - 1, 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        yield lo, hi
        lo = hi


def word_hashes(offsets: np.ndarray, data: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in lower case, one after the other, and where each text's words begin (one more: the end).

    ``gaps`` tells of each of the 256 bytes whether it separates words.
    """
    base = offsets[0]
    buffer = LOWER[data[base : offsets[-1]]]
    bounds = offsets - base
    inside = ~gaps[buffer]
    if not len(buffer):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    first = np.ones(len(buffer) + 1, bool)
    first[1:-1] = ~inside[:-1]
    first[bounds] = True  # a text's end is a word's end
    starts = np.flatnonzero(inside & first[:-1])
    last = np.ones(len(buffer), bool)
    last[:-1] = ~inside[1:]
    last[bounds[bounds > 0] - 1] = True
    ends = np.flatnonzero(inside & last) + 1
    up, down = _powers.upto(len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_BYTE[buffer] * up[: len(buffer)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, bounds)


def shingles(words: np.ndarray, begins: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """Per text: the hashes of its distinct runs of ``width`` words, ascending; of fewer words, the whole as one."""
    n = len(words)
    runs = np.zeros(max(n - width + 1, 0), np.uint64)
    for i in range(width):
        runs += words[i : n - width + 1 + i] * MULTIPLIERS[i] if len(runs) else np.zeros(0, np.uint64)
    runs = mixed(runs)
    for lo, hi in zip(begins[:-1], begins[1:]):
        if hi - lo >= width:
            yield np.unique(runs[lo : hi - width + 1])
        elif hi > lo:
            short = words[lo:hi] * MULTIPLIERS[: hi - lo]
            yield mixed(short.sum(dtype=np.uint64, keepdims=True) + np.array([hi - lo], np.uint64) * MULTIPLIERS[-1])
        else:
            yield np.zeros(0, np.uint64)
